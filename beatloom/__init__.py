"""Beat-level time-series analytics as PySpark DataFrame operators."""

from beatloom.params import Params, SERIES, Series

__all__ = ["Params", "SERIES", "Series"]
