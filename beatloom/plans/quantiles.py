"""Exact quantiles of groups that may be too large for one task.

``percentile`` keeps every distinct value of a group in one task. That suits
segments, windows and other groups bounded in time; for whole tables, whole
categories or one hot category this module ranks distinct values with a running
sum over ranges of values and picks the two values around each rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.params import Series
from beatloom.plans.ordered import RANGE, in_ranges, running


def exact_quantiles(
    df: DataFrame, value: str | Column, probs: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """One row per group: linear-interpolated quantiles, named by ``probs``."""
    group = list(group)
    v = F.col(value) if isinstance(value, str) else value
    counts = (
        df.select(*group, v.cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*group, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # the counts are read by the size, the range totals and the ranking
    counts = in_ranges(counts, *group, "_v")
    size = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    # one row per group: categories or models, or a single row
    d = counts.join(size, group) if group else counts.crossJoin(F.broadcast(size))
    s = Series(key=tuple(group), ts=RANGE, tie="_v", idx="_")
    d = running(d, {"_cum": ("sum", F.col("_n"))}, s, position=F.col(RANGE), width=1, order=("_v",))
    aggs = []
    for name, p in probs.items():
        rank = (F.col("_size") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            aggs.append(F.min(F.when(F.col("_cum") > at, F.col("_v"))).alias(f"_{name}_{side}"))
    out = d.groupBy(*group).agg(F.max("_size").alias("_size"), *aggs)
    cols = []
    for name, p in probs.items():
        rank = (F.col("_size") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return out.select(*group, *cols)
