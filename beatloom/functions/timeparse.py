"""Text and mixed-type times as epoch ms, independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: date, T or blank, time, up to any fraction digits, optional UTC mark.
ISO = r"^(\d+-\d+-\d+)[T ](\d+):(\d+):(\d+)(?:\.(\d+))?(?:Z|\+00:00)?$"


def iso_ms(text: Column) -> Column:
    """ISO text read as UTC; the fraction is cut (not rounded) to ms."""
    part = lambda i: F.regexp_extract(text, ISO, i)
    day = F.unix_date(part(1).try_cast("date")).cast("long")
    h, m, s = (part(i).try_cast("long") for i in (2, 3, 4))
    frac = F.substring(F.rpad(part(5), 9, "0"), 1, 3).try_cast("long")
    return day * 86_400_000 + h * 3_600_000 + m * 60_000 + s * 1000 + F.coalesce(frac, F.lit(0))


def any_ms(text: Column) -> Column:
    """ISO text or a number as text (epoch ms, fraction cut); null otherwise."""
    num = text.try_cast("double")
    return F.coalesce(iso_ms(text), F.when(~F.isnan(num), num).cast("long"))


def sorted_times(texts: Column) -> Column:
    """Parsed times of a mixed list in order; unreadable entries are left out."""
    return F.array_sort(F.filter(F.transform(texts, any_ms), lambda t: t.isNotNull()))


def epoch_any_unit(x: Column) -> Column:
    """ns, ms or s to ms by magnitude: above 1e15 ns, below 1e12 s, else ms.
    Whole numbers stay exact: ns do not fit a double."""
    whole = F.floor(x).cast("long")
    ns = F.floor(whole.cast("decimal(20,0)") / F.lit(1_000_000)).cast("long")
    return F.when(x > 1e15, ns).when(x < 1e12, F.floor(x * 1000).cast("long")).otherwise(whole)


def segment_number(text: Column) -> Column:
    """'seg_12' or '12' -> 12, null if it is neither."""
    return F.regexp_replace(text, "^seg_", "").try_cast("int")


def local_to_utc_ms(text: Column, zone: str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Wall-clock text of a zone as epoch ms, null if unreadable."""
    wall = F.try_to_timestamp(text, F.lit(fmt))
    return F.unix_millis(F.to_utc_timestamp(wall, zone))
