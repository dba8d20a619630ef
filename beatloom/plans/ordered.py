"""Ordered computation over long series without one task per series.

A single recording may hold a large share of all rows, so no window here is
partitioned by the recording alone. Three building blocks:

* ``over_rows``  - frames counted in rows: buckets of equal row counts plus
  copies of the few rows that neighbours need (a halo);
* ``over_time``  - frames measured in ms: time buckets plus a time halo;
* ``running``    - unbounded frames (running sum, max, last): one aggregate row
  per bucket, a prefix over those few rows, then the bucket-local frame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from beatloom.params import SERIES, Series
from beatloom.session import materialise

_HOME, _SLOT = "_home", "_slot"
RANGE = "_range"


def _bucket(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width)).cast("long")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by ``by`` over all shuffle partitions.

    The number is given, so AQE does not join partitions by their compressed size: a
    task's rows, and the memory to sort them, then follow the session's number.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _with_halo(df: DataFrame, pos: Column, width: int, before: int, after: int) -> DataFrame:
    """Copy each row to every bucket whose own rows can see it.

    A row without a position has no neighbours: it gets a bucket of its own.
    """
    alone = F.lit(-(1 << 61)) - F.monotonically_increasing_id()
    df = df.withColumn(_HOME, F.coalesce(_bucket(pos, width), alone))
    if before == 0 and after == 0:
        return df.withColumn(_SLOT, F.col(_HOME))
    first, last = _bucket(pos - after, width), _bucket(pos + before, width)
    return df.withColumn(_SLOT, F.explode(F.coalesce(F.sequence(first, last), F.array(_HOME))))


def _keep_home(df: DataFrame) -> DataFrame:
    return df.filter(F.col(_HOME) == F.col(_SLOT)).drop(_HOME, _SLOT)


def over_rows(
    df: DataFrame,
    before: int,
    after: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    s: Series = SERIES,
) -> DataFrame:
    """Apply ``build(frame, window)``; its result at a row may depend on at most
    ``before`` rows ahead of it and ``after`` rows behind it.

    ``build`` may chain window columns as long as their summed reach fits. One
    shuffle on (key, bucket) serves all of them.
    """
    framed = _with_halo(df, F.col(s.idx), s.bucket_rows, before, after)
    w = Window.partitionBy(*s.key, _SLOT).orderBy(s.idx)
    return _keep_home(build(framed, w))


def over_time(
    df: DataFrame,
    before_ms: int,
    after_ms: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    s: Series = SERIES,
) -> DataFrame:
    """As ``over_rows`` for frames in ms; the window orders by ``s.ts`` alone so
    that ``rangeBetween`` works."""
    width = max(s.bucket_ms, before_ms + after_ms)
    framed = _with_halo(df, F.col(s.ts), width, before_ms, after_ms)
    w = Window.partitionBy(*s.key, _SLOT).orderBy(s.ts)
    return _keep_home(build(framed, w))


_PLAIN = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    cols: Mapping[str, tuple[str, Column]],
    s: Series = SERIES,
    *,
    position: Column | None = None,
    width: int | None = None,
    order: tuple[str, ...] | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Unbounded frames per key: running ``sum`` / ``max`` / ``min``, the
    ``last`` non-null value up to the row and the ``next`` one from it on.

    ``position`` must grow with ``order``; the default is the dense row index.
    ``exclusive`` leaves the row itself out. The prefix table has one row per
    bucket, and only that table is windowed by the whole key.
    """
    position = F.col(s.idx) if position is None else position
    width = s.bucket_rows if width is None else width
    order = (s.idx,) if order is None else order
    src = {n: f"_src_{n}" for n in cols}
    base = df.withColumn(_SLOT, _bucket(position, width)).withColumns(
        {src[n]: e for n, (_, e) in cols.items()}
    )
    rows = spread(base, *s.key, _SLOT)
    sort_key = F.struct(*order)

    def total(n: str, fn: str) -> Column:
        if fn in _PLAIN:
            return _PLAIN[fn](src[n])
        pick = F.max_by if fn == "last" else F.min_by
        return pick(F.col(src[n]), F.when(F.col(src[n]).isNotNull(), sort_key))

    totals = base.groupBy(*s.key, _SLOT).agg(
        *[total(n, fn).alias(f"_tot_{n}") for n, (fn, _) in cols.items()]
    )

    def frames(asc: list[Column], desc: list[Column], *part: str, last: int):
        w = Window.partitionBy(*part)
        return tuple(w.orderBy(*o).rowsBetween(Window.unboundedPreceding, last) for o in (asc, desc))

    slot = F.col(_SLOT)
    ahead, behind = frames([slot.asc()], [slot.desc()], *s.key, last=-1)
    local, local_back = frames(
        [F.col(c).asc() for c in order],
        [F.col(c).desc() for c in order],
        *s.key,
        _SLOT,
        last=-1 if exclusive else 0,
    )

    def over(n: str, fn: str, column: str, fwd: WindowSpec, back: WindowSpec) -> Column:
        if fn in _PLAIN:
            return _PLAIN[fn](column).over(fwd)
        return F.last(column, ignorenulls=True).over(fwd if fn == "last" else back)

    carry = totals.select(
        *s.key,
        _SLOT,
        *[over(n, fn, f"_tot_{n}", ahead, behind).alias(f"_pre_{n}") for n, (fn, _) in cols.items()],
    )
    out = {}
    for n, (fn, _) in cols.items():
        pre, here = F.col(f"_pre_{n}"), over(n, fn, src[n], local, local_back)
        if fn == "sum":
            out[n] = F.coalesce(pre, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif fn in ("max", "min"):
            out[n] = (F.greatest if fn == "max" else F.least)(pre, here)
        else:
            out[n] = F.coalesce(here, pre)
    return (
        rows.join(carry, [*s.key, _SLOT], "left")
        .withColumns(out)
        .drop(_SLOT, *src.values(), *[f"_pre_{n}" for n in cols])
    )


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Rows dealt out by the ranges of ``order``, with the number of the range.

    Spark samples the bounds, so ranges hold about equal numbers of rows whatever
    the values are. Written once: the numbers do not change when read again.
    Use the column as ``position`` of ``running`` with ``width`` 1.
    """
    return materialise(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def row_index(df: DataFrame, s: Series = SERIES, name: str | None = None) -> DataFrame:
    """Dense 0-based position per key in (ts, tie) order."""
    return running(
        df,
        {name or s.idx: ("sum", F.lit(1).cast("long"))},
        s,
        position=F.col(s.ts),
        width=s.bucket_ms,
        order=(s.ts, s.tie),
    ).withColumn(name or s.idx, F.col(name or s.idx) - 1)


def run_islands(
    df: DataFrame, starts: Column, s: Series = SERIES, name: str = "island_id", **where
) -> DataFrame:
    """Number the islands opened by rows where ``starts`` is true (1-based)."""
    return running(df, {name: ("sum", F.when(starts, F.lit(1)).otherwise(F.lit(0)).cast("long"))}, s, **where)
