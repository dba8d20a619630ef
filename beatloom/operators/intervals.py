"""Interval algebra on (key, start, end), both ends inclusive, in ms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.operators.temporal import _stack
from beatloom.params import SERIES, Series
from beatloom.plans.ordered import running
from beatloom.session import materialise

S, E = "start_ms", "end_ms"


def _series(s: Series) -> Series:
    return Series(key=s.key, ts=S, tie=E, idx="_", bucket_ms=s.bucket_ms)


def merge(df: DataFrame, adjacency_ms: int = 0, s: Series = SERIES) -> DataFrame:
    """Union of the intervals; those no further apart than ``adjacency_ms`` join."""
    iv = _series(s)
    at = {"position": F.col(S), "width": iv.bucket_ms, "order": (S, E)}
    # two running maxima read the intervals four times: written once, whatever
    # plan they come from
    d = materialise(df.select(*s.key, S, E))
    d = running(d, {"_reach": ("max", F.col(E))}, iv, exclusive=True, **at)
    opens = F.col("_reach").isNull() | (F.col(S) > F.col("_reach") + adjacency_ms)
    # the latest opening start is the name of the island
    d = running(d, {"_island": ("max", F.when(opens, F.col(S)))}, iv, **at)
    return d.groupBy(*s.key, "_island").agg(F.min(S).alias(S), F.max(E).alias(E)).drop("_island")


def clip(df: DataFrame, requests: DataFrame, s: Series = SERIES) -> DataFrame:
    """Parts of the intervals inside each key's [req_start_ms, req_end_ms];
    reversed request ends are swapped."""
    req = ordered_request(requests, s)
    j = df.join(req, list(s.key))
    return j.filter((F.col(E) >= F.col("_a")) & (F.col(S) <= F.col("_b"))).select(
        *s.key, F.greatest(S, "_a").alias(S), F.least(E, "_b").alias(E)
    )


def ordered_request(requests: DataFrame, s: Series = SERIES) -> DataFrame:
    return requests.select(
        *s.key,
        F.least("req_start_ms", "req_end_ms").alias("_a"),
        F.greatest("req_start_ms", "req_end_ms").alias("_b"),
    )


def uncovered(covered: DataFrame, requests: DataFrame, s: Series = SERIES) -> DataFrame:
    """Gaps of each key's request that no covered interval touches."""
    merged = merge(clip(covered, requests, s), 1, s)
    req = ordered_request(requests, s)
    # a request ends at a virtual interval just behind it, so that every gap
    # lies between the previous end and some start
    tail = req.select(*s.key, (F.col("_b") + 1).alias(S), (F.col("_b") + 1).alias(E))
    iv = _series(s)
    d = running(
        merged.unionByName(tail),
        {"_prev_end": ("max", F.col(E))},
        iv,
        position=F.col(S),
        width=iv.bucket_ms,
        order=(S, E),
        exclusive=True,
    ).join(req, list(s.key))
    begin = F.coalesce(F.col("_prev_end") + 1, F.col("_a"))
    return d.filter(F.col(S) > begin).select(*s.key, begin.alias("_g"), (F.col(S) - 1).alias(E)).withColumnRenamed("_g", S)


def reset_coverage(covered: DataFrame, cutoffs: DataFrame, s: Series = SERIES) -> DataFrame:
    """Forget coverage from each key's ``cutoff_ms`` on."""
    d = covered.join(cutoffs, list(s.key), "left")
    end = F.when(F.col("cutoff_ms").isNull(), F.col(E)).otherwise(F.least(F.col(E), F.col("cutoff_ms") - 1))
    return merge(d.withColumn(E, end).filter(F.col(S) <= F.col(E)), 1, s)


def rows_in_gaps(rows: DataFrame, gaps: DataFrame, s: Series = SERIES) -> DataFrame:
    """Rows inside the (disjoint) gaps, with the gap's start as gap_ms."""
    d = running(
        _stack(rows, gaps, s, S, [E]),
        {"_gap": ("last", F.when(F.col("_kind") == 0, F.col("_o")))},
        s,
        position=F.col(s.ts),
        width=s.bucket_ms,
        order=(s.ts, "_kind"),
    )
    return d.filter((F.col("_kind") == 1) & (F.col(s.ts) <= F.col("_gap")[E])).select(
        "_p.*", F.col("_gap.t").alias("gap_ms")
    )


def realised(rows: DataFrame, s: Series = SERIES) -> DataFrame:
    """First and last row time of each gap: the coverage to record."""
    return rows.groupBy(*s.key, "gap_ms").agg(F.min(s.ts).alias(S), F.max(s.ts).alias(E))


def resume_after(windows: DataFrame, done: DataFrame, start: str, key: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Windows that start after the last processed one of their key."""
    last = done.groupBy(*key).agg(F.max(start).alias("_last"))
    d = windows.join(last, list(key), "left")
    return d.filter(F.col("_last").isNull() | (F.col(start) > F.col("_last"))).drop("_last")
