"""Greedy thinning of close events.

An anchor absorbs every later event within the tolerance of the anchor; the
next event opens the next cluster. That rule is sequential, so the work is cut
into time chunks. A chunk is a function from "where does the first anchor of
this chunk lie" to "where does its last anchor lie", and only few first anchors
are possible: those within one tolerance of the chunk's first event. Composing
these small functions over unbroken chains of chunks gives every chunk its first
anchor, and then all chunks run on their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatloom.params import SERIES, Series
from beatloom.plans.ordered import over_time, spread
from beatloom.session import materialise

CHUNK_MS = 600_000


def _next_open(ts: np.ndarray, tolerance: int) -> np.ndarray:
    """Position of the first event beyond the tolerance of each event."""
    return np.searchsorted(ts, ts + tolerance, side="right")


def _summary(tolerance: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["_ts"].to_numpy())
        nxt = _next_open(ts, tolerance)
        last = np.arange(len(ts))
        for i in range(len(ts) - 2, -1, -1):
            if nxt[i] < len(ts):
                last[i] = last[nxt[i]]
        n = min(len(ts), int(np.searchsorted(ts, ts[0] + tolerance, side="right")) + 1)
        head = pdf.iloc[0]
        return pd.DataFrame(
            {
                "_k": [head["_k"]],
                "_chunk": [head["_chunk"]],
                "_first": [ts[0]],
                "_end": [ts[-1]],
                "_entries": [ts[:n].tolist()],
                "_exits": [ts[last[:n]].tolist()],
            }
        )

    return run


def _compose(tolerance: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        entry, anchor = [], None
        for first, entries, exits in zip(pdf["_first"], pdf["_entries"], pdf["_exits"], strict=True):
            at = 0 if anchor is None else int(np.searchsorted(entries, anchor + tolerance, side="right"))
            if at == len(entries):  # the previous anchor absorbs the whole chunk
                entry.append(None)
                continue
            entry.append(int(entries[at]))
            anchor = int(exits[at])
        return pd.DataFrame(
            {"_k": pdf["_k"].to_numpy(), "_chunk": pdf["_chunk"].to_numpy(), "_entry": pd.array(entry, dtype="Int64")}
        )

    return run


def _mark(tolerance: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["_ts"].to_numpy())
        keep = np.zeros(len(ts), dtype=bool)
        entry = pdf["_entry"].iloc[0]
        if not pd.isna(entry):
            nxt = _next_open(ts, tolerance)
            i = int(np.searchsorted(ts, int(entry)))
            while i < len(ts):
                keep[i] = True
                i = nxt[i]
        return pd.DataFrame({"_k": pdf["_k"].iloc[0], "_ts": ts, "_anchor": keep})

    return run


def anchors(times: DataFrame, tolerance_ms: int) -> DataFrame:
    """``times`` has distinct (_k, _ts); adds the boolean ``_anchor``.

    A chunk of ten minutes holds at most 600 000 distinct ms, and a chain row at
    most tolerance + 2 pairs. Chunks are few bytes with much work, so they are dealt
    over a given number of tasks; a chunk without neighbours is not composed.
    """
    d = spread(times.withColumn("_chunk", F.floor(F.col("_ts") / CHUNK_MS)), "_k", "_chunk")
    part = d.groupBy("_k", "_chunk").applyInPandas(
        _summary(tolerance_ms),
        "_k string, _chunk long, _first long, _end long, _entries array<bigint>, _exits array<bigint>",
    )
    w = Window.partitionBy("_k").orderBy("_chunk")
    linked = (F.col("_first") - F.lag("_end").over(w)) <= tolerance_ms
    part = part.withColumn("_opens", (~F.coalesce(linked, F.lit(False))).cast("long")).withColumn(
        "_chain", F.sum("_opens").over(w)
    ).withColumn("_single", (F.col("_opens") == 1) & (F.coalesce(F.lead("_opens").over(w), F.lit(1)) == 1))
    part = materialise(part)  # both kinds of chain read it
    composed = spread(part.filter(~F.col("_single")), "_k", "_chain").groupBy("_k", "_chain").applyInPandas(
        _compose(tolerance_ms), "_k string, _chunk long, _entry long"
    )
    entries = composed.unionByName(part.filter("_single").select("_k", "_chunk", F.col("_first").alias("_entry")))
    return (
        d.join(entries, ["_k", "_chunk"])
        .groupBy("_k", "_chunk")
        .applyInPandas(_mark(tolerance_ms), "_k string, _ts long, _anchor boolean")
    )


def greedy_clusters(
    df: DataFrame, tolerance_ms: int, priority: list[str] | None = None, s: Series = SERIES
) -> DataFrame:
    """One row per cluster: the best by ``priority`` (lower first), then the
    earliest, then the lowest tie column.

    Rows of equal time are reduced first (partial aggregation, so a pile of
    copies never meets in one task). Events without neighbours skip the
    sequential part.
    """
    rank = F.struct(*(priority or []), F.col(s.ts), F.col(s.tie))
    row = F.struct(*df.columns)
    distinct = df.groupBy(*s.key, s.ts).agg(F.min_by(row, rank).alias("_row"), F.min(rank).alias("_rank"))

    def build(d, w):
        one = F.lit(1)
        return d.withColumns(
            {
                "_prev": F.count(one).over(w.rangeBetween(-tolerance_ms, -1)) > 0,
                "_next": F.count(one).over(w.rangeBetween(1, tolerance_ms)) > 0,
            }
        )

    d = over_time(distinct, tolerance_ms, tolerance_ms, build, s).withColumn(
        "_k", F.to_json(F.struct(*s.key))
    )
    # the crowded events are few; written once, the chain below reads them often
    dense = materialise(d.filter(F.col("_prev") | F.col("_next")))
    marks = anchors(dense.select("_k", F.col(s.ts).alias("_ts")), tolerance_ms)
    # an absorbed event lies at most one tolerance behind its anchor
    marked = dense.join(marks.withColumnRenamed("_ts", s.ts), ["_k", s.ts])
    owned = over_time(
        marked,
        tolerance_ms,
        0,
        lambda x, w: x.withColumn(
            "_owner", F.max(F.when(F.col("_anchor"), F.col(s.ts))).over(w.rangeBetween(-tolerance_ms, 0))
        ),
        s,
    )
    best = owned.groupBy(*s.key, "_owner").agg(F.min_by("_row", "_rank").alias("_row"))
    alone = d.filter(~(F.col("_prev") | F.col("_next"))).select("_row")
    return alone.unionByName(best.select("_row")).select("_row.*")


def refractory(df: DataFrame, limit_ms: int, s: Series = SERIES) -> DataFrame:
    """Keep an event if the last kept one is at least ``limit_ms`` earlier."""
    return greedy_clusters(df, limit_ms - 1, None, s)


def union_detections(a: DataFrame, b: DataFrame, tolerance_ms: int, s: Series = SERIES) -> DataFrame:
    """Union of two detections; an event within the tolerance of the last kept
    one is dropped."""
    return greedy_clusters(a.unionByName(b), tolerance_ms, None, s)
