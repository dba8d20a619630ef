"""Mergeable states of an interval series and their roll-up to timeframes.

The beats are read once. A state holds, for one bin of the greatest length that
divides all timeframes (five minutes), counts, sums, sums of squares and order
patterns. A difference to a neighbour counts for a window only if the neighbour lies
in it, so states also carry the bins that their neighbours lie in: inside a bin all
are the bin itself, and only the few beats at its borders form states of their own.
States of all bins of a window add up to the window's metrics, so timeframes cost a
few rows per bin, not a copy of the beats each.

Interval histograms roll up in two steps, to the bin and to a coarser level (the
hour) from which the long timeframes are added up.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.params import Series
from beatloom.plans.ordered import over_rows, running
from beatloom.session import materialise

Frames = Mapping[str, tuple[int, int]]  # timeframe -> (length in ms, fewest beats)
PATTERNS = 8  # order patterns of three values as bits; two of them never occur
COARSE = 8  # a second histogram level is worth its pass from so many bins on


@dataclass
class States:
    """States and histograms of one series; each is computed and written at first use."""

    rr: DataFrame
    anchor: DataFrame
    frames: Frames
    s: Series

    @property
    def key(self) -> list[str]:
        return [*self.s.key, "timeframe", "window_start_ms"]

    @property
    def base_ms(self) -> int:
        return math.gcd(*(ms for ms, _ in self.frames.values()))

    @cached_property
    def bins(self) -> DataFrame:
        return materialise(_states(self.rr, self.anchor, self.base_ms, self.s))

    @cached_property
    def levels(self) -> dict[int, DataFrame]:
        """Histograms by the length of their bins."""
        s, base = self.s, self.base_ms
        fine = self.rr.join(self.anchor, list(s.key)).groupBy(*s.key, "anchor_ms", _bin(F.col(s.ts), base).alias("_b"), "rr_ms").agg(F.count(F.lit(1)).alias("_n"))
        levels = {base: materialise(fine)}
        lengths = sorted({ms for ms, _ in self.frames.values()})
        coarse = next((ms for ms in lengths if ms >= COARSE * base and all(x % ms == 0 for x in lengths if x > ms)), None)
        if coarse is not None:
            up = F.floor(F.col("_b") / (coarse // base)).cast("long").alias("_b")
            levels[coarse] = materialise(levels[base].groupBy(*s.key, "anchor_ms", up, "rr_ms").agg(F.sum("_n").alias("_n")))
        return levels


def anchors(rr: DataFrame, s: Series) -> DataFrame:
    """The first row of each recording: where its windows start."""
    return rr.groupBy(*s.key).agg(F.min(s.ts).alias("anchor_ms"))


def neighbours(rr: DataFrame, s: Series) -> DataFrame:
    """Values and times of the rows around each interval."""

    def build(d, w):
        cols = {}
        for off in (-2, -1, 1, 2):
            f = F.lag if off < 0 else F.lead
            cols[f"_v{off}"] = f("rr_ms", abs(off)).over(w)
        for off in (-5, -1, 2, 5):
            f = F.lag if off < 0 else F.lead
            cols[f"_t{off}"] = f(s.ts, abs(off)).over(w)
        return d.withColumns(cols)

    return over_rows(rr, 5, 5, build, s)


def _bin(ts: Column, ms: int) -> Column:
    return F.floor((ts - F.col("anchor_ms")) / F.lit(ms)).cast("long")


def _states(rr: DataFrame, anchor: DataFrame, base: int, s: Series) -> DataFrame:
    d = neighbours(rr, s).join(anchor, list(s.key))
    x, before = F.col("rr_ms"), F.col("_v-1")
    bins = {"_b": _bin(F.col(s.ts), base), "_lo1": _bin(F.col("_t-1"), base), "_lo5": _bin(F.col("_t-5"), base),
            "_hi2": _bin(F.col("_t2"), base), "_hi5": _bin(F.col("_t5"), base)}
    d = d.withColumns(bins).withColumn("_d", x - before)
    dd = F.col("_d")
    turn = (x + F.col("_v1") - before - F.col("_v-2")) / 4
    around = F.col("_lo5").isNotNull() & F.col("_hi5").isNotNull()
    a, b, c = x, F.col("_v1"), F.col("_v2")
    pattern = (a <= b).cast("int") * 4 + (b <= c).cast("int") * 2 + (a <= c).cast("int")
    return d.groupBy(*s.key, *bins).agg(
        F.count(F.lit(1)).alias("n"), F.min(s.idx).alias("first_idx"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
        F.count(dd).alias("nd"), F.sum(dd).alias("sd"), F.sum(dd * dd).alias("sdd"),
        F.count_if(F.abs(dd) > 20).alias("n20"), F.count_if(F.abs(dd) > 50).alias("n50"),
        F.count(F.when(around & (dd > 0), turn)).alias("n_dc"), F.sum(F.when(around & (dd > 0), turn)).alias("s_dc"),
        F.count(F.when(around & (dd < 0), turn)).alias("n_ac"), F.sum(F.when(around & (dd < 0), turn)).alias("s_ac"),
        *[F.count_if(F.col("_hi2").isNotNull() & (pattern == p)).alias(f"p{p}") for p in range(PATTERNS)],
    )


def states(rr: DataFrame, frames: Frames, anchor: DataFrame | None = None, s: Series | None = None) -> States:
    s = s or Series(tie="timestamp_ms", idx="rr_idx")
    # anchors, states and histograms read the intervals: written once
    rr = materialise(rr)
    return States(rr, per_key(anchors(rr, s) if anchor is None else anchor), dict(frames), s)


def per_key(d: DataFrame) -> DataFrame:
    """A table of one row per recording, ready to be joined.

    Read from a file its size is known and small, so Spark broadcasts it. A shuffle by
    the recording alone would be kept for the grouping by finer keys behind the join:
    one task per recording.
    """
    return materialise(d.coalesce(1))


def _per_frame(d: DataFrame, frames: Frames, level: int) -> DataFrame:
    """Rows of bins of ``level`` ms once per timeframe, with bins per window."""
    each = F.array(*[
        F.struct(F.lit(n).alias("timeframe"), F.lit(ms).cast("long").alias("length_ms"), F.lit(ms // level).cast("long").alias("_k"))
        for n, (ms, _) in frames.items()
    ])
    return d.select("*", F.explode(each).alias("_f")).select(*d.columns, "_f.*")


def enough(n: Column, frames: Frames) -> Column:
    least = F.lit(None).cast("long")
    for name, (_, k) in frames.items():
        least = F.when(F.col("timeframe") == name, F.lit(k)).otherwise(least)
    return n >= least


def windows(st: States) -> DataFrame:
    """Sums of every window that has enough beats: ``_n``, ``_sx``, ... by window."""
    s = st.s
    d = _per_frame(st.bins, st.frames, st.base_ms)
    of = lambda c: F.floor(F.col(c) / F.col("_k")).cast("long")
    d = d.withColumn("_w", of("_b"))
    same = lambda *cs: reduce(Column.__and__, [of(c) == F.col("_w") for c in cs])
    total = lambda c, ok: F.sum(F.when(ok, F.col(c))).alias(f"_{c}")
    prev, both, next2 = same("_lo1"), same("_lo5", "_hi5"), same("_hi2")
    g = d.groupBy(*s.key, "timeframe", "_w").agg(
        F.max("length_ms").alias("length_ms"), F.min("first_idx").alias("first_idx"),
        *[F.sum(c).alias(f"_{c}") for c in ("n", "sx", "sxx")],
        *[total(c, prev) for c in ("nd", "sd", "sdd", "n20", "n50")],
        *[total(c, both) for c in ("n_dc", "s_dc", "n_ac", "s_ac")],
        *[total(f"p{p}", next2) for p in range(PATTERNS)],
    )
    g = g.filter(enough(F.col("_n"), st.frames)).join(st.anchor, list(s.key))
    return g.withColumn("window_start_ms", F.col("anchor_ms") + F.col("_w") * F.col("length_ms")).drop("anchor_ms", "_w")


def histograms(st: States) -> DataFrame:
    """Counts by window and value; a window's rows of one value are to be added."""
    parts = []
    for level in sorted(st.levels):
        above = min((x for x in st.levels if x > level), default=None)
        mine = {n: v for n, v in st.frames.items() if v[0] >= level and (above is None or v[0] < above)}
        if mine:
            d = _per_frame(st.levels[level], mine, level)
            start = F.col("anchor_ms") + F.floor(F.col("_b") / F.col("_k")).cast("long") * F.col("length_ms")
            parts.append(d.select(*st.s.key, "timeframe", start.alias("window_start_ms"), "rr_ms", "_n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefix_sums(st: States) -> DataFrame:
    """Running sums of the intervals and their squares, as differences from the
    recording's rounded mean (exact for whole ms, small for others)."""
    s = st.s
    middle = per_key(st.bins.groupBy(*s.key).agg(F.round(F.sum("sx") / F.sum("n")).alias("_mid")))
    d = st.rr.join(middle, list(s.key)).withColumn("_x", F.col("rr_ms") - F.col("_mid"))
    x = F.col("_x")
    d = running(d, {"_px": ("sum", x), "_pxx": ("sum", x * x)}, s)
    return d.select(*s.key, s.idx, "_mid", "_px", "_pxx")
