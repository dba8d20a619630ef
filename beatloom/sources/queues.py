"""Review-queue records: a candidate beat with all that a reviewer sees.

Candidates are few, peaks, labels and samples are not: the tables meet by equi-joins
on the recording and the peak, and samples come as blocks of an index (see
``sampleindex``): a candidate's context spans one or two blocks, whose arrays are cut
and put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.operators.sampleindex import BLOCK, SampleIndex
from beatloom.params import SERIES, Series
from beatloom.plans.ordered import running

SCORES = ("p_artifact_ensemble", "disagreement", "composite_score")
UNLABELLED = "unlabeled"
# Fields of a record, in order.
FIELDS = (
    "peak_id", "timestamp_ms", "segment_idx", "current_label", *SCORES, "rr_prev_ms", "rr_next_ms",
    "context_ecg", "context_timestamps_ms", "r_peak_index_in_context",
)


def _spans(points: DataFrame, index: SampleIndex, half_ms: int, s: Series) -> DataFrame:
    """Each point once per block that may hold samples within ``half_ms``."""
    key = list(s.key)
    t = F.col(s.ts)
    ends = points.select(*key, s.tie, F.explode(F.array(F.struct((t - half_ms).alias("at"), F.lit(0).alias("end")), F.struct((t + half_ms).alias("at"), F.lit(1).alias("end")))).alias("_e"))
    ends = ends.select(*key, F.col("_e.at").alias(s.ts), F.struct(s.tie, "_e.end").alias("_p"), F.lit(1).alias("_kind"))
    heads = index.heads.select(*key, F.col("_from").alias(s.ts), F.col("_block").alias("_b"), F.lit(0).alias("_kind"))
    found = running(
        ends.unionByName(heads, allowMissingColumns=True), {"_last": ("last", F.col("_b")), "_next": ("next", F.col("_b"))}, s,
        position=F.col(s.ts), width=s.bucket_ms, order=(s.ts, "_kind"),
    ).filter(F.col("_kind") == 1)
    # before the first block the span begins with it; ending there it is empty
    at = lambda end, block: F.max(F.when(F.col("_p.end") == end, block))
    span = found.groupBy(*key, F.col(f"_p.{s.tie}").alias(s.tie)).agg(
        at(0, F.coalesce("_last", "_next")).alias("_lo"), at(1, F.col("_last")).alias("_hi")
    )
    return span.filter(F.col("_lo") <= F.col("_hi")).select(*key, s.tie, F.explode(F.sequence("_lo", "_hi")).alias("_block"))


def contexts(points: DataFrame, index: SampleIndex, half_ms: int, s: Series = SERIES, value: str = "ecg", scope: str = "segment_idx") -> DataFrame:
    """Key, peak, ``context`` and ``context_ms``: the samples within ``half_ms`` of the
    point (both ends included) and of its ``scope``, by time. Points without any
    sample have no row. The index needs the arrays of ``value`` and ``scope``."""
    key = [*s.key, s.tie]
    d = _spans(points, index, half_ms, s).join(points.select(*key, F.col(s.ts).alias("_c"), F.col(scope).alias("_s")), key)
    d = d.join(index.blocks, [*s.key, "_block"])
    rows = F.arrays_zip(F.col("_t").alias("t"), F.col(f"_v_{value}").alias("v"), F.col(f"_v_{scope}").alias("s"))
    # own samples of the block only: its halo belongs to the next ones
    own = F.col("_block") * BLOCK - F.col("_first")
    mine = F.filter(rows, lambda x, i: (i >= own) & (i < own + BLOCK) & (F.abs(x["t"] - F.col("_c")) <= half_ms) & (x["s"] == F.col("_s")))
    parts = d.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_block", mine.alias("x")))).alias("_p"))
    flat = F.flatten(F.col("_p.x"))
    d = parts.select(*key, flat.alias("_x")).filter(F.size("_x") > 0)
    return d.select(*key, F.col("_x.v").alias("context"), F.col("_x.t").alias("context_ms"))


def queue_records(
    candidates: DataFrame, peaks: DataFrame, labels: DataFrame, index: SampleIndex, half_ms: int = 2500, s: Series = SERIES
) -> DataFrame:
    """One record of ``FIELDS`` per candidate (key and peak), with the key.

    Time and segment are the candidate's, else the peak's. Without a label the beat
    is ``unlabeled``, missing scores are 0, missing intervals null, and without
    samples the context is empty and its peak index 0. Of several peaks or labels of
    one beat one is taken, as they are assumed to agree.
    """
    key = [*s.key, s.tie]
    have = set(candidates.columns)
    own = lambda c: F.col(f"c.{c}") if c in have else F.lit(None)
    p = peaks.select(*key, F.col(s.ts).alias("_t"), F.col("segment_idx").alias("_s")).dropDuplicates(key)
    rr = [c if c in labels.columns else F.lit(None).cast("double").alias(c) for c in ("rr_prev_ms", "rr_next_ms")]
    lab = labels.select(*key, "label", *rr).dropDuplicates(key)
    d = candidates.alias("c").join(p, key, "left").join(lab, key, "left")
    score = lambda c: F.round(F.coalesce(own(c).cast("double"), F.lit(0.0)), 6).alias(c)
    d = d.select(
        *key, F.coalesce(own(s.ts), "_t").alias(s.ts), F.coalesce(own("segment_idx"), "_s").alias("segment_idx"),
        F.coalesce("label", F.lit(UNLABELLED)).alias("current_label"), *[score(c) for c in SCORES],
        *[F.round(F.col(c).cast("double"), 2).alias(c) for c in ("rr_prev_ms", "rr_next_ms")],
    )
    c = contexts(d.filter(F.col(s.ts).isNotNull()), index, half_ms, s)
    d = d.join(c, key, "left")
    nearest: Column = F.transform("context_ms", lambda t: F.abs(t - F.col(s.ts)))
    return d.select(
        *s.key, *[f for f in FIELDS if f in d.columns],
        F.coalesce(F.transform("context", lambda v: F.round(v, 6)), F.array().cast("array<double>")).alias("context_ecg"),
        F.coalesce("context_ms", F.array().cast("array<bigint>")).alias("context_timestamps_ms"),
        F.coalesce(F.array_position(nearest, F.array_min(nearest)) - 1, F.lit(0)).cast("int").alias("r_peak_index_in_context"),
    )
