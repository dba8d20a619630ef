"""Peaks, labels and segment sets from detections and annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatloom.functions.timeparse import any_ms, iso_ms, segment_number
from beatloom.operators import relational, temporal, thinning
from beatloom.operators.rollup import per_key
from beatloom.params import DEFAULTS, SERIES, Params, Series
from beatloom.plans.ordered import row_index, running
from beatloom.session import materialise

SEG = ("recording_id", "segment_idx")


def recording_starts(*sources: DataFrame, ts: str = "timestamp_ms", p: Params = DEFAULTS, key: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Earliest valid time per recording over all sources."""
    out = sources[0].select(*key, F.col(ts))
    for s in sources[1:]:
        out = out.unionByName(s.select(*key, F.col(ts)))
    return out.filter(F.col(ts) >= p.min_valid_ms).groupBy(*key).agg(F.min(ts).alias("start_ms"))


def build_peaks(
    detected: DataFrame, added: DataFrame, replacements: DataFrame, starts: DataFrame,
    s: Series = Series(tie="source"), p: Params = DEFAULTS,
) -> DataFrame:
    """Detected, hand-added and interpolated peaks, near copies reduced
    (annotations win), with segment and a dense id per recording in time order."""
    parts = relational.union_tagged(
        {
            "csv": detected.select(*s.key, s.ts, "source", "is_added_peak"),
            "annotation": added.select(*s.key, s.ts, F.lit("added").alias("source"), F.lit(True).alias("is_added_peak")),
            "replacement": replacements.select(*s.key, s.ts, F.lit("detected").alias("source"), F.lit(False).alias("is_added_peak")),
        }
    ).withColumn("priority", F.when(F.col("origin") == "csv", 1).otherwise(0))
    kept = thinning.greedy_clusters(parts, p.dedup_tolerance_ms, ["priority"], s).drop("priority", "origin")
    # numbering reads the peaks twice
    kept = materialise(kept)
    kept = row_index(kept, s, "peak_id").join(per_key(starts), list(s.key))
    return kept.withColumn(
        "segment_idx", F.floor((F.col(s.ts) - F.col("start_ms")) / p.segment_ms).cast("int")
    ).drop("start_ms")


def build_labels(
    peaks: DataFrame, artifacts: DataFrame, interpolated: DataFrame, added: DataFrame, events: DataFrame,
    validated: DataFrame, regions: DataFrame, s: Series = SERIES, p: Params = DEFAULTS, group: Sequence[str] = SEG,
) -> DataFrame:
    """Label by priority artifact > interpolated > missed_original > phys_event
    > clean, with phys_event_window, reviewed and in_bad_region.

    ``artifacts``, ``interpolated`` and ``added`` hold ``ref_ms``; ``events`` and
    ``regions`` hold intervals.

    Beats, references and events stand in one frame, tagged; one prefix pass carries
    the last and next reference of every kind and the furthest end of an event. A
    region counts in its own segment only: a second frame by segment, a minute of
    beats, holds them and serves the join with the validated segments.
    """
    key, ts = list(s.key), F.col(s.ts)
    one = lambda d, tag, at, end: d.select(*key, F.col(at).alias(s.ts), end.cast("long").alias("_end"), F.lit(tag).alias("_tag"))
    none = F.lit(None)
    frame = peaks.select(*key, ts, F.struct(*peaks.columns).alias("_p"), F.lit("peak").alias("_tag"))
    refs = {"art": artifacts, "int": interpolated, "add": added}
    for tag, d in refs.items():
        frame = frame.unionByName(one(d, tag, "ref_ms", none), allowMissingColumns=True)
    frame = frame.unionByName(one(events, "event", "start_ms", F.col("end_ms")), allowMissingColumns=True)
    # at one time, starts and references come before the beats
    frame = frame.withColumn("_kind", (F.col("_tag") == "peak").cast("int"))
    carried = {f"_{tag}_{way}": (way, F.when(F.col("_tag") == tag, ts)) for tag in refs for way in ("last", "next")}
    carried["_reach"] = ("max", F.when(F.col("_tag") == "event", F.col("_end")))
    d = running(frame, carried, s, position=ts, width=s.bucket_ms, order=(s.ts, "_kind")).filter(F.col("_kind") == 1)
    near = lambda tag: F.coalesce(ts - F.col(f"_{tag}_last") <= p.match_tolerance_ms, F.lit(False)) | F.coalesce(F.col(f"_{tag}_next") - ts <= p.match_tolerance_ms, F.lit(False))
    inside = F.coalesce(F.col("_reach") >= ts, F.lit(False)).alias("phys_event_window")
    d = d.select("_p.*", *[near(tag).alias(f"_{tag}") for tag in refs], inside).withColumn("_end", none.cast("long")).withColumn("_kind", F.lit(1))
    spans = regions.select(*group, F.col("start_ms").alias(s.ts), F.col("end_ms").alias("_end"), F.lit(0).alias("_kind"))
    here = Window.partitionBy(*group).orderBy(s.ts, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    d = d.unionByName(spans, allowMissingColumns=True).withColumn("_far", F.max("_end").over(here)).filter(F.col("_kind") == 1)
    d = d.withColumn("in_bad_region", F.coalesce(F.col("_far") >= ts, F.lit(False)))
    ok = validated.select(*group).distinct().withColumn("reviewed", F.lit(True))
    d = d.join(ok, list(group), "left")
    is_added = F.col("_add") | (F.col("is_added_peak") if "is_added_peak" in peaks.columns else F.lit(False))
    return d.select(
        *s.key, s.tie,
        F.when(F.col("_art"), "artifact").when(F.col("_int"), "interpolated").when(is_added, "missed_original")
        .when(F.col("phys_event_window"), "phys_event").otherwise("clean").alias("label"),
        "phys_event_window", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), "in_bad_region",
    )


# ---- annotation documents: one row per recording (or part of one) ----------


def segment_translation(docs: DataFrame, starts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Annotation segment number -> engine segment, by its first time. Of several
    entries for a number the last in the list stays."""
    e = docs.select("recording_id", F.posexplode("segment_timestamps").alias("_at", "t")).select(
        "recording_id", "_at", F.col("t.segment_idx").alias("ann_idx"), iso_ms(F.col("t.first_timestamp")).alias("_ms")
    )
    d = e.filter(F.col("_ms").isNotNull()).join(starts, "recording_id")
    idx = F.floor((F.col("_ms") - F.col("start_ms")) / p.segment_ms).cast("int")
    return d.groupBy("recording_id", "ann_idx").agg(F.max_by(idx, "_at").alias("segment_idx"))


def translate(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """ann_idx -> segment_idx; recordings without any mapping keep their numbers."""
    known = mapping.select("recording_id").distinct().withColumn("_has", F.lit(True))
    d = rows.join(mapping, ["recording_id", "ann_idx"], "left").join(known, "recording_id", "left")
    idx = F.when(F.col("_has"), F.col("segment_idx")).otherwise(F.col("ann_idx"))
    return d.withColumn("segment_idx", idx).filter(F.col("segment_idx").isNotNull()).drop("_has", "ann_idx")


def validated_segments(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    d = docs.select("recording_id", F.explode("validated_segments").alias("_t"))
    return translate(d.select("recording_id", segment_number(F.col("_t")).alias("ann_idx")), mapping).distinct()


def bad_segments(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    a = docs.select("recording_id", F.explode("bad_segments").alias("ann_idx"))
    b = docs.select("recording_id", F.explode("flagged_poor_quality_segments").alias("_t"))
    both = a.unionByName(b.select("recording_id", segment_number(F.col("_t")).alias("ann_idx")))
    return translate(both, mapping).distinct()


def bad_regions(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    d = docs.select("recording_id", F.explode("bad_regions").alias("r")).select(
        "recording_id", F.col("r.segment_idx").alias("ann_idx"),
        iso_ms(F.col("r.start_time")).alias("start_ms"), iso_ms(F.col("r.end_time")).alias("end_ms"),
    )
    return translate(d.filter(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()), mapping)


def event_windows(docs: DataFrame, column: str = "tagged_physiological_events") -> DataFrame:
    """Events given as start/end under several names, or as one time."""
    d = docs.select("recording_id", F.explode(column).alias("e"))
    first = F.coalesce("e.start", "e.start_time", "e.start_timestamp", "e.at")
    last = F.coalesce("e.end", "e.end_time", "e.end_timestamp", "e.at")
    out = d.select("recording_id", any_ms(first).alias("start_ms"), any_ms(last).alias("end_ms"))
    return out.filter(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull())


def consolidate(
    items: DataFrame, spans: DataFrame, validated: DataFrame, bad: DataFrame, revisit: DataFrame, regions: DataFrame,
    region_lists: Sequence[str] = ("artifacts",), s: Series = Series(tie="item_id"),
) -> DataFrame:
    """``reason`` why an annotation is dropped, or ``keep``.

    ``items``: list name and time; ``spans``: annotation segments with times.
    Only ``region_lists`` are checked against bad regions, in the item's own
    segment and its neighbours.
    """
    d = temporal.interval_lookup(items, spans, "ann_idx", s=s)
    d = temporal.in_scoped_ranges(d, regions, reach=1, s=s, name="_region")
    for name, side in (("_val", validated), ("_bad", bad), ("_rev", revisit)):
        mark = side.select("recording_id", "ann_idx").distinct().withColumn(name, F.lit(True))
        d = d.join(mark, ["recording_id", "ann_idx"], "left")
    reason = (
        F.when(F.col("_val").isNull(), "not_validated")
        .when(F.col("_bad"), "in_bad_seg")
        .when(F.col("_rev"), "in_revisit")
        .when(F.col("_region") & F.col("list_name").isin(*region_lists), "in_bad_region")
        .otherwise("keep")
    )
    return d.withColumn("reason", reason).select(*items.columns, "ann_idx", "reason")


def consolidation_counts(d: DataFrame) -> DataFrame:
    return d.groupBy("list_name", "reason").agg(F.count(F.lit(1)).alias("n"))
