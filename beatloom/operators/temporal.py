"""Joins between time series: tolerance, as-of, containment, context.

None of them compares all pairs. Tolerance joins put both sides in one frame
with a halo of the tolerance; as-of and containment carry the last seen value
over buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.params import DEFAULTS, SERIES, Series
from beatloom.plans.ordered import over_time, running


def _stack(points: DataFrame, others: DataFrame, s: Series, ts: str, payload: Sequence[str]) -> DataFrame:
    """Both sides in one frame; rows of ``others`` carry ``_o`` and no ``_p``."""
    left = points.select(
        *s.key, F.col(s.ts), F.struct(*points.columns).alias("_p"), F.lit(1).alias("_kind")
    )
    right = others.select(
        *s.key, F.col(ts).alias(s.ts), F.struct(F.col(ts).alias("t"), *payload).alias("_o"), F.lit(0).alias("_kind")
    )
    return left.unionByName(right, allowMissingColumns=True)


def _points(d: DataFrame, *extra: str) -> DataFrame:
    return d.filter(F.col("_kind") == 1).select("_p.*", *extra)


def match_within(
    points: DataFrame, refs: DataFrame, tolerance_ms: int, ref_ts: str, s: Series = SERIES, name: str = "matched"
) -> DataFrame:
    """``name``: some reference lies within the tolerance (inclusive)."""
    is_ref = F.col("_kind") == 0

    def build(d, w):
        near = F.max(F.when(is_ref, True)).over(w.rangeBetween(-tolerance_ms, tolerance_ms))
        return d.withColumn(name, F.coalesce(near, F.lit(False)))

    return _points(over_time(_stack(points, refs, s, ref_ts, ()), tolerance_ms, tolerance_ms, build, s), name)


def nearest_within(
    points: DataFrame,
    refs: DataFrame,
    tolerance_ms: int,
    ref_ts: str,
    payload: Sequence[str] = (),
    s: Series = SERIES,
    name: str = "nearest",
) -> DataFrame:
    """``name``: struct(t, *payload) of the nearest reference within the
    tolerance, else null; the later one wins at equal distance."""
    o = F.when(F.col("_kind") == 0, F.col("_o"))

    def build(d, w):
        return d.withColumns(
            {
                "_before": F.max(o).over(w.rangeBetween(-tolerance_ms, 0)),
                "_after": F.min(o).over(w.rangeBetween(0, tolerance_ms)),
            }
        )

    d = over_time(_stack(points, refs, s, ref_ts, payload), tolerance_ms, tolerance_ms, build, s)
    return _points(d.withColumn(name, _closer(F.col("_before"), F.col("_after"), F.col(s.ts), "later")), name)


def _closer(before: Column, after: Column, ts: Column, tie: str) -> Column:
    to_before, to_after = ts - before["t"], after["t"] - ts
    take_after = to_after <= to_before if tie == "later" else to_after < to_before
    return F.when(before.isNull() | F.coalesce(take_after, F.lit(False)), after).otherwise(before)


def asof_nearest(
    points: DataFrame,
    samples: DataFrame,
    payload: Sequence[str],
    sample_ts: str = "timestamp_ms",
    s: Series = SERIES,
    tie: str = "later",
    name: str = "nearest",
) -> DataFrame:
    """``name``: struct(t, *payload) of the nearest sample at any distance."""
    o = F.when(F.col("_kind") == 0, F.col("_o"))
    d = running(
        _stack(points, samples, s, sample_ts, payload),
        {"_before": ("last", o), "_after": ("next", o)},
        s,
        position=F.col(s.ts),
        width=s.bucket_ms,
        order=(s.ts, "_kind"),
    ).filter(F.col("_kind") == 1)
    return _points(d.withColumn(name, _closer(F.col("_before"), F.col("_after"), F.col(s.ts), tie)), name)


def in_intervals(
    points: DataFrame,
    spans: DataFrame,
    start: str = "start_ms",
    end: str = "end_ms",
    s: Series = SERIES,
    name: str = "inside",
) -> DataFrame:
    """``name``: the point lies in some interval, both ends included.

    A point is covered exactly when the latest end among the intervals that
    start no later than the point reaches it, so a running maximum answers it
    for overlapping and nested intervals alike.
    """
    d = running(
        _stack(points, spans, s, start, [end]),
        {"_reach": ("max", F.col(f"_o.{end}"))},
        s,
        position=F.col(s.ts),
        width=s.bucket_ms,
        order=(s.ts, "_kind"),
    )
    return _points(d.withColumn(name, F.coalesce(F.col("_reach") >= F.col(s.ts), F.lit(False))), name)


def interval_lookup(
    points: DataFrame,
    spans: DataFrame,
    payload: str,
    start: str = "start_ms",
    end: str = "end_ms",
    s: Series = SERIES,
    default_ms: int = DEFAULTS.segment_ms,
) -> DataFrame:
    """``payload`` of the latest-starting interval if it contains the point; a
    missing end means ``default_ms`` after the start."""
    spans = spans.withColumn(end, F.coalesce(F.col(end), F.col(start) + default_ms))
    d = running(
        _stack(points, spans, s, start, [end, payload]),
        {"_seen": ("last", F.when(F.col("_kind") == 0, F.col("_o")))},
        s,
        position=F.col(s.ts),
        width=s.bucket_ms,
        order=(s.ts, "_kind"),
    )
    hit = F.when(F.col(s.ts) <= F.col("_seen")[end], F.col("_seen")[payload])
    return _points(d.withColumn(payload, hit), payload)


def in_scoped_ranges(
    points: DataFrame,
    ranges: DataFrame,
    scope: str = "segment_idx",
    reach: int = 0,
    start: str = "start_ms",
    end: str = "end_ms",
    s: Series = SERIES,
    name: str = "in_range",
) -> DataFrame:
    """As ``in_intervals`` for ranges that only count inside their own segment,
    or also in ``reach`` segments to each side."""
    if reach:
        ranges = ranges.withColumn(scope, F.explode(F.sequence(F.col(scope) - reach, F.col(scope) + reach)))
    scoped = Series(key=(*s.key, scope), ts=s.ts, tie=s.tie, idx=s.idx, bucket_ms=s.bucket_ms)
    return in_intervals(points, ranges, start, end, scoped, name)


def nearest_by_radius(
    markers: DataFrame,
    spans: DataFrame,
    radii_ms: Sequence[int],
    marker_id: str,
    marker_ts: str,
    span_id: str,
    start: str = "start_ms",
    end: str = "end_ms",
    key: Sequence[str] = ("recording_id",),
) -> DataFrame:
    """The first radius at which some interval meets [m - r, m + r], and the
    interval of that radius whose midpoint is nearest (lowest id on ties).

    Buckets of the widest radius keep it an equi-join: a marker meets only
    intervals of its own and the two next buckets.
    """
    width = max(radii_ms)
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    m = markers.withColumn("_cell", F.explode(F.sequence(cell(F.col(marker_ts)) - 1, cell(F.col(marker_ts)) + 1)))
    # a span covers each of its cells; the pair is formed only in the first shared one
    sp = spans.withColumn("_first", cell(F.col(start))).withColumn(
        "_cell", F.explode(F.sequence(F.col("_first"), cell(F.col(end))))
    )
    j = m.join(sp, [*key, "_cell"]).filter(
        F.col("_cell") == F.greatest(F.col("_first"), cell(F.col(marker_ts)) - 1)
    )
    ts = F.col(marker_ts)
    need = F.greatest(F.lit(0), F.col(start) - ts, ts - F.col(end))
    radius = F.array_min(F.filter(F.array(*[F.lit(r) for r in radii_ms]), lambda r: r >= need))
    dist = F.abs(F.floor((F.col(start) + F.col(end)) / 2).cast("long") - ts)
    best = F.min(F.struct(radius.alias("radius_ms"), dist.alias("dist_ms"), F.col(span_id)))
    hits = j.filter(need <= width).groupBy(*key, marker_id).agg(best.alias("_b"))
    return markers.join(hits, [*key, marker_id], "left").select(*markers.columns, "_b.*")


def context_windows(
    candidates: DataFrame,
    samples: DataFrame,
    half_ms: int,
    s: Series = SERIES,
    value: str = "ecg",
    scope: str = "segment_idx",
) -> DataFrame:
    """Samples of the same segment within +-half_ms as ordered arrays, and the
    0-based index of the nearest one (first on ties).

    The output size is candidates times window length; candidates are few (a
    review queue) and meet only the samples of their own segment, a minute.
    """
    key = [*s.key, scope]
    c = candidates.select(*key, s.tie, F.col(s.ts).alias("_c"))
    near = samples.select(*key, F.col(s.ts).alias("_t"), F.col(value).alias("_v")).join(
        c, key
    ).filter(F.abs(F.col("_t") - F.col("_c")) <= half_ms)
    ctx = near.groupBy(*s.key, s.tie).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))).alias("_ctx"),
        F.min(F.abs(F.col("_t") - F.col("_c"))).alias("_d"),
    )
    out = candidates.join(ctx, [*s.key, s.tie], "left")
    return out.select(
        *candidates.columns,
        F.col("_ctx.v").alias("context"),
        F.col("_ctx.t").alias("context_ms"),
        (
            F.array_position(F.transform("_ctx.t", lambda t: F.abs(t - F.col(s.ts))), F.col("_d")) - 1
        ).cast("int").alias("centre_idx"),
    )


def snap_context(df: DataFrame, radius: int = 5, margin: int = 5, absolute: bool = False) -> DataFrame:
    """Move centre_idx to the largest value (signed, or of |v|) within
    ``radius`` samples; at_edge if it then lies within ``margin`` of an end."""
    c, n = F.col("centre_idx"), F.size("context")
    lo = F.greatest(F.lit(0), c - radius)
    hi = F.least(n - 1, c + radius)
    part = F.slice(F.col("context"), lo + 1, hi - lo + 1)
    if absolute:
        part = F.transform(part, F.abs)
    snapped = (lo + F.array_position(part, F.array_max(part)) - 1).cast("int")
    return df.withColumn("snapped_idx", snapped).withColumn(
        "at_edge", (F.col("snapped_idx") < margin) | (F.col("snapped_idx") > n - 1 - margin)
    )
