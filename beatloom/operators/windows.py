"""Per-beat interval and heart-rate columns.

The ``*_stage`` functions take ``(frame, window)`` and are meant to be chained
inside one ``over_rows`` call, so that one shuffle serves all of them.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from beatloom.params import DEFAULTS, SERIES, Params, Series
from beatloom.plans.ordered import over_rows, over_time, running


def _ratio(a: str, b: str) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.when(F.coalesce(F.col(b), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))


def rr_stage(d: DataFrame, w: WindowSpec, s: Series = SERIES, max_gap_ms: int | None = None) -> DataFrame:
    """rr_prev_ms, rr_next_ms, rr_delta_ms; reach one row to each side."""
    ts = F.col(s.ts)
    prev, nxt = ts - F.lag(ts).over(w), F.lead(ts).over(w) - ts
    if max_gap_ms is not None:
        prev, nxt = F.when(prev <= max_gap_ms, prev), F.when(nxt <= max_gap_ms, nxt)
    return d.withColumns({"rr_prev_ms": prev, "rr_next_ms": nxt}).withColumn(
        "rr_delta_ms", F.abs(F.col("rr_prev_ms") - F.col("rr_next_ms"))
    )


def rr_second_stage(d: DataFrame, w: WindowSpec) -> DataFrame:
    """The interval one further back / ahead and its absolute change; reach two."""
    return d.withColumns(
        {"rr_prev_2": F.lag("rr_prev_ms").over(w), "rr_next_2": F.lead("rr_next_ms").over(w)}
    ).withColumns(
        {
            "rr_abs_delta_prev": F.abs(F.col("rr_prev_ms") - F.col("rr_prev_2")),
            "rr_abs_delta_next": F.abs(F.col("rr_next_ms") - F.col("rr_next_2")),
            "rr_delta_ratio_next": _ratio("rr_prev_ms", "rr_next_ms"),
        }
    )


def rr_local_stage(d: DataFrame, w: WindowSpec) -> DataFrame:
    """Mean and sd (ddof 0) of the four intervals i-2..i+1; an interval beyond
    the end of the series repeats the end value. A series of fewer than five
    beats uses all its intervals, and a frame of +-4 rows sees all of those."""
    p1, p2, n1, n2 = (F.col(c) for c in ("rr_prev_ms", "rr_prev_2", "rr_next_ms", "rr_next_2"))
    four = F.array(
        F.coalesce(p2, p1, n1), F.coalesce(p1, n1), F.coalesce(n1, p1), F.coalesce(n2, n1, p1)
    ).cast("array<double>")
    near = w.rowsBetween(-4, 4)
    d = d.withColumns(
        {
            "_four": four,
            "_seen": F.count(F.lit(1)).over(near),
            "_all_mean": F.avg("rr_prev_ms").over(near),
            "_all_sd": F.stddev_pop("rr_prev_ms").over(near),
        }
    ).withColumn("_mean", F.aggregate("_four", F.lit(0.0), lambda a, x: a + x) / 4)
    sd = F.sqrt(F.aggregate("_four", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / 4)
    full = F.col("_seen") >= 5
    return d.withColumns(
        {
            "rr_local_mean_5": F.when(full, F.col("_mean")).otherwise(F.col("_all_mean")),
            "rr_local_sd_5": F.when(full, sd).otherwise(F.col("_all_sd")),
        }
    ).drop("_four", "_seen", "_all_mean", "_all_sd", "_mean")


def hr_stage(d: DataFrame, w: WindowSpec) -> DataFrame:
    """Instantaneous heart rate and its rate of change; reach two rows back."""
    d = d.withColumn(
        "hr_instantaneous_bpm", F.when(F.col("rr_prev_ms") > 0, F.lit(60000.0) / F.col("rr_prev_ms"))
    )
    step = F.abs(F.col("hr_instantaneous_bpm") - F.lag("hr_instantaneous_bpm").over(w))
    return d.withColumn(
        "hr_change_rate_bpm_per_sec",
        F.when(F.col("rr_prev_ms") > 0, step / (F.col("rr_prev_ms") / F.lit(1000.0))),
    )


def rr_intervals(df: DataFrame, s: Series = SERIES, max_gap_ms: int | None = None) -> DataFrame:
    return over_rows(df, 1, 1, lambda d, w: rr_stage(d, w, s, max_gap_ms), s)


def rr_extended(df: DataFrame, s: Series = SERIES) -> DataFrame:
    """All interval features of a beat in one shuffle."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return rr_local_stage(rr_second_stage(rr_stage(d, w, s), w), w)

    return over_rows(df, 5, 5, build, s)


def rr_legacy(df: DataFrame) -> DataFrame:
    """Ratio, difference and mean of the two neighbouring intervals."""
    p, n = F.col("rr_prev_ms"), F.col("rr_next_ms")
    return df.withColumns(
        {"rr_ratio": _ratio("rr_prev_ms", "rr_next_ms"), "rr_diff": p - n, "rr_mean": (p + n) / 2}
    )


def heart_rate(df: DataFrame, s: Series = SERIES) -> DataFrame:
    return over_rows(df, 3, 1, lambda d, w: hr_stage(rr_stage(d, w, s), w), s)


def smooth_hr_stage(d: DataFrame, w: WindowSpec, beats: int = DEFAULTS.tachy_smooth_beats) -> DataFrame:
    """Mean heart rate of the last ``beats`` beats, missing ones skipped."""
    return d.withColumn("hr_smooth", F.avg("hr_instantaneous_bpm").over(w.rowsBetween(1 - beats, 0)))


def fill_with_group_median(
    df: DataFrame, columns: list[str], group: list[str], overall: list[str]
) -> DataFrame:
    """Missing values become the median of their segment, else of ``overall``
    (the recording), else 0.

    Segments are bounded by their duration. The overall median runs on counts
    per distinct value, so its state grows with the value range, not the rows.
    """
    seg = df.groupBy(*group).agg(*[F.percentile(c, 0.5).alias(f"_seg_{c}") for c in columns])
    out = df.join(seg, group, "left")
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(*overall, c).agg(F.count(F.lit(1)).alias("_n"))
        med = counts.groupBy(*overall).agg(F.percentile(c, 0.5, F.col("_n")).alias(f"_all_{c}"))
        # without ``overall`` keys this is one row
        out = out.join(med, overall, "left") if overall else out.crossJoin(F.broadcast(med))
    return out.withColumns(
        {
            c: F.coalesce(F.col(c).cast("double"), F.col(f"_seg_{c}"), F.col(f"_all_{c}"), F.lit(0.0))
            for c in columns
        }
    ).drop(*[f"_{k}_{c}" for c in columns for k in ("seg", "all")])


def sessions(df: DataFrame, s: Series = SERIES, p: Params = DEFAULTS, segment: str = "segment_idx") -> DataFrame:
    """is_boundary, rr_ms (null at a boundary) and session_id.

    A boundary is the first beat, a gap above ``session_gap_ms`` or a segment
    number that goes back.
    """

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        gap = F.col(s.ts) - F.lag(s.ts).over(w)
        back = F.col(segment) < F.lag(segment).over(w)
        edge = gap.isNull() | (gap > p.session_gap_ms) | F.coalesce(back, F.lit(False))
        return d.withColumns({"is_boundary": edge, "rr_ms": F.when(~edge, gap)})

    flagged = over_rows(df, 1, 0, build, s)
    return running(flagged, {"session_id": ("sum", F.col("is_boundary").cast("long"))}, s)


def usable_sessions(df: DataFrame, s: Series = SERIES, p: Params = DEFAULTS, min_beats: int | None = None) -> DataFrame:
    """Beats of sessions long enough for the rhythm detector."""
    least = min_beats or p.rsa_min_half * p.rsa_cycles * 2 + p.rsa_baseline_beats
    key = [*s.key, "session_id"]
    long_enough = df.groupBy(*key).count().filter(F.col("count") >= least).select(*key)
    return df.join(long_enough, key, "left_semi")


def trailing_baseline_stage(d: DataFrame, w: WindowSpec, p: Params = DEFAULTS) -> DataFrame:
    """Median of the preceding intervals (current one excluded, three valid ones
    at least), ratio to it, and the largest ratio of the preceding four beats."""
    frame = w.rowsBetween(-p.arrest_baseline_beats, -1)
    base = F.when(F.count("rr_ms").over(frame) >= 3, F.percentile("rr_ms", 0.5).over(frame))
    d = d.withColumn("baseline_ms", base)
    d = d.withColumn("pause_ratio", F.when(F.col("baseline_ms") > 0, F.col("rr_ms") / F.col("baseline_ms")))
    return d.withColumn("pre_max_ratio", F.max("pause_ratio").over(w.rowsBetween(-4, -1)))


def centred_baseline_stage(d: DataFrame, w: WindowSpec, s: Series = SERIES, p: Params = DEFAULTS) -> DataFrame:
    """Deviation from the centred running median, smoothed over three beats of
    the same session (missing -> 0)."""
    half = p.rsa_baseline_beats // 2
    frame = w.rowsBetween(-half, half)
    med = F.when(F.count("rr_ms").over(frame) >= 5, F.percentile("rr_ms", 0.5).over(frame))
    d = d.withColumn("deviation_ms", F.col("rr_ms") - med)
    prev = F.when(F.lag("session_id").over(w) == F.col("session_id"), F.lag("deviation_ms").over(w))
    nxt = F.when(F.lead("session_id").over(w) == F.col("session_id"), F.lead("deviation_ms").over(w))
    near = F.array_compact(F.array(prev, F.col("deviation_ms"), nxt))
    mean = F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size(near)
    return d.withColumn("deviation_smooth", F.when(F.size(near) > 0, mean).otherwise(F.lit(0.0)))


def successive_differences(df: DataFrame, group: list[str], value: str = "rr_ms", s: Series = SERIES) -> DataFrame:
    """rr_diff_ms to the previous non-null value of the same group.

    Null values are skipped, so a difference may join beats around a dropped
    one. ``group`` must be bounded in time (segment or window).
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(s.ts, s.tie)
    return df.filter(F.col(value).isNotNull()).withColumn("rr_diff_ms", F.col(value) - F.lag(value).over(w))


def rr_vectors(df: DataFrame, fill: str | None = None, length: int = 10, s: Series = SERIES) -> DataFrame:
    """Array of ``length`` intervals around each beat, keyed by the beat at
    offset length/2; ``fill='zero'`` pads at the ends, else only full arrays."""
    lead = length // 2

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        if fill == "zero":
            cells = [
                F.coalesce((F.lag if o < 0 else F.lead)("rr_ms", abs(o)).over(w), F.lit(0.0))
                for o in range(-lead, length - lead)
            ]
            return d.withColumn("rr_vector", F.array(*cells))
        return d.withColumn("rr_vector", F.collect_list("rr_ms").over(w.rowsBetween(-lead, length - lead - 1)))

    out = over_rows(df, lead, length - lead, build, s)
    return out if fill == "zero" else out.filter(F.size("rr_vector") == length)


def flag_runs(df: DataFrame, flag: str, pad_ms: int = 0, s: Series = SERIES) -> DataFrame:
    """Contiguous runs of rows with a true flag: first and last time, +- pad."""
    marked = over_rows(
        df.select(*s.key, s.ts, s.idx, flag),
        1,
        0,
        lambda d, w: d.withColumn(
            "_opens", F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))
        ),
        s,
    )
    runs = running(marked, {"run_id": ("sum", F.col("_opens").cast("long"))}, s).filter(flag)
    return runs.groupBy(*s.key, "run_id").agg(
        (F.min(s.ts) - pad_ms).alias("start_ms"),
        (F.max(s.ts) + pad_ms).alias("end_ms"),
        F.count(F.lit(1)).alias("n_beats"),
    )


def rolling_time_mean(df: DataFrame, value: str, span_ms: int, s: Series) -> DataFrame:
    """Mean of the rows in (t - span, t]."""
    return over_time(
        df,
        span_ms,
        0,
        lambda d, w: d.withColumn("rolling_mean", F.avg(value).over(w.rangeBetween(1 - span_ms, 0))),
        s,
    )


def interpolate_gaps(
    df: DataFrame, value: str, s: Series, max_gap_steps: int | None = None, step_ms: int = 3_600_000
) -> DataFrame:
    """Fill missing values linearly in time between the valid neighbours.

    With ``max_gap_steps`` a value is filled only within that many steps of a
    valid neighbour. Ends without a neighbour on one side take the other side's
    value under the same limit when a limit is given, else stay null before the
    first and repeat after the last valid value.
    """
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(s.ts).alias("t"), F.col(value).alias("v")))
    d = running(
        df,
        {"_left": ("last", point), "_right": ("next", point)},
        s,
        position=F.col(s.ts),
        width=s.bucket_ms,
        order=(s.ts,),
    )
    t = F.col(s.ts)
    lt, lv, rt, rv = (F.col(c) for c in ("_left.t", "_left.v", "_right.t", "_right.v"))
    line = F.when(lt == rt, lv).otherwise(lv + (rv - lv) * ((t - lt) / (rt - lt)))
    if max_gap_steps is None:
        filled = F.when(lt.isNotNull() & rt.isNotNull(), line).otherwise(lv)
    else:
        reach = max_gap_steps * step_ms
        near = ((t - lt) <= reach) | ((rt - t) <= reach)
        inner = F.when(F.coalesce(near, F.lit(False)), line)
        filled = (
            F.when(lt.isNotNull() & rt.isNotNull(), inner)
            .when(lt.isNotNull() & ((t - lt) <= reach), lv)
            .when(rt.isNotNull() & ((rt - t) <= reach), rv)
        )
    return d.withColumn(f"{value}_filled", filled).drop("_left", "_right")


def temporal_split(df: DataFrame, keys: list[str], share: float = 0.8) -> DataFrame:
    """is_train for the first ``share`` of the distinct keys in order.

    The rank comes from a prefix over counts of distinct segments, one row per
    segment, never from the rows themselves.
    """
    seg = df.select(*keys).distinct()
    s = Series(key=tuple(keys[:-1]), ts=keys[-1], tie=keys[-1], bucket_ms=4096, idx="_rank")
    from beatloom.plans.ordered import row_index

    ranked = row_index(seg, s)
    sizes = seg.groupBy(*keys[:-1]).agg(F.count(F.lit(1)).alias("_n"))
    ranked = (
        ranked.join(sizes, list(keys[:-1]), "left") if keys[:-1] else ranked.crossJoin(F.broadcast(sizes))
    )
    # integer arithmetic keeps floor(n * share) exact
    part = Fraction(str(share))
    cut = F.greatest(F.lit(1), F.expr(f"_n * {part.numerator}L div {part.denominator}L"))
    side = ranked.select(*keys, (F.col("_rank") < cut).alias("is_train"))
    return df.join(side, keys)
