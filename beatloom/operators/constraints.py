"""Hard filters, soft flags and the review priority of beats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from beatloom.operators.windows import hr_stage, rr_stage, smooth_hr_stage
from beatloom.params import DEFAULTS, PRIORITY_WEIGHTS, SERIES, Params, Series
from beatloom.plans.ordered import over_rows, over_time, row_index


def arrival_disorder(df: DataFrame, arrival: str, s: Series = SERIES) -> DataFrame:
    """out_of_sequence: earlier in time than the row that arrived just before."""
    a = Series(key=s.key, ts=arrival, tie=s.tie, idx="_arrival_idx", bucket_ms=s.bucket_rows)
    return over_rows(
        row_index(df, a),
        1,
        0,
        lambda d, w: d.withColumn(
            "out_of_sequence", F.coalesce(F.col(s.ts) < F.lag(s.ts).over(w), F.lit(False))
        ),
        a,
    ).drop("_arrival_idx")


def hard_filter_stage(d: DataFrame, w: WindowSpec, p: Params = DEFAULTS) -> DataFrame:
    """hard_filtered and its first reason; needs rr_*_ms; reach two rows."""
    prev, nxt = F.col("rr_prev_ms"), F.col("rr_next_ms")
    before, after = F.lag("rr_prev_ms").over(w), F.lead("rr_next_ms").over(w)
    disorder = F.col("out_of_sequence") if "out_of_sequence" in d.columns else F.lit(False)
    sandwich = (
        (prev < p.rr_sandwich_ms)
        & (nxt > p.rr_sandwich_ms)
        & before.between(p.rr_normal_low_ms, p.rr_normal_high_ms)
        & after.between(p.rr_normal_low_ms, p.rr_normal_high_ms)
    )
    d = d.withColumn(
        "hard_filter_reason",
        F.when(prev <= 0, "rr_zero_or_negative")
        .when(disorder, "timestamp_out_of_sequence")
        .when(sandwich, "isolated_impossible_sandwich"),
    )
    return d.withColumn("hard_filtered", F.col("hard_filter_reason").isNotNull())


def hard_filters(df: DataFrame, s: Series = SERIES, p: Params = DEFAULTS) -> DataFrame:
    return over_rows(df, 2, 2, lambda d, w: hard_filter_stage(rr_stage(d, w, s), w, p), s)


def _near_flag(flag: str, w: WindowSpec, pad_ms: int) -> Column:
    """True within +-pad of a flagged beat. Padded runs of flagged beats cover
    the same beats, because no beat lies between two neighbours of a run."""
    return F.max(F.col(flag)).over(w.rangeBetween(-pad_ms, pad_ms))


def transition_stage(d: DataFrame, w: WindowSpec, p: Params = DEFAULTS) -> DataFrame:
    """Both transition flags; needs hr_smooth and phys_event_window."""
    floor = F.min("hr_smooth").over(w.rangeBetween(1 - p.tachy_lookback_ms, 0))
    d = d.withColumn("hr_floor", floor).withColumn(
        "tachy_onset", F.coalesce(F.col("hr_smooth") - F.col("hr_floor") >= p.tachy_rise_bpm, F.lit(False))
    )
    return d.withColumns(
        {
            "tachy_transition_candidate": _near_flag("tachy_onset", w, p.transition_pad_ms),
            "pots_transition_candidate": _near_flag("phys_event_window", w, p.transition_pad_ms),
        }
    )


def hr_rise(df: DataFrame, s: Series = SERIES, p: Params = DEFAULTS) -> DataFrame:
    """hr_smooth, its rolling floor and both transition flags."""

    def rows(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = hr_stage(rr_stage(d, w, s), w)
        return smooth_hr_stage(d, w, p.tachy_smooth_beats)

    staged = over_rows(df, p.tachy_smooth_beats + 2, 2, rows, s)
    return over_time(
        staged,
        p.tachy_lookback_ms + p.transition_pad_ms,
        p.transition_pad_ms,
        lambda d, w: transition_stage(d, w, p),
        s,
    )


def soft_flags(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Suspicious-value flags and the priority score from per-beat columns."""
    rr, hr, ok = F.col("rr_prev_ms"), F.col("hr_instantaneous_bpm"), ~F.col("hard_filtered")

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False))

    out = df.withColumns(
        {
            "rr_suspicious_short": flag(ok & (rr < p.rr_short_ms)),
            "rr_suspicious_long": flag(ok & (rr > p.rr_long_ms)),
            "hr_suspicious_low": flag(ok & (hr < p.hr_low_bpm)),
            "hr_suspicious_high": flag(ok & (hr > p.hr_high_bpm)),
            "in_modal_hr_range": flag(hr.between(p.hr_modal_low_bpm, p.hr_modal_high_bpm)),
        }
    ).withColumn(
        "physio_implausible",
        flag(
            ok
            & (F.col("hr_change_rate_bpm_per_sec") > p.max_hr_rate)
            & ~F.col("pots_transition_candidate")
            & ~F.col("tachy_transition_candidate")
            & ~F.col("rr_suspicious_short")
        ),
    )
    return out.withColumn("review_priority_score", review_priority(PRIORITY_WEIGHTS))


def review_priority(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name).cast("double") * weight
    return total


def soft_features(df: DataFrame, s: Series = SERIES, p: Params = DEFAULTS) -> DataFrame:
    """Labels enriched with hard filters, intervals, flags and priority.

    Two shuffles: row buckets for everything counted in beats, time buckets for
    the 60 s floor and the +-20 s windows.
    """

    def rows(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = hard_filter_stage(rr_stage(d, w, s), w, p)
        return smooth_hr_stage(hr_stage(d, w), w, p.tachy_smooth_beats)

    staged = over_rows(df, p.tachy_smooth_beats + 2, 2, rows, s)
    timed = over_time(
        staged,
        p.tachy_lookback_ms + p.transition_pad_ms,
        p.transition_pad_ms,
        lambda d, w: transition_stage(d, w, p),
        s,
    )
    return soft_flags(timed, p).drop("hr_smooth", "hr_floor", "tachy_onset")


FLAG_COLUMNS = (
    "hard_filtered",
    "rr_suspicious_short",
    "rr_suspicious_long",
    "hr_suspicious_low",
    "hr_suspicious_high",
    "in_modal_hr_range",
    "pots_transition_candidate",
    "tachy_transition_candidate",
    "physio_implausible",
)
