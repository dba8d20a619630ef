"""Grouped statistics over beats, segments, labels and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.params import DEFAULTS, SERIES, Params, Series
from beatloom.plans.quantiles import exact_quantiles

SEG = ("recording_id", "segment_idx")


def by(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``; without keys ``other`` is a single row."""
    return df.join(other, list(keys), how) if keys else df.crossJoin(F.broadcast(other))


def segment_beat_stats(df: DataFrame, group: Sequence[str] = SEG, label: str = "label") -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_beats"),
        F.count_if(F.col(label) == "artifact").alias("artifact_beats"),
        F.count_if(F.col(label) == "clean").alias("clean_beats"),
    )


def segment_ranges(df: DataFrame, group: Sequence[str] = SEG, ts: str = "timestamp_ms") -> DataFrame:
    return df.groupBy(*group).agg(
        F.min(ts).alias("start_timestamp_ms"), F.max(ts).alias("end_timestamp_ms")
    )


def segment_rr_sd(df: DataFrame, group: Sequence[str] = SEG, rr: str = "rr_prev_ms") -> DataFrame:
    return df.groupBy(*group).agg(F.coalesce(F.stddev_samp(rr), F.lit(0.0)).alias("segment_rr_sd"))


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the median of every column, 0 where all values are missing."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "_column", "_value")
    med = exact_quantiles(long, "_value", {"_median": 0.5}, ["_column"])
    return med.agg(*[F.coalesce(F.max(F.when(F.col("_column") == c, F.col("_median"))), F.lit(0.0)).alias(c) for c in columns])


def mean_template(
    df: DataFrame,
    group: Sequence[str],
    where: Column,
    waveform: str = "waveform",
    min_beats: int = 3,
) -> DataFrame:
    """Element-wise mean of the qualifying windows per group, or over all groups
    where a group has fewer than ``min_beats`` of them."""
    own = template(df.filter(where), group, waveform)
    overall = template(df.filter(where), (), waveform).select(F.col("template").alias("_all"))
    groups = df.select(*group).distinct().join(own, list(group), "left").crossJoin(F.broadcast(overall))
    enough = F.coalesce(F.col("n_beats"), F.lit(0)) >= min_beats
    return groups.select(
        *group,
        F.coalesce("n_beats", F.lit(0)).alias("n_beats"),
        F.when(enough, F.col("template")).otherwise(F.col("_all")).alias("template"),
    )


def template(df: DataFrame, group: Sequence[str], waveform: str = "waveform") -> DataFrame:
    """Element-wise mean array and the number of windows.

    Positions are aggregated separately (partial sums per task), so a group of
    any size only meets as one number per position.
    """
    cells = (
        df.select(*group, F.posexplode(waveform).alias("_pos", "_x"))
        .groupBy(*group, "_pos")
        .agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    )
    return cells.groupBy(*group).agg(
        F.max("_n").alias("n_beats"),
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_m"))), lambda c: c["_m"]).alias("template"),
    )


def label_counts(df: DataFrame, group: Sequence[str], label: str = "label") -> DataFrame:
    """Map label -> count per group (an iteration, a table)."""
    c = df.groupBy(*group, label).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*group).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label), F.col("_n"))))).alias("counts"),
        F.sum("_n").alias("n_total"),
    )


def value_shares(df: DataFrame, label: str) -> DataFrame:
    """Count and percentage per label; the total is one broadcast row."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("_t"))
    return c.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def flag_summary(df: DataFrame, flags: Sequence[str], score: str) -> DataFrame:
    """True-count of each flag, non-zero scores and score quantiles, one row."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_beats"),
        *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags],
        F.count_if(F.col(score) != 0).alias("n_nonzero"),
        F.avg(score).alias("score_mean"),
        F.max(score).alias("score_max"),
    )
    q = exact_quantiles(df, score, {"score_p50": 0.5, "score_p95": 0.95, "score_p99": 0.99})
    return counts.crossJoin(F.broadcast(q))


def describe_metrics(df: DataFrame, metrics: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """count, mean, sd, min, quartiles, max, variance, median and the smallest
    most frequent value, one row per metric."""
    long = df.unpivot(list(group), list(metrics), "metric", "v").filter(F.col("v").isNotNull())
    key = [*group, "metric"]
    base = long.groupBy(*key).agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.var_samp("v").alias("variance"),
    )
    q = exact_quantiles(long, "v", {"p25": 0.25, "median": 0.5, "p75": 0.75}, key)
    modes = (
        long.groupBy(*key, "v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*key)
        .agg(F.max_by("v", F.struct(F.col("_n"), -F.col("v"))).alias("mode"))
    )
    return base.join(q, key).join(modes, key)


def summary_statistics(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd (ddof 0), min, max and p5..p95."""
    base = df.groupBy(*group).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = exact_quantiles(df, value, {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}, group)
    return by(base, q, group)


def shared_axis_histogram(
    df: DataFrame, value: str, group: str, bins: int, lo: float, hi: float, clip: bool = False
) -> DataFrame:
    """Counts per group on equal-width bins between the overall ``lo`` and
    ``hi`` quantiles, the last bin closed. Without ``clip`` values outside are
    left out and counts are also divided by the group's largest; with it they
    move to the edge and a density is added."""
    ends = exact_quantiles(df, value, {"_lo": lo, "_hi": hi})
    v, a, b = F.col(value), F.col("_lo"), F.col("_hi")
    d = df.select(group, value).crossJoin(F.broadcast(ends))
    d = d.withColumn(value, F.least(F.greatest(v, a), b)) if clip else d.filter(v.between(a, b))
    width = (b - a) / bins
    d = d.withColumn("bin", F.least(F.floor((v - a) / width), F.lit(bins - 1)).cast("int"))
    counts = d.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("_w"))
    totals = counts.groupBy(group).agg(F.max("n").alias("_max"), F.sum("n").alias("_sum"))
    out = counts.join(totals, group)
    if clip:
        return out.select(group, "bin", "n", (F.col("n") / (F.col("_sum") * F.col("_w"))).alias("density"))
    return out.select(group, "bin", "n", (F.col("n") / F.col("_max")).alias("relative"))


def medians_and_shares(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Median of each feature, count and share per category."""
    out = value_shares(df, group)
    for f in features:
        out = out.join(exact_quantiles(df, f, {f"median_{f}": 0.5}, [group]), group, "left")
    return out


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence[str]) -> DataFrame:
    """Counts of a fixed column vocabulary per row value, zeros filled."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(cols) == v).alias(f"n_{v}") for v in values])


WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def hour_by_weekday(df: DataFrame, ts_ms: str, value: str) -> DataFrame:
    t = F.timestamp_millis(F.col(ts_ms))
    d = df.select(F.hour(t).alias("hour"), F.date_format(t, "EEEE").alias("_day"), F.col(value).alias("_v"))
    return d.groupBy("hour").agg(
        *[F.avg(F.when(F.col("_day") == day, F.col("_v"))).alias(day.lower()) for day in WEEKDAYS]
    )


def resample(df: DataFrame, ts_ms: str, step_ms: int, values: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Mean of each value per step of the epoch clock; empty steps are absent."""
    step = (F.floor(F.col(ts_ms) / step_ms) * step_ms).alias("step_ms")
    return df.groupBy(*group, step).agg(*[F.avg(v).alias(v) for v in values])


def resample_spine(df: DataFrame, keys: list[str], ts: str, step_ms: int) -> DataFrame:
    """Every step between the first and last one per key; empty steps are null."""
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    # in two steps: no row holds more than a part of the spine, however far apart the ends
    part = F.lit(step_ms * 4096)
    parts = ends.select(*keys, "_b", F.explode(F.sequence("_a", "_b", part)).alias("_p"))
    spine = parts.select(*keys, F.explode(F.sequence("_p", F.least("_b", F.col("_p") + part - step_ms), F.lit(step_ms))).alias(ts))
    return spine.join(df, [*keys, ts], "left")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson of every pair (lower triangle) over rows where both are present,
    in one aggregation pass, as (a, b, r)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    both = [F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]
    wide = df.agg(*both)
    return wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r"))
                    for a, b in pairs
                ]
            )
        ).alias("_p")
    ).select("_p.*")


def relative_shares(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.withColumns({f"{p}_share": F.when(total != 0, F.col(p) * 100.0 / total) for p in parts})


def event_calendar(df: DataFrame, ts_ms: str) -> DataFrame:
    """Totals of an event list: days, most per segment and per day, median and
    largest month, in one row."""
    t = F.timestamp_millis(F.col(ts_ms))
    daily = df.groupBy(F.to_date(t).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    monthly = daily.groupBy(F.date_trunc("month", F.col("d")).alias("m")).agg(F.sum("n").alias("n"))
    segs = df.groupBy(*SEG).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_per_segment"))
    return (
        daily.agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_days"), F.max("n").alias("max_per_day"))
        .crossJoin(F.broadcast(segs))
        .crossJoin(
            F.broadcast(
                monthly.agg(F.percentile("n", 0.5).alias("median_per_month"), F.max("n").alias("max_per_month"))
            )
        )
    )


def polarity_vote(
    df: DataFrame,
    value: str = "ecg",
    threshold: float = -100.0,
    step: int = 10,
    per_window: int = 13,
    min_windows: int = 5,
    s: Series = SERIES,
) -> DataFrame:
    """Per recording: median over windows of the value with the largest
    magnitude (first on ties), read from every ``step``-th row, and whether the
    signal should be inverted."""
    thin = df.filter((F.col(s.idx) + 1) % step == 0).withColumn("_r", F.floor(F.col(s.idx) / step))
    w = thin.withColumn("_w", F.floor(F.col("_r") / per_window))
    dom = (
        w.groupBy(*s.key, "_w")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max_by(value, F.struct(F.abs(F.col(value)), -F.col("_r"))).alias("_dom"),
        )
        .filter(F.col("_n") == per_window)
    )
    n = dom.groupBy(*s.key).agg(F.count(F.lit(1)).alias("n_windows"))
    med = exact_quantiles(dom, "_dom", {"dominant_median": 0.5}, list(s.key))
    return n.join(med, list(s.key)).withColumn(
        "invert", (F.col("n_windows") >= min_windows) & (F.col("dominant_median") < threshold)
    )


def class_imbalance(df: DataFrame, truth: str = "truth") -> DataFrame:
    """Negatives per positive, 1 without positives."""
    return df.agg(
        F.count_if(F.col(truth) == 1).alias("n_pos"), F.count_if(F.col(truth) == 0).alias("n_neg")
    ).withColumn(
        "pos_weight", F.when(F.col("n_pos") > 0, F.col("n_neg") / F.col("n_pos")).otherwise(F.lit(1.0))
    )


def score_totals(df: DataFrame, score: str) -> DataFrame:
    x = F.col(score)
    return df.agg(
        F.count(score).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.sum(x * x).alias("sum_sq"),
    )


def build_segments(
    ranges: DataFrame, stats: DataFrame, bad: DataFrame, validated: DataFrame, group: Sequence[str] = SEG,
    p: Params = DEFAULTS,
) -> DataFrame:
    """Quality label per segment of the signal from beat counts and the sets of
    segments marked bad or validated."""
    g = list(group)
    d = (
        ranges.join(stats, g, "left")
        .join(bad.select(*g).distinct().withColumn("_bad", F.lit(True)), g, "left")
        .join(validated.select(*g).distinct().withColumn("_ok", F.lit(True)), g, "left")
    )
    total, art, clean = (F.coalesce(F.col(c), F.lit(0)) for c in ("total_beats", "artifact_beats", "clean_beats"))
    share = F.when(total > 0, art / total).otherwise(F.lit(0.0))
    return d.select(
        *ranges.columns,
        F.when(F.coalesce("_bad", F.lit(False)) | (share > p.bad_artifact_share), "bad")
        .when(art > 0, "noisy_ok")
        .when(F.coalesce("_ok", F.lit(False)), F.when(clean >= p.min_clean_beats, "clean").otherwise("noisy_ok"))
        .otherwise("unknown")
        .alias("quality_label"),
    )
