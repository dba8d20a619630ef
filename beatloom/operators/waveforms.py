"""Beat windows and their shape, quality and similarity features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from beatloom.functions import arrays as A
from beatloom.functions.signal import butter_bandpass, filter_once, filter_zero_phase, welch
from beatloom.operators import aggregates
from beatloom.operators.sampleindex import locate, sample_index
from beatloom.operators.windows import fill_with_group_median, rr_legacy, rr_local_stage, rr_second_stage, rr_stage
from beatloom.params import DEFAULTS, SERIES, Params, Series
from beatloom.plans.ordered import over_rows

SEG = ["recording_id", "segment_idx"]
SPAN = 8  # segments in one call of Python


def extract_windows(
    beats: DataFrame,
    samples: DataFrame,
    length: int = DEFAULTS.qrs_window,
    snap: int = DEFAULTS.snap_samples,
    s: Series = SERIES,
    value: str = "ecg",
    idx: str = "sample_idx",
) -> DataFrame:
    """``waveform``: ``length`` samples around the sample nearest to the beat,
    moved to the largest magnitude within ``snap`` samples (0: not moved), zeros
    beyond the recording; ``centre_idx`` is the sample index used."""
    index = sample_index(samples, [value], length // 2 + 1 + snap, s, idx)
    j = locate(beats, index, s)
    at = A.snap(F.col(f"_v_{value}"), F.col("_at"), snap) if snap else F.col("_at")
    j = j.withColumn("_at", at)
    return j.select(
        *beats.columns,
        (F.col("_first") + F.col("_at")).alias("centre_idx"),
        A.padded_window(F.col(f"_v_{value}"), F.col("_at"), length).alias("waveform"),
    )


def window_stats(df: DataFrame, w: str = "waveform") -> DataFrame:
    a = F.col(w)
    return df.withColumns(
        {
            "window_mean": A.mean(a),
            "window_std": A.sd(a),
            "window_ptp": F.array_max(a) - F.array_min(a),
            "window_min": F.array_min(a),
            "window_max": F.array_max(a),
        }
    )


def signal_quality(
    df: DataFrame, w: str = "waveform", zcr_steps: int = 63, centre: int = 32, energy: tuple[int, int] = (24, 40)
) -> DataFrame:
    """Label-free quality of each window. The step count, centre and energy
    range are fixed positions of the feature definition and are arguments."""
    d = df.withColumn("_c", A.centred(F.col(w))).withColumn("_s", F.array_sort(w)).withColumn(
        "_abs", F.array_sort(F.transform(w, F.abs))
    )
    a, c = F.col(w), F.col("_c")
    n = F.size(a)
    m2 = A.sum_squares(c) / n
    m4 = F.aggregate(c, F.lit(0.0), lambda t, x: t + x * x * x * x) / n
    up = F.transform(c, lambda x: F.when(x >= 0, 1).otherwise(0))
    flips = F.aggregate(
        F.zip_with(F.slice(up, F.lit(2), n - 1), F.slice(up, F.lit(1), n - 1), lambda x, y: F.abs(x - y)),
        F.lit(0),
        lambda t, x: t + x,
    )
    half = (n - 1) / F.lit(2.0)
    xs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i - half)
    return d.withColumns(
        {
            "window_iqr": A.quantile(F.col("_s"), 0.75) - A.quantile(F.col("_s"), 0.25),
            "window_kurtosis": F.when(F.sqrt(m2) < 1e-6, F.lit(0.0)).otherwise(m4 / (m2 * m2) - 3),
            "window_zcr": flips / F.lit(float(zcr_steps)),
            "r_peak_snr": F.abs(F.element_at(a, centre + 1)) / (A.quantile(F.col("_abs"), 0.5) + 1e-9),
            "window_hf_noise_rms": F.sqrt(A.sum_squares(A.diffs(a)) / (n - 1)),
            "window_wander_slope": A.dot(c, xs) / A.sum_squares(xs),
            "window_energy_ratio": A.sum_squares(F.slice(a, energy[0] + 1, energy[1] - energy[0]))
            / (A.sum_squares(a) + 1e-9),
        }
    ).drop("_c", "_s", "_abs")


def neighbour_similarity_stage(d: DataFrame, win: WindowSpec, w: str = "waveform") -> DataFrame:
    """Correlation with the previous and the next window, 0 at the ends."""
    return d.withColumns(
        {
            "qrs_corr_prev": A.pearson(F.col(w), F.lag(w).over(win)),
            "qrs_corr_next": A.pearson(F.col(w), F.lead(w).over(win)),
        }
    )


def neighbour_similarity(df: DataFrame, w: str = "waveform", s: Series = SERIES) -> DataFrame:
    return over_rows(df, 1, 1, lambda d, win: neighbour_similarity_stage(d, win, w), s)


def template_similarity(df: DataFrame, templates: DataFrame, group: Sequence[str] = (), w: str = "waveform", name: str = "qrs_corr_to_template") -> DataFrame:
    """Correlation with the group's template, or with the only one there is."""
    t = templates.select(*group, F.col("template").alias("_t"))
    return aggregates.by(df, t, group, "left").withColumn(name, A.pearson(F.col(w), F.col("_t"))).drop("_t")


def nearest_centroid(df: DataFrame, centroids: DataFrame, vector: Column | str, prefix: str) -> DataFrame:
    """Index, label and Euclidean distance of the nearest centroid (lowest index
    on ties). ``centroids``: idx, label, centroid - a handful of rows."""
    v = F.col(vector) if isinstance(vector, str) else vector
    one = centroids.agg(F.sort_array(F.collect_list(F.struct("idx", "label", "centroid"))).alias("_cs"))
    d = df.withColumn("_v", v).crossJoin(F.broadcast(one))
    best = F.array_min(
        F.transform("_cs", lambda c: F.struct(A.euclid(F.col("_v"), c["centroid"]).alias("d"), c["idx"].alias("i"), c["label"].alias("l")))
    )
    return d.withColumn("_b", best).select(
        *df.columns,
        F.col("_b.d").alias(f"dist_to_nearest_{prefix}_motif"),
        F.col("_b.i").alias(f"nearest_{prefix}_motif_idx"),
        F.col("_b.l").alias(f"nearest_{prefix}_motif_label"),
    )


def anomaly(df: DataFrame, distance: str, prefix: str, label: str = "label", limit: float = 2.0) -> DataFrame:
    """Distance over the mean distance of clean beats, flagged above ``limit``."""
    m = df.agg(
        F.greatest(
            F.coalesce(F.avg(F.when(F.col(label) == "clean", F.col(distance))), F.avg(distance)), F.lit(1e-8)
        ).alias("_m")
    )
    d = df.crossJoin(F.broadcast(m)).withColumn(f"{prefix}_anomaly_score", F.col(distance) / F.col("_m"))
    return d.withColumn(f"is_{prefix}_anomaly", F.col(f"{prefix}_anomaly_score") > limit).drop("_m")


# ---- segments: groups bounded by their duration ----------------------------


def amplitude_stats(samples: DataFrame, value: str = "ecg", group: Sequence[str] = SEG) -> DataFrame:
    v = F.col(value)
    q = samples.groupBy(*group).agg(
        F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.percentile(F.abs(v), 0.95).alias("ecg_p95"),
        F.percentile(v, F.array(F.lit(0.01), F.lit(0.99))).alias("_r"),
        F.count(v).alias("_n"),
        F.stddev_pop(v).alias("_sd"),
    )
    over = samples.join(q.select(*group, "ecg_p95"), list(group)).groupBy(*group).agg(
        F.avg((F.abs(v) > 0.95 * F.col("ecg_p95")).cast("double")).alias("_over")
    )
    return q.join(over, list(group)).select(
        *group,
        F.col("_q")[1].alias("ecg_median"),
        (F.col("_q")[2] - F.col("_q")[0]).alias("ecg_iqr"),
        "ecg_p95",
        F.when(F.col("ecg_p95") > 0, F.col("_over")).otherwise(F.lit(0.0)).alias("ecg_saturation_fraction"),
        (F.col("_r")[1] - F.col("_r")[0]).alias("segment_amplitude_range"),
    )


def flatline_share(
    samples: DataFrame, value: str = "ecg", group: Sequence[str] = SEG, idx: str = "sample_idx",
    rate: int = DEFAULTS.sample_rate_hz, floor: float = 10.0, relative: float = 0.05,
) -> DataFrame:
    """Share of the full one-second blocks whose sd is below
    max(floor, relative * sd of the segment)."""
    seg = samples.groupBy(*group).agg(F.min(idx).alias("_i0"), F.stddev_pop(value).alias("_sd"))
    d = samples.join(seg, list(group)).withColumn("_b", F.floor((F.col(idx) - F.col("_i0")) / rate))
    b = d.groupBy(*group, "_b").agg(F.stddev_pop(value).alias("_s"), F.count(F.lit(1)).alias("_n"), F.max("_sd").alias("_sd"))
    limit = F.greatest(F.lit(floor), relative * F.col("_sd"))
    return b.filter(F.col("_n") == rate).groupBy(*group).agg(
        F.avg((F.col("_s") < limit).cast("double")).alias("segment_flatline_fraction")
    )


def qrs_density(beats: DataFrame, group: Sequence[str] = SEG, segment_s: float = 60.0, bpm: float = DEFAULTS.hr_modal_low_bpm) -> DataFrame:
    expected = segment_s * bpm / 60.0
    return beats.groupBy(*group).agg((F.count(F.lit(1)) / F.lit(expected)).alias("segment_qrs_density"))


def spectral_quality(
    samples: DataFrame, value: str = "ecg", group: Sequence[str] = SEG, order_by: str = "sample_idx",
    rate: int = DEFAULTS.sample_rate_hz,
) -> DataFrame:
    """Zero-crossing rate of the band-passed signal and entropy of its power
    spectrum; one segment (a minute of samples) per call."""
    types = {f.name: f.dataType.simpleString() for f in samples.schema}
    group = list(group)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order_by)[value].to_numpy(float)
        zcr = ent = None
        if len(x) >= 4:
            up = filter_once(x, butter_bandpass(4, 3.0, 40.0, rate)) >= 0
            zcr = float(np.mean(up[1:] != up[:-1]))
            _, p = welch(x, rate, 256)
            p = p[p > 0] / p.sum() if p.sum() > 0 else np.array([1.0])
            ent = float(-(p * np.log2(p)).sum()) + 0.0
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in group}, "segment_zcr": [zcr], "segment_spectral_entropy": [ent]})

    schema = ", ".join([*(f"{g} {types[g]}" for g in group), "segment_zcr double", "segment_spectral_entropy double"])
    return samples.select(*group, order_by, value).groupBy(*group).applyInPandas(run, schema)


def morphology_consistency(df: DataFrame, w: str = "waveform", group: Sequence[str] = SEG, s: Series = SERIES) -> DataFrame:
    """Mean correlation of consecutive windows that are not hard filtered."""
    win = Window.partitionBy(*group).orderBy(s.ts, s.tie)
    d = df.filter(~F.col("hard_filtered")).withColumn("_p", F.lag(w).over(win))
    return d.groupBy(*group).agg(
        F.avg(F.when(F.col("_p").isNotNull(), A.pearson(F.col(w), F.col("_p")))).alias("sqi_qrs")
    )


def segment_hrv(df: DataFrame, group: Sequence[str] = SEG, rr: str = "rr_prev_ms", s: Series = SERIES, min_beats: int = 5) -> DataFrame:
    """Interval statistics and roughness of the beats that are not hard
    filtered; fractions, not percent."""
    win = Window.partitionBy(*group).orderBy(s.ts, s.tie)
    ok = df.filter(~F.col("hard_filtered") & F.col(rr).isNotNull()).withColumn("_d", F.col(rr) - F.lag(rr).over(win))
    x, d = F.col(rr), F.col("_d")
    share = lambda t: F.count_if(F.abs(d) > t) / F.count(d)
    g = ok.groupBy(*group).agg(
        F.count(F.lit(1)).cast("int").alias("beat_count"),
        F.avg(x).alias("mean_nn"), F.stddev_samp(x).alias("sd_nn"), F.sqrt(F.avg(d * d)).alias("rmssd"),
        share(50).alias("pnn50_fraction"), share(20).alias("pnn20_fraction"),
        F.min(x).alias("min_nn"), F.max(x).alias("max_nn"),
        (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("iqr_nn"),
        share(100).alias("rr_roughness_100"), share(200).alias("rr_roughness_200"), share(300).alias("rr_roughness_300"),
    )
    need = {c: min_beats for c in ("mean_nn", "sd_nn", "rmssd", "pnn50_fraction", "pnn20_fraction", "min_nn", "max_nn", "iqr_nn")}
    need |= {f"rr_roughness_{t}": 2 for t in (100, 200, 300)}
    return g.withColumns({c: F.when(F.col("beat_count") >= k, F.col(c)) for c, k in need.items()})


def segment_matrix(beats: DataFrame, samples: DataFrame, group: Sequence[str] = SEG) -> DataFrame:
    """All segment features for every segment that has beats or samples.

    ``beats``: rr_prev_ms, hard_filtered, review_priority_score and waveform.
    """
    g = list(group)
    suspicious = beats.groupBy(*g).agg(
        F.avg((F.coalesce("review_priority_score", F.lit(0.0)) > 0).cast("double")).alias("suspicious_beat_fraction")
    )
    parts = [
        segment_hrv(beats, g), suspicious, morphology_consistency(beats, group=g), qrs_density(beats, g),
        amplitude_stats(samples, group=g), flatline_share(samples, group=g), spectral_quality(samples, group=g),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, g, "full")
    return out.withColumn("beat_count", F.coalesce("beat_count", F.lit(0)))


def beat_matrix(beats: DataFrame, flags: Sequence[str] = (), p: Params = DEFAULTS, s: Series = SERIES, min_template_beats: int = 3) -> DataFrame:
    """All beat features. ``beats``: time, index, segment, label, hard_filtered,
    waveform and, where present, the physiological flags.

    Interval and neighbour features share one shuffle; segment context comes
    back by segment key; missing values end as 0.
    """

    def rows(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = rr_local_stage(rr_second_stage(rr_stage(d, w, s), w), w)
        return neighbour_similarity_stage(d, w)

    d = signal_quality(window_stats(over_rows(beats, 5, 5, rows, s)))
    sd = aggregates.segment_rr_sd(d, SEG)
    clean = (F.col("label") == "clean") & ~F.col("hard_filtered")
    tpl = aggregates.mean_template(beats, SEG, clean, min_beats=min_template_beats)
    d = d.join(sd, SEG, "left")
    d = template_similarity(d, tpl, SEG)
    d = fill_with_group_median(d, ["rr_prev_ms", "rr_next_ms"], SEG, list(s.key))
    d = rr_legacy(d)
    keys = [*s.key, s.tie, "segment_idx"]
    have = {c for c, _ in beats.dtypes}
    features = [c for c, t in d.dtypes if t in ("double", "float", "int", "bigint") and c not in (*keys, s.ts, s.idx, *flags)]
    return d.select(
        *keys,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features],
        *[(F.coalesce(F.col(f).cast("int"), F.lit(0)) if f in have else F.lit(0)).alias(f) for f in flags],
    )


def resampled_windows(
    beats: DataFrame, samples: DataFrame, length: int = 130, step_ms: float = 7.0, half_ms: float | None = None,
    s: Series = SERIES, value: str = "ecg", band: tuple[float, float] | None = (3.0, 40.0), rate: int = DEFAULTS.sample_rate_hz,
) -> DataFrame:
    """``waveform``: ``length`` points every ``step_ms`` from t - half, linear in
    between samples of the beat's segment, 0 outside, then band-passed.

    A call takes ``SPAN`` segments, minutes of samples with their beats. The filter is
    linear, padding included, and windows have one length: it is one matrix.
    """
    half = length / 2 * step_ms if half_ms is None else half_ms
    grid = np.arange(length) * step_ms - half
    response = filter_zero_phase(np.eye(length), butter_bandpass(4, *band, rate), 27) if band else None
    types = {f.name: f.dataType.simpleString() for f in beats.schema}
    seg = SEG[-1]

    def run(b: pa.Table, smp: pa.Table) -> pa.Table:
        b = b.sort_by(seg)
        smp = smp.sort_by([(seg, "ascending"), (s.ts, "ascending")])
        # a call has no segment at all, or all have one
        of, at = b[seg].fill_null(0).to_numpy(), b[s.ts].to_numpy().astype(float)[:, None] + grid
        own, t, v = smp[seg].fill_null(0).to_numpy(), smp[s.ts].to_numpy().astype(float), smp[value].to_numpy().astype(float)
        rows = np.zeros(at.shape)
        for i in np.unique(of):
            x, y = slice(*np.searchsorted(of, (i, i + 1))), slice(*np.searchsorted(own, (i, i + 1)))
            if y.stop > y.start:
                rows[x] = np.interp(at[x], t[y], v[y], left=0.0, right=0.0)
        if response is not None:
            rows = rows @ response
        ends = np.arange(len(rows) + 1, dtype="int32") * length
        return b.select([*SEG, s.tie]).append_column("waveform", pa.ListArray.from_arrays(ends, rows.ravel()))

    schema = ", ".join([*(f"{k} {types[k]}" for k in (*SEG, s.tie)), "waveform array<double>"])
    span = F.floor(F.col(seg) / SPAN)
    return (
        beats.select(*SEG, s.tie, s.ts).groupBy(SEG[0], span)
        .cogroup(samples.select(*SEG, s.ts, value).groupBy(SEG[0], span))
        .applyInArrow(run, schema)
    )


def stored_context_windows(df: DataFrame, length: int, snap: int, context: str = "context", centre: str = "centre_idx") -> DataFrame:
    """Window from a stored context array around its centre, moved to the
    largest magnitude within ``snap``."""
    at = A.snap(F.col(context), F.col(centre), snap)
    return df.withColumn("_at", at).withColumn("waveform", A.padded_window(F.col(context), F.col("_at"), length)).drop("_at")
