"""Pauses, respiratory rhythm, R-peak detection and change points."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.functions.signal import butter_bandpass, filter_zero_phase, local_maxima
from beatloom.operators import thinning
from beatloom.operators.windows import centred_baseline_stage, trailing_baseline_stage, usable_sessions
from beatloom.params import DEFAULTS, SERIES, Params, Series
from beatloom.plans.ordered import _HOME, _SLOT, _with_halo, over_rows, running
from beatloom.session import materialise


def vagal_arrests(sessions: DataFrame, s: Series = SERIES, p: Params = DEFAULTS) -> DataFrame:
    """Single long pauses against the trailing baseline, and how many beats the
    return to baseline takes. Input: output of ``sessions``."""

    def build(d, w):
        d = trailing_baseline_stage(d, w, p)
        ahead = F.collect_list(F.struct(F.col("rr_ms").alias("rr"), F.col("is_boundary").alias("b")))
        return d.withColumn("_next", ahead.over(w.rowsBetween(1, p.arrest_recovery_beats)))

    d = over_rows(sessions, p.arrest_baseline_beats + 5, p.arrest_recovery_beats, build, s)
    d = d.filter(
        ~F.col("is_boundary")
        & (F.col("rr_ms") >= p.arrest_pause_ms)
        & (F.col("pause_ratio") >= p.arrest_ratio)
        & (F.col("baseline_ms") <= p.arrest_max_baseline_ms)
        & (F.coalesce(F.col("pre_max_ratio"), F.lit(0.0)) <= p.arrest_pre_ratio)
    )
    limit = F.col("baseline_ms") * (1 + p.arrest_recovery_margin)
    start = F.struct(F.lit(False).alias("done"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("ms"))

    def step(a, x):
        take = ~a["done"] & ~x["b"] & x["rr"].isNotNull()
        return F.struct(
            (a["done"] | x["b"] | x["rr"].isNull() | (x["rr"] <= limit)).alias("done"),
            (a["n"] + F.when(take, 1).otherwise(0)).alias("n"),
            (a["ms"] + F.when(take, x["rr"]).otherwise(F.lit(0))).cast("long").alias("ms"),
        )

    d = d.withColumn("_r", F.aggregate("_next", start, step))
    return d.select(
        *s.key, F.col(s.tie).alias("onset_peak_id"), F.col(s.ts).alias("onset_timestamp_ms"), "rr_ms",
        F.col("baseline_ms").alias("local_baseline_ms"), "pause_ratio",
        F.col("_r.n").alias("recovery_beats"), F.col("_r.ms").alias("recovery_duration_ms"),
    )


def rsa_extrema(sessions: DataFrame, s: Series = SERIES, p: Params = DEFAULTS) -> DataFrame:
    """Local maxima ("slow") and minima ("fast") of the smoothed deviation.

    Runs of equal values become one row first, so a plateau counts once, at its
    middle, exactly as a single top would.
    """
    half = p.rsa_baseline_beats // 2 + 2
    base = usable_sessions(over_rows(sessions, half, half, lambda d, w: centred_baseline_stage(d, w, s, p), s), s, p)
    x = "deviation_smooth"
    marked = over_rows(
        base, 1, 0,
        lambda d, w: d.withColumn(
            "_new",
            ~F.coalesce((F.lag(x).over(w) == F.col(x)) & (F.lag("session_id").over(w) == F.col("session_id")), F.lit(False)),
        ),
        s,
    )
    # narrow rows, written once: the running number reads them twice
    marked = materialise(marked.select(*s.key, "session_id", s.idx, x, "_new"))
    runs = running(marked, {"_run": ("sum", F.col("_new").cast("long"))}, s)
    runs = runs.groupBy(*s.key, "session_id", "_run").agg(
        F.first(x).alias("v"), F.min(s.idx).alias("_a"), F.max(s.idx).alias("_b")
    )
    r = Series(key=s.key, ts="_run", tie="_run", idx="_run", bucket_rows=s.bucket_rows)

    def build(d, w):
        same = F.col("session_id")
        prev = F.when(F.lag("session_id").over(w) == same, F.lag("v").over(w))
        nxt = F.when(F.lead("session_id").over(w) == same, F.lead("v").over(w))
        v = F.col("v")
        height = p.rsa_amplitude_ms * 0.4
        kind = F.when((v > prev) & (v > nxt) & (v >= height), "slow").when(
            (v < prev) & (v < nxt) & (-v >= height), "fast"
        )
        return d.withColumn("kind", kind)

    ext = over_rows(runs, 1, 1, build, r).filter(F.col("kind").isNotNull())
    ext = ext.select(
        *s.key, "session_id", F.floor((F.col("_a") + F.col("_b")) / 2).cast("long").alias(s.idx), "kind",
        F.abs("v").alias("amplitude"),
    )
    at = sessions.select(*s.key, s.idx, s.tie, s.ts)
    return ext.join(at, [*s.key, s.idx])


def rsa_events(sessions: DataFrame, s: Series = SERIES, p: Params = DEFAULTS) -> DataFrame:
    """Alternating runs of slow and fast extrema. A run breaks on a repeated
    kind, a half period out of range or a small pair: all of them properties of
    two neighbouring extrema, so runs are islands of the extrema sequence."""
    from beatloom.plans.ordered import row_index

    ext = materialise(rsa_extrema(sessions, s, p))
    k = F.count_if(F.col("kind") == "slow"), F.count_if(F.col("kind") == "fast")
    enough = ext.groupBy(*s.key, "session_id").agg(k[0].alias("_s"), k[1].alias("_f")).filter(
        (F.col("_s") >= p.rsa_cycles) & (F.col("_f") >= p.rsa_cycles)
    )
    ext = ext.join(enough.select(*s.key, "session_id"), [*s.key, "session_id"], "left_semi")
    e = Series(key=s.key, ts=s.ts, tie=s.tie, idx="_e", bucket_rows=s.bucket_rows, bucket_ms=s.bucket_ms)
    ext = row_index(ext, e)

    def build(d, w):
        pair = (F.lag("amplitude").over(w) + F.col("amplitude")) / 2
        period = F.col(s.idx) - F.lag(s.idx).over(w)
        cont = (
            (F.lag("session_id").over(w) == F.col("session_id"))
            & (F.lag("kind").over(w) != F.col("kind"))
            & period.between(p.rsa_min_half, p.rsa_max_half)
            & (pair >= p.rsa_amplitude_ms * 0.4)
        )
        cont = F.coalesce(cont, F.lit(False))
        return d.withColumns({"_opens": ~cont, "_pair": F.when(cont, pair)})

    ext = running(over_rows(ext, 1, 0, build, e), {"_island": ("sum", F.col("_opens").cast("long"))}, e)
    ev = ext.groupBy(*s.key, "session_id", "_island").agg(
        F.min_by(s.tie, s.idx).alias("start_peak_id"), F.max_by(s.tie, s.idx).alias("end_peak_id"),
        F.min(s.ts).alias("start_ms"), F.max(s.ts).alias("end_ms"),
        (F.max(s.idx) - F.min(s.idx) + 1).alias("beat_count"),
        (F.count(F.lit(1)) - 1).alias("_half"),
        F.avg("_pair").alias("mean_amplitude_ms"), F.max("_pair").alias("max_amplitude_ms"),
    )
    ev = ev.withColumn("n_cycles", F.floor(F.col("_half") / 2).cast("long"))
    ev = ev.filter((F.col("n_cycles") >= p.rsa_cycles) & (F.col("mean_amplitude_ms") >= p.rsa_amplitude_ms / 2))
    return ev.select(
        *s.key, "start_peak_id", "end_peak_id", "start_ms", "end_ms",
        ((F.col("end_ms") - F.col("start_ms")) / 1000).alias("duration_s"), "beat_count", "n_cycles",
        "mean_amplitude_ms", "max_amplitude_ms",
        ((F.col("beat_count") - 1) / F.col("_half")).alias("mean_half_period_beats"),
    )


# ---- R-peak detection on bounded chunks ------------------------------------

# Scaling filter of the Daubechies wavelet with four vanishing moments.
DB4 = (
    0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
    -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278,
)


def _snap(peaks: np.ndarray, x: np.ndarray, radius: int) -> np.ndarray:
    near = np.clip(peaks[:, None] + np.arange(-radius, radius + 1), 0, len(x) - 1)
    return near[np.arange(len(peaks)), np.abs(x[near]).argmax(axis=1)] if len(peaks) else peaks


def energy_peaks(x: np.ndarray, fs: float, refractory_ms: float = 250.0) -> np.ndarray:
    """Band-pass, slope, square, 150 ms mean, 70th percentile, snap to extremum."""
    e = np.gradient(filter_zero_phase(x, butter_bandpass(2, 5.0, 18.0, fs))) ** 2
    n = max(1, int(0.150 * fs))
    e = np.convolve(e, np.ones(n) / n, mode="same")
    at = local_maxima(e, float(np.percentile(e, 70)), max(1, int(refractory_ms / 1000 * fs)))
    return _snap(at, x, max(1, int(0.060 * fs)))


def wavelet_peaks(x: np.ndarray, fs: float, refractory_ms: float = 250.0) -> np.ndarray:
    """Energy of undecimated wavelet details at levels 2 and 3, 75th percentile."""
    low = np.array(DB4)
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    a = filter_zero_phase(x, butter_bandpass(2, 5.0, 18.0, fs))
    energy = np.zeros(len(a))
    for level in range(3):
        lo, hi = (np.zeros((len(low) - 1) * 2**level + 1) for _ in range(2))
        lo[:: 2**level], hi[:: 2**level] = low, high
        if level:
            energy += np.convolve(a, hi, mode="same")[: len(a)] ** 2
        a = np.convolve(a, lo, mode="same")[: len(a)]
    at = local_maxima(energy, float(np.percentile(energy, 75)), max(1, int(refractory_ms / 1000 * fs)))
    return _snap(at, x, max(1, int(0.060 * fs)))


DETECTORS = {"energy": energy_peaks, "wavelet": wavelet_peaks}


def detect_peaks(
    samples: DataFrame, method: str | Sequence[str], fs: float = DEFAULTS.sample_rate_hz, chunk_minutes: float = 5.0,
    overlap_s: float = 5.0, s: Series = SERIES, value: str = "ecg", idx: str = "sample_idx",
) -> DataFrame:
    """R-peak times of one detector, or of several that read the samples once. A chunk of ``chunk_minutes`` plus an overlap
    on both sides is one task's input; peaks in the overlap are left to the
    neighbour."""
    width, halo = int(chunk_minutes * 60 * fs), int(overlap_s * fs)
    methods = [method] if isinstance(method, str) else list(method)
    d = samples.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*s.key, s.ts, idx, value)
    d = _with_halo(d, F.col(idx), width, halo, halo)
    types = {f.name: f.dataType.simpleString() for f in d.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        x = pdf[value].to_numpy(float)
        found = []
        for m in methods:
            at = DETECTORS[m](x, fs) if len(x) >= int(0.5 * fs) else np.array([], dtype=int)
            hit = pdf.iloc[np.unique(at)]
            hit = hit[hit[_HOME] == hit[_SLOT]]
            found.append(hit[[*s.key, s.ts]].assign(source=m))
        return pd.concat(found)

    schema = ", ".join([*(f"{k} {types[k]}" for k in (*s.key, s.ts)), "source string"])
    return d.groupBy(*s.key, _SLOT).applyInPandas(run, schema)


def detect_ensemble(samples: DataFrame, s: Series = SERIES, p: Params = DEFAULTS, **options) -> DataFrame:
    """Union of both detectors with the merge tolerance, then the refractory rule."""
    e = Series(key=s.key, ts=s.ts, tie="source", bucket_ms=s.bucket_ms)
    # peaks are few beside samples: written once, so no detector runs twice
    peaks = materialise(detect_peaks(samples, list(DETECTORS), s=s, **options))
    a, b = (peaks.filter(F.col("source") == m) for m in DETECTORS)
    merged = materialise(thinning.union_detections(a, b, p.merge_tolerance_ms, e))
    return thinning.refractory(merged, p.refractory_ms, e)


# ---- change points ----------------------------------------------------------


def _median_distance(x: np.ndarray) -> float:
    """Median of all pairwise |xi - xj|, by bisection on sorted values: n log n,
    no pair is ever stored."""
    v = np.sort(x)
    pairs = len(v) * (len(v) - 1) // 2
    lo, hi = 0.0, float(v[-1] - v[0])
    for _ in range(80):
        mid = (lo + hi) / 2
        below = (np.searchsorted(v, v + mid, side="right") - np.arange(len(v)) - 1).sum()
        lo, hi = (lo, mid) if 2 * below >= pairs else (mid, hi)
    return hi


def kernel_change_points(x: np.ndarray, penalty: float, min_size: int = 2, jump: int = 5) -> list[int]:
    """Penalised optimal segmentation with a Gaussian kernel cost; breaks lie on
    multiples of ``jump``. One kernel column at a time, so memory is linear."""
    n = len(x)
    med = _median_distance(x) ** 2 if n > 1 else 0.0
    gamma = 1.0 / med if med > 0 else 1.0
    ends = sorted({*range(jump, n, jump), n})
    inner = np.zeros(n + 1)  # kernel sum of [start, t) per start
    best = {0: (0.0, 0)}
    starts = [0]
    for t in range(1, n + 1):
        col = np.exp(-np.clip(gamma * (x[: t - 1] - x[t - 1]) ** 2, 1e-2, 1e2))
        inner[: t - 1] += 2 * np.cumsum(col[::-1])[::-1]
        inner[:t] += 1
        if t not in ends:
            continue
        ok = [a for a in starts if t - a >= min_size]
        if not ok:
            continue
        cost = np.array([best[a][0] + (t - a) - inner[a] / (t - a) + penalty for a in ok])
        i = int(cost.argmin())
        best[t] = (float(cost[i]), ok[i])
        starts = [a for a, c in zip(ok, cost, strict=True) if c <= cost[i] + penalty] + [
            a for a in starts if t - a < min_size
        ] + [t]
    out, t = [], n
    while t in best and t > 0:
        t = best[t][1]
        if t:
            out.append(t)
    return out[::-1]


def change_points(
    df: DataFrame, group: Sequence[str], ts: str, value: str, penalty: float = 10.0
) -> DataFrame:
    """Change times of a metric per group. The input is a window-metric table:
    one row per hour (8 760 a year), so a group stays small."""
    group = list(group)
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        x = pdf[value].interpolate().to_numpy(float)
        keep = np.isfinite(x)
        pdf, x = pdf[keep], x[keep]
        at = kernel_change_points((x - x.mean()) / (x.std() or 1.0), penalty) if len(x) else []
        hit = pdf.iloc[at]
        return hit[[*group, ts]].assign(position=np.array(at, dtype="int64"))

    schema = ", ".join([*(f"{g} {types[g]}" for g in group), f"{ts} {types[ts]}", "position long"])
    return df.select(*group, ts, value).groupBy(*group).applyInPandas(run, schema)
