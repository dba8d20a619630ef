"""NumPy kernels and array expressions against direct definitions."""

import numpy as np
from pyspark.sql import functions as F

from beatloom.functions import arrays as A
from beatloom.functions import complexity, signal
from beatloom.operators import events, hrv, thinning
from beatloom.params import Series


def test_bandpass_gain():
    sos = signal.butter_bandpass(4, 3.0, 40.0, 130)
    h = signal.impulse_response(sos, 2048)
    gain = lambda f: abs((h * np.exp(-2j * np.pi * f / 130 * np.arange(2048))).sum())
    assert abs(gain(3.0) - 2**-0.5) < 1e-3 and abs(gain(40.0) - 2**-0.5) < 1e-3
    assert abs(gain(12.0) - 1) < 2e-2 and gain(0.3) < 1e-3 and gain(64.0) < 1e-3


def test_slow_poles_get_a_long_response():
    sos = signal.butter_bandpass(2, 0.05, 40.0, 130)
    y = signal.filter_once(np.ones(60_000), sos)
    assert abs(y[-1]) < 1e-9  # a constant does not pass
    assert signal.response_length(sos) > 2048


def test_zero_phase_keeps_position():
    x = np.zeros(500)
    x[250] = 1.0
    y = signal.filter_zero_phase(x, signal.butter_bandpass(2, 5.0, 18.0, 130))
    assert y.argmax() == 250 and np.allclose(y[250 - 20 : 250], y[251 : 271][::-1], atol=1e-6)


def test_welch_finds_the_tone():
    t = np.arange(4000) / 4
    f, p = signal.welch(np.sin(2 * np.pi * 0.25 * t), 4.0, 1024)
    assert abs(f[p.argmax()] - 0.25) < 4 / 1024
    assert abs(np.trapezoid(p, f) - 0.5) < 0.02


def test_local_maxima_plateau_and_distance():
    x = np.array([0, 2, 2, 2, 0, 1, 0, 3, 0], float)
    assert signal.local_maxima(x, 0.5, 1).tolist() == [2, 5, 7]
    assert signal.local_maxima(x, 0.5, 3).tolist() == [2, 7]


def test_sample_entropy_brute_force():
    x = np.random.default_rng(0).normal(size=120)
    r, m, n = 0.2 * x.std(), 2, 120
    count = lambda k: sum(
        np.abs(x[i : i + k] - x[j : j + k]).max() < r for i in range(n - m) for j in range(i + 1, n - m))
    assert abs(complexity.sample_entropy(x) + np.log(count(3) / count(2))) < 1e-12


def test_scaling_of_noise_and_walk():
    e = np.random.default_rng(1).normal(size=4000)
    assert abs(complexity.fluctuation_exponent(e) - 0.5) < 0.08
    assert abs(complexity.fluctuation_exponent(np.cumsum(e)) - 1.5) < 0.15


def test_band_powers_of_a_modulated_series():
    t, rr = 0.0, []
    while t < 600:
        v = 800 + 40 * np.sin(2 * np.pi * 0.1 * t)
        rr.append(v)
        t += v / 1000
    b = hrv.band_powers(np.array(rr))
    assert abs(b["lf_peak"] - 0.1) < 0.01 and b["lf"] > 20 * b["hf"]


def test_change_point_of_a_step():
    x = np.concatenate([np.zeros(40), np.ones(40)]) + np.random.default_rng(2).normal(0, 0.05, 80)
    assert events.kernel_change_points((x - x.mean()) / x.std(), 3.0) == [40]


def test_median_distance():
    x = np.random.default_rng(3).normal(size=60)
    d = [abs(a - b) for i, a in enumerate(x) for b in x[i + 1 :]]
    lo = np.sort(d)[(len(d) - 1) // 2]
    assert abs(events._median_distance(x) - lo) < 1e-9


def test_detectors_find_spikes(spark):
    fs, n = 130, 130 * 40
    x = np.random.default_rng(4).normal(0, 3, n)
    at = np.arange(60, n - 60, 104)
    for d, v in ((-1, 300), (0, 1000), (1, 300)):
        x[at + d] += v
    for fn in (events.energy_peaks, events.wavelet_peaks):
        found = fn(x, fs)
        assert all(np.abs(found - a).min() <= 2 for a in at[2:-2])
    rows = [(0, int(i), int(i * 1000 / fs), float(v)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "recording_id int, sample_idx long, timestamp_ms long, ecg double")
    # short chunks with overlap give the peaks of the whole signal
    got = events.detect_ensemble(d, Series(), chunk_minutes=0.2, overlap_s=3.0)
    times = np.array(sorted(r.timestamp_ms for r in got.collect()))
    assert all(np.abs(times - a * 1000 / fs).min() <= 20 for a in at[2:-2])
    assert np.diff(times).min() >= 225


def test_array_expressions(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=65), rng.normal(size=65)
    d = spark.createDataFrame([(a.tolist(), b.tolist(), [1.0] * 65)], "a array<double>, b array<double>, c array<double>")
    r = d.select(
        A.pearson(F.col("a"), F.col("b")).alias("r"), A.pearson(F.col("a"), F.col("c")).alias("flat"),
        A.sd(F.col("a")).alias("sd"), A.quantile(F.array_sort("a"), 0.95).alias("q"), A.zscore(F.col("a")).alias("z"),
        A.snap(F.col("a"), F.lit(3), 8).alias("snap"), A.padded_window(F.col("a"), F.lit(1), 7).alias("w")).first()
    assert abs(r.r - np.corrcoef(a, b)[0, 1]) < 1e-12 and r.flat == 0.0
    assert abs(r.sd - a.std()) < 1e-12 and abs(r.q - np.percentile(a, 95)) < 1e-12
    assert np.allclose(r.z, (a - a.mean()) / (a.std() + 1e-8))
    assert r.snap == np.abs(a[:12]).argmax() and np.allclose(r.w, [0, 0, *a[:5]])


def test_geometric_against_numpy(spark):
    rr = np.round(np.random.default_rng(6).normal(800, 60, 400)).astype(float)
    ts = np.cumsum(rr).astype(int)
    d = spark.createDataFrame([(0, int(t), float(v), i) for i, (t, v) in enumerate(zip(ts, rr, strict=True))], "recording_id int, timestamp_ms long, rr_ms double, rr_idx long")
    frames = {"X": (10_000_000, 10)}
    g = hrv.geometric(d, frames).first()
    h, edges = np.histogram(rr, bins="auto")
    top = np.flatnonzero(h >= h.max() / 2)
    assert abs(g.hti - len(rr) / h.max()) < 1e-9
    assert abs(g.tinn - (edges[top[-1] + 1] - edges[top[0]])) < 1e-6
    h50, _ = np.histogram(rr, bins=np.arange(rr.min(), rr.max() + 50, 50))
    assert abs(g.amo50 - h50.max() / len(rr) * 100) < 1e-9
    m = hrv.moments(d, frames).first()
    assert abs(m.rmssd - np.sqrt(np.mean(np.diff(rr) ** 2))) < 1e-9 and abs(m.sdnn - rr.std(ddof=1)) < 1e-9


def test_local_maxima_near_each_other_by_brute_force():
    rng = np.random.default_rng(8)
    for distance in (1, 2, 7, 40):
        x = rng.integers(0, 50, 600).astype(float)
        all_, keep = signal.local_maxima(x, 20.0, 1), []
        for j in sorted(range(len(all_)), key=lambda j: (x[all_[j]], j), reverse=True):
            if all(abs(all_[j] - i) >= distance for i in keep):
                keep.append(all_[j])
        assert signal.local_maxima(x, 20.0, distance).tolist() == sorted(keep)


def test_detectors_read_the_samples_once(spark, monkeypatch):
    x = np.random.default_rng(4).normal(0, 3, 4000)
    x[60:-60:104] += 1000
    rows = [(0, i, int(i * 1000 / 130), float(v)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "recording_id int, sample_idx long, timestamp_ms long, ecg double")
    calls, one = [], events.detect_peaks
    apart = sorted(r for m in events.DETECTORS for r in one(d, m).collect())
    assert sorted(one(d, list(events.DETECTORS)).collect()) == apart
    monkeypatch.setattr(events, "detect_peaks", lambda *a, **b: calls.append(a) or one(*a, **b))
    events.detect_ensemble(d, Series()).count()
    assert len(calls) == 1


def test_thinning_chunks_are_dealt_over_tasks(spark):
    """AQE joined the chunks, few bytes with much work, in one task."""
    ts = sorted({int(t) for t in np.random.default_rng(9).integers(0, 40 * thinning.CHUNK_MS, 3000)} | set(range(595_000, 606_000, 150)))
    d = spark.createDataFrame([("k", t) for t in ts], "_k string, _ts long")
    got = thinning.anchors(d, 200).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 1
    last, want = None, set()
    for t in ts:
        if last is None or t > last + 200:
            last = t
            want.add(t)
    assert {r._ts for r in got if r._anchor} == want and len(got) == len(ts)
