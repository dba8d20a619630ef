"""Roll-up of timeframes from states against one window at a time in NumPy."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from beatloom.functions import complexity
from beatloom.operators import hrv, rollup

S = "recording_id int, timestamp_ms long, rr_ms double, rr_idx long"
# lengths that share 2 s, one of them long enough for a second histogram level
FRAMES = {"A": (4_000, 1), "B": (6_000, 5), "C": (24_000, 1), "D": (72_000, 20)}


def series(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for rec in range(3):
        n = int(rng.integers(1, 400))
        rr = rng.integers(300, 1200, n).astype(float)
        gap = np.where(rng.random(n) < 0.03, rng.integers(3_000, 60_000, n), 0)  # bins without intervals
        t = 1_000_003 + np.cumsum(rr + gap).astype(int)
        rows += [(rec, int(a), float(b), i) for i, (a, b) in enumerate(zip(t, rr))]
    return rows


def windows(rows):
    out = {}
    for rec in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == rec]
        anchor = mine[0][1]
        for name, (ms, least) in FRAMES.items():
            groups = {}
            for _, t, x, _ in mine:
                groups.setdefault(anchor + (t - anchor) // ms * ms, []).append(x)
            out |= {(rec, name, w): np.array(x) for w, x in groups.items() if len(x) >= least}
    return out


def expected(x):
    n, d = len(x), np.diff(x)
    turns = [((x[i] + x[i + 1] - x[i - 1] - x[i - 2]) / 4, x[i] - x[i - 1]) for i in range(5, n - 5)]
    up, down = [t for t, s in turns if s > 0], [t for t, s in turns if s < 0]
    pats = Counter((a <= b, b <= c, a <= c) for a, b, c in zip(x, x[1:], x[2:]))
    p = np.array(list(pats.values())) / max(1, n - 2)
    return {
        "count": n, "mean_rr": x.mean(), "sdnn": x.std(ddof=1) if n > 1 else None,
        "rmssd": math.sqrt((d * d).mean()) if n > 1 else None, "sdsd": d.std(ddof=1) if n > 2 else None,
        "pnn20": (np.abs(d) > 20).mean() * 100 if n > 1 else None, "pnn50": (np.abs(d) > 50).mean() * 100 if n > 1 else None,
        "dc": np.mean(up) if up else None, "ac": -np.mean(down) if down else None,
        "med_rr": np.median(x), "q20": np.quantile(x, 0.2), "mad": np.median(np.abs(x - np.median(x))),
        "perm_en": float(-(p * np.log2(p)).sum() / math.log2(6)) if n > 2 else None,
    }


def spread(start, length, x, bin_ms=2_000):
    n, bins = len(x), {}
    for i, v in enumerate(x):
        bins.setdefault((start * (n - 1) + i * length) // ((n - 1) * bin_ms), []).append(v)
    means, sds = [np.mean(b) for b in bins.values()], [np.std(b, ddof=1) for b in bins.values() if len(b) > 1]
    if len(bins) < 2:
        return None, None
    return np.std(means, ddof=1), np.mean(sds) if sds else None


def close(a, b):
    return a is b if a is None or b is None else abs(a - b) < 1e-8 * max(1.0, abs(b))


@pytest.mark.parametrize("seed", [1, 2])
def test_all_windows_of_all_frames(spark, seed):
    rows = series(seed)
    st = rollup.states(spark.createDataFrame(rows, S), FRAMES)
    want = windows(rows)
    key = lambda r: (r.recording_id, r.timeframe, r.window_start_ms)
    tables = [{key(r): r.asDict() for r in f(st).collect()} for f in (hrv.moments, hrv.order_statistics)]
    entropy = {key(r): r.perm_en for r in hrv.permutation_entropy(st).collect()}
    assert set(st.levels) == {2_000, 24_000}
    assert tables[0].keys() == tables[1].keys() == want.keys()
    assert {key(r): r["count"] for r in hrv.window_counts(st).collect()} == {k: len(x) for k, x in want.items()}
    for k, x in want.items():
        got = tables[0][k] | tables[1][k] | {"perm_en": entropy.get(k)}
        for name, value in expected(x).items():
            assert close(got[name], value), (k, name, got[name], value)
    sub = {key(r): (r.sdann5, r.sdnni5) for r in hrv.sub_bin_spread(st, bin_ms=2_000).collect()}
    for k, x in want.items():
        if len(x) > 1:
            a, b = spread(k[2], FRAMES[k[1]][0], x)
            assert close(sub[k][0], a) and close(sub[k][1], b), (k, sub[k], (a, b))


def test_open_windows_and_stored_anchor(spark):
    rows = series(3)
    d = spark.createDataFrame(rows, S)
    first = min(r[1] for r in rows if r[0] == 0)
    anchor = spark.createDataFrame([(i, first - 10_000) for i in range(3)], "recording_id int, anchor_ms long")
    got = hrv.window_counts(d, FRAMES, anchor).collect()
    assert got and all((r.window_start_ms - first + 10_000) % FRAMES[r.timeframe][0] == 0 for r in got)
    last = {r[0]: r[1] for r in rows}
    closed = hrv.window_counts(d, FRAMES, open_windows=False).collect()
    assert closed and all(r.window_end_ms <= last[r.recording_id] + 2_000 for r in closed)
    assert len(closed) < hrv.window_counts(d, FRAMES).count()


def test_intervals_are_not_copied_per_timeframe(spark):
    """Only states are spread over timeframes: they come from a file, not the series."""
    d = spark.createDataFrame(series(4), S)
    st = rollup.states(d, FRAMES)
    for f in (hrv.moments, hrv.order_statistics, hrv.permutation_entropy):
        plan = f(st)._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan and "LogicalRDD" not in plan.split("Generate", 1)[1].split("anchor_ms", 1)[0]
    rows = st.bins.count()
    assert rows < d.count()  # a few states per bin


def test_python_metrics_of_nested_frames(spark):
    rows = series(5)
    d = spark.createDataFrame(rows, S)
    got = {(r.recording_id, r.timeframe, r.window_start_ms): r.samp_en for r in hrv.sample_entropies(d, FRAMES).collect()}
    want = windows(rows)
    assert got.keys() == want.keys()
    for k, x in want.items():
        value = complexity.sample_entropy(x)
        assert close(got[k], None if math.isnan(value) else value)


def test_range_counts_equal_all_pairs():
    rng = np.random.default_rng(9)
    for trial in range(60):
        n, m = int(rng.integers(0, 150)), int(rng.integers(1, 4))
        x = (rng.integers(400, 430, n).astype(float), rng.normal(800, 50, n), rng.choice([1.0, 1.1, 1.2, 1.3], n))[trial % 3]
        r = 0.1 if trial % 3 == 2 else None
        limit = (0.2 * x.std() if n else 0.0) if r is None else r
        emb = [x[i : i + m + 1] for i in range(n - m)]
        b = sum(np.abs(p[:m] - q[:m]).max() < limit for i, p in enumerate(emb) for q in emb[:i])
        a = sum(np.abs(p - q).max() < limit for i, p in enumerate(emb) for q in emb[:i])
        want = 0.0 if b == 0 else -math.log(a / b) if a else math.nan
        got = complexity.sample_entropy(x, m, r)
        assert got == want or math.isnan(got) and math.isnan(want)


def test_dimension_and_fuzzy_entropy_equal_all_pairs():
    rng = np.random.default_rng(10)
    for n, m in ((60, 2), (200, 3), (300, 4)):
        x = rng.normal(800, 50, n)
        emb = np.lib.stride_tricks.sliding_window_view(x, m)
        d = np.sqrt(((emb[:, None] - emb[None]) ** 2).sum(axis=2))[~np.eye(len(emb), dtype=bool)]
        sd = x.std(ddof=1)
        radii = 0.1 * sd * 1.03 ** np.arange(int(np.floor(np.log(5) / np.log(1.03))) + 1)
        c = np.array([(d < r).mean() for r in radii])
        want = np.polyfit(np.log(radii[c > 0]), np.log(c[c > 0]), 1)[0]
        assert abs(complexity.correlation_dimension(x, m) - want) < 1e-9

        def phi(k):
            e = np.lib.stride_tricks.sliding_window_view(x, k)[: n - m]
            e = e - e.mean(axis=1, keepdims=True)
            s = np.exp(-np.abs(e[:, None] - e[None]).max(axis=2) / (0.2 * sd))
            return s[~np.eye(len(e), dtype=bool)].mean()

        assert abs(complexity.fuzzy_entropy(x, m, 0.2 * sd) - (math.log(phi(m)) - math.log(phi(m + 1)))) < 1e-9


def test_kernels_take_whole_and_other_values():
    """Whole ms go through bit sets and integer distances, other values do not."""
    rng = np.random.default_rng(11)
    x = rng.integers(480, 1000, 1500).astype(float)
    r = 0.2 * x.std()
    pairs = complexity._template_pairs(x, 2, r)
    emb = np.lib.stride_tricks.sliding_window_view(x, 3)
    assert pairs == (complexity._near_pairs_2(emb[:, 0], emb[:, 1], r), complexity._near_pairs(np.ascontiguousarray(emb), r))
    assert complexity._template_pairs(x, 2, r, limit=1000) is None
    # a shift by an eighth leaves all differences exact but makes no whole numbers
    for m in (3, 4):
        assert abs(complexity.fuzzy_entropy(x, m, r) - complexity.fuzzy_entropy(x + 0.125, m, r)) < 1e-12


def test_no_step_is_dealt_by_recording_alone(spark):
    """Recordings are few and long: a shuffle by their key is one task for each."""
    st = rollup.states(spark.createDataFrame(series(6), S), FRAMES)
    for d in (rollup._states(st.rr, st.anchor, st.base_ms, st.s), hrv.to_windows(st.rr, 4_000, st.anchor), hrv.geometric(st)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "recording_id" in plan and not re.search(r"hashpartitioning\(recording_id#\d+L?, \d+\)", plan)


def test_wanted_metrics_only(spark):
    d = spark.createDataFrame(series(7), S)
    some = hrv.hrv_metrics(d, FRAMES, names=("count", "sdnn", "hti"))
    assert some.columns == ["recording_id", "timeframe", "window_start_ms", "count", "hti", "sdnn"]
    key = lambda r: (r.recording_id, r.timeframe, r.window_start_ms)
    every = {key(r): r for r in hrv.hrv_metrics(d, FRAMES).collect()}
    assert {key(r): (r["count"], r.hti, r.sdnn) for r in some.collect()} == {k: (r["count"], r.hti, r.sdnn) for k, r in every.items()}
