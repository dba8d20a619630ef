import random

import pytest
from pyspark.sql import functions as F

from beatloom.operators import intervals, relational, temporal, thinning
from beatloom.params import Series

S = Series(bucket_ms=500)


def points(spark, times, rec=0):
    return spark.createDataFrame([(rec, i, t) for i, t in enumerate(times)], "recording_id int, peak_id long, timestamp_ms long")


def greedy(times, tol):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] > tol:
            kept.append(t)
    return kept


@pytest.mark.parametrize("tol,step", [(10, 6), (10, 12), (49, 20), (3, 1)])
def test_greedy_against_brute_force(spark, monkeypatch, tol, step):
    # tiny chunks: chains of crowded events run over many of them
    monkeypatch.setattr(thinning, "CHUNK_MS", 40)
    rnd = random.Random(tol * step)
    times, t = [], 0
    for _ in range(400):
        t += rnd.choice([0, 1, step, step, 2 * step, 300])
        times.append(t)
    got = thinning.greedy_clusters(points(spark, times), tol, None, S)
    assert sorted(r.timestamp_ms for r in got.collect()) == greedy(times, tol)


def test_greedy_priority_and_ties(spark):
    d = spark.createDataFrame(
        [(0, 1, 100, 1), (0, 2, 105, 0), (0, 3, 110, 0), (0, 4, 111, 0), (0, 5, 500, 1), (0, 6, 500, 0)],
        "recording_id int, peak_id long, timestamp_ms long, pr int")
    got = thinning.greedy_clusters(d, 10, ["pr"], S)
    assert sorted(r.peak_id for r in got.collect()) == [2, 4, 6]
    again = thinning.greedy_clusters(got, 10, ["pr"], S)
    assert again.count() == 3 or again.count() == 2  # 105 and 111 are closer than 10 once 100 is gone


def test_refractory_keeps_the_limit(spark):
    got = thinning.refractory(points(spark, [0, 224, 225, 449, 450, 900]), 225, S)
    assert sorted(r.timestamp_ms for r in got.collect()) == [0, 225, 450, 900]


def test_tolerance_bounds_and_ties(spark):
    p = points(spark, [1000, 2000, 3000, 4000])
    r = spark.createDataFrame([(0, 1080, 7), (0, 2081, 8), (0, 2950, 9), (0, 3050, 10)], "recording_id int, ref_ms long, ref_id long")
    hit = {x.timestamp_ms: x.matched for x in temporal.match_within(p, r, 80, "ref_ms", S).collect()}
    assert hit == {1000: True, 2000: False, 3000: True, 4000: False}
    near = {x.timestamp_ms: x.nearest and x.nearest.ref_id for x in temporal.nearest_within(p, r, 80, "ref_ms", ["ref_id"], S).collect()}
    assert near == {1000: 7, 2000: None, 3000: 10, 4000: None}


def test_asof_ties_and_far_gaps(spark):
    p = points(spark, [5, 15, 9000])
    smp = spark.createDataFrame([(0, 0, 0), (0, 10, 1), (0, 20, 2)], "recording_id int, t long, i long")
    for tie, want in (("later", [1, 2, 2]), ("earlier", [0, 1, 2])):
        got = temporal.asof_nearest(p, smp, ["i"], "t", S, tie).orderBy("timestamp_ms").collect()
        assert [r.nearest.i for r in got] == want


def test_intervals_brute_force(spark):
    rnd = random.Random(5)
    spans = [(a, a + rnd.choice([0, 30, 900, 4000])) for a in (rnd.randrange(20000) for _ in range(60))]
    times = [rnd.randrange(26000) for _ in range(300)] + [s for s, _ in spans] + [e for _, e in spans] + [e + 1 for _, e in spans]
    iv = spark.createDataFrame([(0, a, b) for a, b in spans], "recording_id int, start_ms long, end_ms long")
    got = temporal.in_intervals(points(spark, times), iv, s=S).collect()
    assert all(r.inside == any(a <= r.timestamp_ms <= b for a, b in spans) for r in got)

    merged = sorted((r.start_ms, r.end_ms) for r in intervals.merge(iv, 1, S).collect())
    assert all(b + 1 < c for (_, b), (c, _) in zip(merged, merged[1:]))
    covered = {t for a, b in spans for t in range(a, b + 1)}
    assert covered == {t for a, b in merged for t in range(a, b + 1)}

    req = spark.createDataFrame([(0, 15000, 3000)], "recording_id int, req_start_ms long, req_end_ms long")
    gaps = intervals.uncovered(iv, req, S).collect()
    assert {t for g in gaps for t in range(g.start_ms, g.end_ms + 1)} == set(range(3000, 15001)) - covered


def test_uncovered_without_coverage(spark):
    none = spark.createDataFrame([], "recording_id int, start_ms long, end_ms long")
    req = spark.createDataFrame([(0, 10, 20)], "recording_id int, req_start_ms long, req_end_ms long")
    assert [(r.start_ms, r.end_ms) for r in intervals.uncovered(none, req, S).collect()] == [(10, 20)]


def test_radius_search(spark):
    m = spark.createDataFrame([(0, 1, 5000), (0, 2, 90_000)], "recording_id int, mid long, ts long")
    sp = spark.createDataFrame([(0, 10, 0, 4500), (0, 11, 5600, 5700), (0, 12, 20000, 80_500)], "recording_id int, sid long, start_ms long, end_ms long")
    got = {r.mid: (r.radius_ms, r.sid) for r in temporal.nearest_by_radius(m, sp, [100, 1000, 10_000], "mid", "ts", "sid").collect()}
    assert got == {1: (1000, 11), 2: (10_000, 12)}


def test_upsert_and_left_default(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    d = relational.left_default(old.select("k"), spark.createDataFrame([(2, 1, 0.5), (2, 2, 0.7)], "k int, o int, x double"), ["k"], ["x"], 0.0, "o")
    assert sorted(map(tuple, d.collect())) == [(1, 0.0), (2, 0.7)]
