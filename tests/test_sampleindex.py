"""Sample blocks found by time against a search over all samples."""

import random
import re

import pytest
from pyspark.sql import functions as F

from beatloom.operators import sampleindex, waveforms
from beatloom.params import Series

S = Series(bucket_ms=700)
SAMPLES = "recording_id int, timestamp_ms long, sample_idx long, ecg double"


@pytest.fixture
def signal(monkeypatch):
    """Short blocks, equal times, pauses longer than many blocks."""
    monkeypatch.setattr(sampleindex, "BLOCK", 8)
    rng = random.Random(4)
    rows, t = [], 1000
    for i in range(300):
        t += rng.choice([0, 5, 5, 5, 40, 3000])
        rows.append((0, t, i, float(rng.randint(-9, 9))))
    rows += [(1, 50, 0, 1.0)]
    times = [rng.randrange(500, t + 900) for _ in range(300)] + [r[1] for r in rows[:60]]
    points = [(0, k, x) for k, x in enumerate(times)] + [(1, 900, 7), (1, 901, 99), (2, 902, 5), (0, 903, None)]
    return rows, points


def nearest(rows, rec, t, tie):
    mine = [r for r in rows if r[0] == rec]
    if not mine or t is None:
        return None
    best = min(abs(r[1] - t) for r in mine)
    near = [r for r in mine if abs(r[1] - t) == best]
    later = [r for r in near if r[1] > t] if tie == "later" and any(r[1] > t for r in near) else [r for r in near if r[1] <= t] or near
    return {r[2] for r in later}


@pytest.mark.parametrize("tie", ["later", "earlier"])
@pytest.mark.parametrize("store", [False, True])
def test_nearest_sample(spark, signal, tie, store):
    rows, points = signal
    index = sampleindex.sample_index(spark.createDataFrame(rows, SAMPLES), ["ecg"], 1, S, store=store)
    p = spark.createDataFrame(points, "recording_id int, peak_id long, timestamp_ms long")
    got = sampleindex.nearest_sample(p, index, S, tie).collect()
    assert len(got) == len(points)
    for r in got:
        want = nearest(rows, r.recording_id, r.timestamp_ms, tie)
        if want is None:
            assert r.nearest is None
        else:
            assert r.nearest.i in want and (r.recording_id, r.nearest.t, r.nearest.i, r.nearest.ecg) in rows


@pytest.mark.parametrize("snap", [0, 3])
def test_windows_cross_blocks(spark, signal, snap):
    rows, points = signal
    v = {r[2]: r[3] for r in rows if r[0] == 0}
    p = spark.createDataFrame([q for q in points if q[0] == 0 and q[2] is not None], "recording_id int, peak_id long, timestamp_ms long")
    got = waveforms.extract_windows(p, spark.createDataFrame(rows, SAMPLES), 9, snap, S).collect()
    for r in got:
        centres = nearest(rows, 0, r.timestamp_ms, "later")
        moved = {min((i for i in range(c - snap, c + snap + 1) if i in v), key=lambda i: (-abs(v[i]), i)) for c in centres}
        assert r.centre_idx in moved
        assert list(r.waveform) == [v.get(i, 0.0) for i in range(r.centre_idx - 4, r.centre_idx + 5)]


def test_empty_sides(spark):
    none = spark.createDataFrame([], SAMPLES)
    p = spark.createDataFrame([(0, 1, 5)], "recording_id int, peak_id long, timestamp_ms long")
    assert sampleindex.nearest_sample(p, sampleindex.sample_index(none, ["ecg"]), S).first().nearest is None
    some = spark.createDataFrame([(0, 1, 0, 1.0)], SAMPLES)
    assert sampleindex.nearest_sample(p.filter("false"), sampleindex.sample_index(some, ["ecg"]), S).collect() == []


def test_samples_are_shuffled_once(spark, tmp_path):
    rows = [(0, i * 8, i, float(i)) for i in range(5000)]
    spark.createDataFrame(rows, SAMPLES).write.parquet(str(tmp_path / "s"))
    points = spark.createDataFrame([(0, i, i * 801) for i in range(50)], "recording_id int, peak_id long, timestamp_ms long")
    d = waveforms.extract_windows(points, spark.read.parquet(str(tmp_path / "s")))
    d.write.format("noop").mode("overwrite").save()
    d.collect()
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # every other reader of the samples takes the shuffle that is there already
    fresh = [x for x in re.findall(r"[^\n]*Exchange hashpartitioning\(recording_id#\d+, _block#\d+L[^\n]*", plan) if "Reused" not in x]
    scans = len(re.findall(r"FileScan parquet", plan))
    assert scans == 1 or "ReusedExchange" in plan
    assert len(fresh) <= 2  # the samples' shuffle and the points'


def test_binary_search(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.randrange(40) for _ in range(n)), t) for n in range(0, 20) for t in (-1, 0, 13, 39, 50)]
    d = spark.createDataFrame(rows, "a array<long>, t long")
    for r in d.withColumn("n", sampleindex.count_upto(F.col("a"), F.col("t"), 19)).collect():
        assert r.n == sum(x <= r.t for x in r.a)
