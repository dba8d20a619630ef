"""Queue records against a search over all samples; edges from footers."""

import random

import pytest

from beatloom.operators import sampleindex
from beatloom.params import Series
from beatloom.sources import queues, tables

S = Series(bucket_ms=900)


@pytest.fixture
def data(spark, monkeypatch):
    monkeypatch.setattr(sampleindex, "BLOCK", 16)
    monkeypatch.setattr(queues, "BLOCK", 16)
    rng = random.Random(6)
    samples, t = [], 10_000
    for i in range(400):
        t += rng.choice([5, 5, 10, 400])
        samples.append((0, t, i, float(i % 13), t // 3000))
    samples.append((1, 70, 0, 2.0, 0))
    peaks = [(0, k, rng.randrange(9_000, t + 900)) for k in range(80)] + [(1, 1000, 75), (1, 1001, 5_000), (2, 2000, 50)]
    peaks = [(r, k, x, x // 3000) for r, k, x in peaks]
    labels = [(r, k, f"label{k % 3}", 1.234 if k % 2 else None, 800.0) for r, k, *_ in peaks if k % 5]
    return samples, peaks, labels


def expected(samples, peaks, labels, half):
    named = {(r, k): rest for r, k, *rest in labels}
    out = []
    for r, k, t, seg in peaks:
        near = [(st, v) for sr, st, _, v, ss in samples if sr == r and ss == seg and abs(st - t) <= half]
        label, prev, nxt = named.get((r, k), ("unlabeled", None, None))
        at = min(range(len(near)), key=lambda i: (abs(near[i][0] - t), i)) if near else 0
        out.append((r, k, t, seg, label, 0.123457, 0.0, 0.0, None if prev is None else 1.23, nxt, [v for _, v in near], [x for x, _ in near], at))
    return sorted(out)


@pytest.mark.parametrize("half", [20, 300, 5000])
def test_records_equal_brute_force(spark, data, half):
    samples, peaks, labels = data
    smp = spark.createDataFrame(samples, "recording_id int, timestamp_ms long, sample_idx long, ecg double, segment_idx int")
    pk = spark.createDataFrame(peaks + peaks[:5], "recording_id int, peak_id long, timestamp_ms long, segment_idx int")
    lab = spark.createDataFrame(labels, "recording_id int, peak_id long, label string, rr_prev_ms double, rr_next_ms double")
    cand = spark.createDataFrame([(r, k, 0.1234567) for r, k, *_ in peaks], "recording_id int, peak_id long, p_artifact_ensemble double")
    index = sampleindex.sample_index(smp, ["ecg", "segment_idx"], s=S)
    got = queues.queue_records(cand, pk, lab, index, half, S)
    assert got.columns == ["recording_id", *queues.FIELDS]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == expected(samples, peaks, labels, half)


def test_candidates_without_peak_or_samples(spark):
    smp = spark.createDataFrame([], "recording_id int, timestamp_ms long, sample_idx long, ecg double, segment_idx int")
    pk = spark.createDataFrame([], "recording_id int, peak_id long, timestamp_ms long, segment_idx int")
    lab = spark.createDataFrame([], "recording_id int, peak_id long, label string")
    cand = spark.createDataFrame([(0, 1), (0, None)], "recording_id int, peak_id long")
    index = sampleindex.sample_index(smp, ["ecg", "segment_idx"])
    got = queues.queue_records(cand, pk, lab, index).collect()
    assert len(got) == 2 and all(r.context_ecg == [] and r.timestamp_ms is None and r.current_label == "unlabeled" for r in got)


def test_edges_come_from_footers(spark, tmp_path):
    rng = random.Random(8)
    rows = [(r, rng.randrange(10**6), s, 1.5) for r in range(3) for s in range(300)]
    d = spark.createDataFrame(rows, "recording_id int, timestamp_ms long, segment_idx int, ecg double")
    tables.write_table(d, str(tmp_path / "t"), per_bucket=50)
    got = tables.edge_times(spark, str(tmp_path / "t"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(timestamp_ms), MAX(timestamp_ms)]" in plan
    assert "min(timestamp_ms):bigint,max(timestamp_ms):bigint>" in plan and "ecg" not in plan
    want = {(r, min(t for q, t, *_ in rows if q == r), max(t for q, t, *_ in rows if q == r)) for r in range(3)}
    assert {tuple(r) for r in got.collect()} == want
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != "avro,csv,json,kafka,orc,text"
