import json

import pytest
from pyspark.sql import functions as F

from beatloom import fixtures as fx
from beatloom.operators import labelling, models
from beatloom.sources import tables
from beatloom.streaming import live


def test_signal_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DateTime,ECG\n1704067200000,0.5\n2024-01-01T00:00:00.008999Z,-1\nbad,1\n1704067200016,nan\n5,1\n")
    got = tables.read_signal_csv(spark, str(tmp_path)).orderBy("timestamp_ms").collect()
    assert [(r.file, r.timestamp_ms, r.ecg) for r in got] == [("a.csv", 1704067200000, 500.0), ("a.csv", 1704067200008, -1000.0)]


def test_each_file_has_its_own_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("DateTime,ECG\n1704067200000,0.5\n")
    (tmp_path / "b.csv").write_text("ECG,DateTime\n0.25,1704067200008\n")
    (tmp_path / "c.csv").write_text("hr,Time,value\n60,1704067200016,1\n")
    got = tables.read_signal_csv(spark, str(tmp_path)).orderBy("timestamp_ms").collect()
    assert [(r.file, r.timestamp_ms, r.ecg) for r in got] == [("a.csv", 1704067200000, 500.0), ("b.csv", 1704067200008, 250.0), ("c.csv", 1704067200016, 1000.0)]


def test_annotation_events_and_revisits(spark, tmp_path):
    events = [1704067200000, "2024-01-01T00:00:05", {"start": 1704067201000, "end": 1704067202000}, {"start_time": "2024-01-01T00:00:03", "end_time": "2024-01-01T00:00:04"}, {"start": 1}]
    doc = {"tagged_physiological_events": events, "return_to_pile": [{"segment_idx": 3, "start_time": "2024-01-01T00:03:00", "end_time": "2024-01-01T00:04:00", "marked_at": "x"}], "validated_true_beats": ["seg_2"]}
    (tmp_path / "rec9.json").write_text(json.dumps(doc))
    d = tables.read_annotations(spark, str(tmp_path))
    got = labelling.event_windows(d).orderBy("start_ms").collect()
    ms = 1704067200000
    assert [tuple(r) for r in got] == [("rec9", ms, ms), ("rec9", ms + 1000, ms + 2000), ("rec9", ms + 3000, ms + 4000), ("rec9", ms + 5000, ms + 5000)]
    r = d.first()
    assert r.return_to_pile[0].segment_idx == 3 and r.validated_segments == ["seg_2"]
    assert tables.read_annotations(spark, str(tmp_path), "r1").first().recording_id == "r1"


def test_peak_csv_defaults(spark, tmp_path):
    (tmp_path / "p.csv").write_text("t\n1704067200000\nx\n")
    r = tables.read_peak_csv(spark, str(tmp_path)).collect()
    assert [(x.timestamp_ms, x.source, x.is_added_peak, x.label) for x in r] == [(1704067200000, "detected", False, None)]


def test_annotations_alternate_keys(spark, tmp_path):
    doc = {"recording_id": "r1", "added_r_peaks": ["2024-01-01T00:00:01.500"], "artifacts": [1704067200000, "oops"]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    d = tables.read_annotations(spark, str(tmp_path))
    assert [r.ref_ms for r in tables.times_of(d, "added_peaks").collect()] == [1704067201500]
    assert [r.ref_ms for r in tables.times_of(d, "artifacts").collect()] == [1704067200000]
    assert d.first().validated_segments == []


def test_repair(spark):
    d = spark.createDataFrame([("1,2,a",), ("1,2,a,b,c",), ("1,2",)], "value string")
    assert sorted(map(tuple, tables.repair_lines(d, ["x", "y", "note"]).collect())) == [("1", "2", "a"), ("1", "2", "a,b,c")]


def test_table_round_trip_prunes(spark, tmp_path):
    d = spark.range(5000).select((F.col("id") % 2).alias("recording_id"), (F.col("id") / 2).cast("int").alias("segment_idx"), "id")
    tables.write_table(d, str(tmp_path / "t"), per_bucket=500)
    back = spark.read.parquet(str(tmp_path / "t"))
    got = tables.scan_segments(back, 700, 701, ["id", "segment_idx"], per_bucket=500)
    assert sorted({r.segment_idx for r in got.collect()}) == [699, 700, 701, 702]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment_bucket" in plan and "GreaterThanOrEqual(segment_idx,699)" in plan


def test_queue_import_rejects(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (2,)], "peak_id long")
    (tmp_path / "ok.csv").write_text("peak_id,label\n1,clean\n2,artifact\n")
    (tmp_path / "no.csv").write_text("peak_id,label\n9,clean\n2,odd\n")
    assert tables.import_completed(spark, str(tmp_path / "ok.csv"), ids).count() == 2
    with pytest.raises(ValueError):
        tables.import_completed(spark, str(tmp_path / "no.csv"), ids)
    with pytest.raises(ValueError):
        tables.required(ids, ["peak_id", "label"])


def _stream(spark, df, path):
    df.write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _drain(spark, df, name, tmp, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp)).start()
    q.awaitTermination(90)
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(0, 60_000 * m + 700 * i, float(700 + i)) for m in range(4) for i in range(20)] + [(0, 3_600_000, 1.0)]
    d = spark.createDataFrame(rows, "recording_id int, timestamp_ms long, rr_ms double")
    got = _drain(spark, live.window_metrics(_stream(spark, d, str(tmp_path / "i")), "1 minute", 10), "win", tmp_path / "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.window_metrics(d, "1 minute", 10).collect()))


def test_session_gap_is_exclusive(spark, tmp_path):
    d = spark.createDataFrame([(0, t) for t in (0, 10_000, 20_001, 9_000_000)], "recording_id int, timestamp_ms long")
    batch = live.live_sessions(d, 10_000).orderBy("first_ms").collect()
    assert [(r.first_ms, r.last_ms) for r in batch] == [(0, 10_000), (20_001, 20_001), (9_000_000, 9_000_000)]
    got = _drain(spark, live.live_sessions(_stream(spark, d, str(tmp_path / "i")), 10_000), "sess", tmp_path / "c")
    assert {(r.first_ms, r.last_ms) for r in got.collect()} >= {(0, 10_000), (20_001, 20_001)}


def test_upsert_sink_replays(spark, tmp_path):
    state = {"p": f"{tmp_path}/none"}
    write = live.upsert_sink(lambda: state["p"], lambda p: state.update(p=p), ["k"])
    write(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), 0)
    write(spark.createDataFrame([(2, "c")], "k int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(state["p"]).collect())) == [(1, "a"), (2, "c")]


def test_augmentation_is_repeatable(spark):
    d = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(65)]) for i in range(20)], "peak_id long, waveform array<double>")
    for fn in (models.augment_artifacts, models.augment_jitter, models.corrupt):
        a, b = (sorted(map(str, fn(x, 3).collect())) for x in (d, d.repartition(5)))
        assert a == b and len(a) == 20
    assert sorted(map(str, models.augment_jitter(d, 4).collect())) != sorted(map(str, models.augment_jitter(d, 3).collect()))


def test_leaf_paths_cover_the_tree(spark):
    rows = [(float(i % 10), float(i % 7), float((i % 10) > 4 and (i % 7) > 2)) for i in range(400)]
    d = spark.createDataFrame(rows, "r_peak_snr double, window_iqr double, truth double")
    feats = ["r_peak_snr", "window_iqr"]
    m = models.fit_categories(d, feats, "truth", depth=3, min_leaf=5)
    leaves = models.leaf_table(m, feats, m.transform(d), "truth")
    assert leaves.agg(F.sum(F.col("n_clean") + F.col("n_artifact"))).first()[0] == 400
    assert leaves.count() == m.stages[-1].numNodes // 2 + 1
    out = models.apply_categories(m, models.categorise_leaves(leaves), d, ["truth"])
    assert out.filter(F.col("category").isNull()).count() == 0


def test_fixture_bounds(spark):
    b = fx.beats(spark, "/root/testdata/sf0.001")
    assert b.count() == 1000 and b.select("recording_id", "timestamp_ms").distinct().count() == 1000


def test_oversample_draws_exactly_n(spark):
    from beatloom.operators import columns

    d = spark.range(300).select(F.col("id").alias("peak_id"), F.when(F.col("id") < 20, "artifact").when(F.col("id") < 200, "clean").otherwise("phys_event").alias("label"))
    got = columns.oversample(d, "label", {"artifact": 15.0, "clean": 1.0, "phys_event": 0.0}, seed=3, n=5000)
    n = {r.label: r["count"] for r in got.groupBy("label").count().collect()}
    assert sum(n.values()) == 5000 and set(n) == {"artifact", "clean"}
    assert abs(n["artifact"] / 5000 - 300 / 480) < 0.03
    per = [r["count"] for r in got.filter("label = 'artifact'").groupBy("peak_id").count().collect()]
    assert len(per) == 20 and max(per) < 2 * min(per)


def test_merge_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(30).select("id", (F.col("id") % 3).cast("int").alias("day"), F.lit("old").alias("v"))
    old.write.partitionBy("day").parquet(path)
    before = sorted(p.name for p in (tmp_path / "t" / "day=0").glob("*.parquet"))
    new = spark.createDataFrame([(1, 1, "new"), (100, 2, "new")], "id long, day int, v string")
    tables.merge_into(path, new, ["id"], ["day"])
    got = {r.id: r.v for r in spark.read.parquet(path).collect()}
    assert len(got) == 31 and {k for k, v in got.items() if v == "new"} == {1, 100}
    assert sorted(p.name for p in (tmp_path / "t" / "day=0").glob("*.parquet")) == before


def test_headers_cost_no_jobs(spark, tmp_path):
    """Many files with five headers, one of them empty, one without known names."""
    heads = ["DateTime,ECG", "ECG,noise,timestamp", '"ecg_amplitude","Time"', "a,b", "time,value,x,y"]
    want = set()
    for i in range(60):
        h, t = heads[i % 5], 1_700_000_000_000 + i
        cells = {"DateTime,ECG": f"{t},1.5", "ECG,noise,timestamp": f'1.5,"a,b",{t}', heads[2]: f'"1.5","{t}"', "a,b": f"{t},1.5", heads[4]: f"{t},1.5,,"}[h]
        (tmp_path / f"f{i:03}.csv").write_text(f"\n{h}\n{cells}\nbroken,row\n{h}\n" if i % 2 else f"{h}\r\n{cells}\r\n")
        want.add((f"f{i:03}.csv", t, 1500.0))
    (tmp_path / "empty.csv").write_text("")
    spark.sparkContext.setJobGroup("headers", "")
    got = {tuple(r) for r in tables.read_signal_csv(spark, str(tmp_path)).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want
    assert len(jobs) <= 8  # whatever the number of files


def test_no_header_at_all(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("\n\n")
    with pytest.raises(ValueError):
        tables.read_signal_csv(spark, str(tmp_path))


def test_sessions_cut_by_buckets(spark, tmp_path):
    """Gaps of exactly the limit and one more, on and off the borders of buckets."""
    gap, bucket = 1_000, 10_000
    times = [9_000, 10_000, 11_001, 19_500, 20_000, 29_999, 30_999, 32_000, 50_000]
    times += list(range(60_000, 95_000, 700))  # one session over four buckets
    rows = [(r, t + r) for r in (0, 1) for t in times] + [(r, 10_000_000) for r in (0, 1)]
    d = spark.createDataFrame(rows, "recording_id int, timestamp_ms long")
    want = []
    for r in (0, 1):
        mine = sorted(t for q, t in rows if q == r)
        for t in mine:
            if want and want[-1][0] == r and t - want[-1][2] <= gap:
                want[-1] = (r, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((r, t, t, 1))
    batch = live.merge_sessions(live.partial_sessions(d, gap, bucket), gap)
    assert sorted(map(tuple, batch.select("recording_id", "first_ms", "last_ms", "n_beats").collect())) == want
    parts = _drain(spark, live.partial_sessions(_stream(spark, d, str(tmp_path / "i")), gap, bucket), "parts", tmp_path / "c")
    got = live.merge_sessions(parts, gap).select("recording_id", "first_ms", "last_ms", "n_beats").collect()
    # the watermark has closed all but the last event's own session
    assert sorted(map(tuple, got)) == [w for w in want if w[1] < 10_000_000]


def test_annotations_are_read_as_text_once(spark, tmp_path):
    (tmp_path / "one.json").write_text('﻿{"artifacts": [5, "x"], "bad_segments": [1], "tagged_physiological_events": [{"start": 1704067200000, "end": 1704067200500}, 7]}')
    (tmp_path / "two.json").write_text('[{"recording_id": "a", "artifacts": [1]}, {"recording_id": "b"}]')
    (tmp_path / "bad.json").write_text('{"artifacts": [')
    (tmp_path / "blank.json").write_text(" \n")
    docs = tables.read_annotations(spark, str(tmp_path))
    rows = {r.recording_id: r for r in docs.collect()}
    assert sorted(rows) == ["a", "b", "bad", "one"]
    assert rows["one"].artifacts == ["5", "x"] and rows["one"].bad_segments == [1] and rows["a"].artifacts == ["1"] and rows["b"].artifacts == []
    e = rows["one"].tagged_physiological_events
    assert (e[0].start, e[0].end, e[1].at) == ("1704067200000", "1704067200500", "7")
    # the JSON reader fetches each object kept as text by a read of its own
    plan = docs._jdf.queryExecution().toString()
    assert "Format: Text" in plan and "Format: JSON" not in plan
