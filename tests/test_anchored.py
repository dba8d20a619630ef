"""Windows kept up to date by micro-batches against the batch metrics."""

import random

from pyspark.sql import functions as F

from beatloom.operators import hrv
from beatloom.streaming.anchored import AnchoredWindows

RR = "recording_id long, timestamp_ms long, rr_ms double"
FRAMES = {"20S": (20_000, 5), "1M": (60_000, 20), "10M": (600_000, 30)}
DAY = 600_000


def series(seed=1, n=1500):
    rng = random.Random(seed)
    rows = []
    for rec in range(2):
        t = 1_704_067_200_123 + rec
        for _ in range(n if rec == 0 else 60):
            rr = rng.randint(400, 1200)
            t += rr + (rng.randint(1, 90_000) if rng.random() < 0.01 else 0)
            rows.append((rec, t, float(rr)))
    return rows


def batch_metrics(spark, rows):
    rows = sorted(rows)
    first = {}
    numbered = [(*r, first.setdefault(r[0], i) * 0 + i - first[r[0]]) for i, r in enumerate(rows)]
    d = spark.createDataFrame(numbered, RR + ", rr_idx long")
    return table(hrv.moments(d, FRAMES))


def table(df):
    cols = sorted(c for c in df.columns)
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()), key=str)


def windows(spark, path):
    return AnchoredWindows(spark, str(path), hrv.moments, FRAMES, day_ms=DAY)


def test_stream_equals_batch(spark, tmp_path):
    rows = series()
    rng = random.Random(2)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    rows.sort(key=lambda r: r[1])
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        part = rows[a:b]
        rng.shuffle(part)  # order inside a batch does not matter
        spark.createDataFrame(part, RR).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    w = windows(spark, tmp_path / "out")
    stream = spark.readStream.schema(RR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(w.write).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(400)
    assert q.lastProgress["batchId"] == 3
    assert table(w.metrics()) == batch_metrics(spark, rows)


def test_late_and_repeated_rows(spark, tmp_path):
    rows = [r for r in series(3, 400) if r[0] == 0]
    a, b, c = rows[:150], rows[150:250], rows[250:]
    w = windows(spark, tmp_path / "out")
    put = lambda part, i: w.write(spark.createDataFrame(part, RR), i)
    put(a, 0)
    put(c, 1)  # a gap stays open
    assert table(w.metrics()) == batch_metrics(spark, a + c)
    put(b, 2)  # rows in the gap are not late
    assert table(w.metrics()) == batch_metrics(spark, rows)
    put([(0, rows[100][1] + 1, 999.0)], 3)  # inside covered time: skipped
    put(b, 2)  # a repeated batch
    put(c, 4)  # rows that are there already
    put([(None, 5, 1.0), (0, None, 1.0), (0, rows[-1][1] + 500, None)], 5)  # nothing usable
    assert table(w.metrics()) == batch_metrics(spark, rows)
    # after a reset the time can be sent again, and new values win
    w.reset(spark.createDataFrame([(0, c[0][1])], "recording_id long, cutoff_ms long"), 5)
    again = [(r, t, x + 1) for r, t, x in c]
    put(again, 6)
    assert table(windows(spark, tmp_path / "out").metrics()) == batch_metrics(spark, a + b + again)


def test_only_touched_days_are_rewritten(spark, tmp_path):
    rows = [r for r in series(4, 1500) if r[0] == 0]
    w = windows(spark, tmp_path / "out")
    w.write(spark.createDataFrame(rows[:1400], RR), 0)
    files = lambda: {r.f for r in spark.read.parquet(f"{tmp_path}/out/metrics").select(F.input_file_name().alias("f")).distinct().collect()}
    before = files()
    w.write(spark.createDataFrame(rows[1400:], RR), 1)
    assert len(before) > 2 and len(before & files()) >= len(before) - 1
    assert table(w.metrics()) == batch_metrics(spark, rows)


def test_timeframes_must_nest(spark, tmp_path):
    try:
        AnchoredWindows(spark, str(tmp_path), frames={"7M": (420_000, 1)}, day_ms=600_000)
    except ValueError:
        return
    raise AssertionError


def test_one_file_a_day(spark, tmp_path):
    """A day is dealt to one task, so files do not multiply by tasks."""
    rows = [r for r in series(5, 1500) if r[0] == 0]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w = windows(spark, tmp_path / "out")
        w.write(spark.createDataFrame(rows[:700], RR).repartition(4), 0)
        w.write(spark.createDataFrame([*rows[650:], *rows[900:950]], RR).repartition(4), 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    for name in ("intervals", "metrics"):
        days = [d for d in (tmp_path / "out" / name).glob("recording_id=*/day=*")]
        assert len(days) > 2
        assert all(len(list(d.glob("*.parquet"))) == 1 for d in days)
    assert table(w.metrics()) == batch_metrics(spark, rows)
