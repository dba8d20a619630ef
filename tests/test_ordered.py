"""Bucketed computation must equal the plain window over the whole series."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from beatloom.operators import windows
from beatloom.params import Series
from beatloom.plans.ordered import over_rows, over_time, row_index, running
from beatloom.plans.quantiles import exact_quantiles

S = Series(bucket_rows=4, bucket_ms=700)


def beats(spark, n=60, seed=1):
    rnd = random.Random(seed)
    rows = []
    for rec in (0, 0, 0, 1):  # one recording holds three quarters of the rows
        t = 0 if not rows or rows[-1][0] != rec else rows[-1][2]
        for _ in range(n):
            t += rnd.choice([300, 600, 900, 5000])
            rows.append((rec, len(rows), t, rnd.choice([None, 1.0, 2.0, 5.0])))
    return spark.createDataFrame(rows, "recording_id int, peak_id long, timestamp_ms long, v double")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_row_index_and_rows(spark):
    d = row_index(beats(spark), S)
    w = Window.partitionBy("recording_id").orderBy("timestamp_ms", "peak_id")
    same(d.select("peak_id", "beat_idx"), d.select("peak_id", (F.row_number().over(w) - 1).cast("long").alias("beat_idx")))

    def build(x, win):
        return x.withColumn("a", F.sum("v").over(win.rowsBetween(-5, 3))).withColumn("b", F.lag("a", 2).over(win))

    got = over_rows(d, 7, 3, build, S).select("peak_id", "a", "b")
    same(got, build(d, w).select("peak_id", "a", "b"))


def test_time_frames(spark):
    d = beats(spark)
    w = Window.partitionBy("recording_id").orderBy("timestamp_ms")
    build = lambda x, win: x.withColumn("a", F.count("v").over(win.rangeBetween(-1500, 900)))
    same(over_time(d, 1500, 900, build, S).select("peak_id", "a"), build(d, w).select("peak_id", "a"))


def test_running_forms(spark):
    d = row_index(beats(spark), S)
    cols = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "n": ("next", F.col("v"))}
    for exclusive in (False, True):
        got = running(d, cols, S, exclusive=exclusive).select("peak_id", "s", "m", "l", "n")
        w = Window.partitionBy("recording_id").orderBy("beat_idx")
        end = -1 if exclusive else 0
        fwd, back = w.rowsBetween(Window.unboundedPreceding, end), w.rowsBetween(-end, Window.unboundedFollowing)
        want = d.select(
            "peak_id", F.coalesce(F.sum("v").over(fwd), F.lit(0.0)), F.max("v").over(fwd),
            F.last("v", True).over(fwd), F.first("v", True).over(back))
        same(got, want)


def test_short_series_local_spread(spark):
    d = spark.createDataFrame([(0, i, t, i) for i, t in enumerate([0, 100, 400, 600])], "recording_id int, peak_id long, timestamp_ms long, beat_idx long")
    rows = windows.rr_extended(d, S).orderBy("beat_idx").collect()
    assert [r.rr_prev_ms for r in rows] == [None, 100, 300, 200]
    assert [r.rr_prev_2 for r in rows] == [None, None, 100, 300]
    assert all(abs(r.rr_local_mean_5 - 200.0) < 1e-9 for r in rows)


def test_quantiles_match_percentile(spark):
    d = beats(spark).withColumn("x", F.col("timestamp_ms") % 97 / 7.0)
    got = exact_quantiles(d, "x", {"a": 0.05, "b": 0.5, "c": 0.99}, ["recording_id"]).orderBy("recording_id").collect()
    want = d.groupBy("recording_id").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.99))).alias("q")).orderBy("recording_id").collect()
    for g, x in zip(got, want, strict=True):
        assert all(abs(p - q) < 1e-9 for p, q in zip((g.a, g.b, g.c), x.q, strict=True))


def test_plans_stay_distributed(spark):
    d = row_index(beats(spark), S)
    plan = windows.rr_extended(d, S)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan


def test_rows_without_a_position_stay(spark):
    d = spark.createDataFrame([(0, 1, 10, 1.0), (0, 2, None, 2.0), (0, 3, 20, 4.0)], "recording_id int, peak_id long, timestamp_ms long, v double")
    total = lambda f, w: f.withColumn("t", F.sum("v").over(w.rangeBetween(-100, 0)))
    got = {r.peak_id: r.t for r in over_time(d, 100, 0, total, S).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 5.0}
    d = d.withColumnRenamed("timestamp_ms", "beat_idx")
    before = lambda f, w: f.withColumn("t", F.lag("v").over(w))
    assert {r.peak_id: r.t for r in over_rows(d.withColumn("beat_idx", F.col("beat_idx") / 10), 1, 0, before, S).collect()} == {1: None, 2: None, 3: 1.0}


def test_running_keeps_its_partitions(spark):
    """Narrow rows compress well: joined by size, millions would be sorted in one task."""
    d = row_index(spark.range(2000).selectExpr("id % 2 as recording_id", "id as peak_id", "id * 4000000 as timestamp_ms"))
    # a given number: AQE leaves it
    assert "REPARTITION_BY_NUM" in d._jdf.queryExecution().toString()
    assert d.selectExpr("min(beat_idx)", "max(beat_idx)", "count(distinct beat_idx)").first()[:] == (0, 999, 1000)
