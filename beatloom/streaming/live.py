"""Incremental forms of window metrics and session splitting.

Rows later than the watermark are dropped, just as the batch ledger skips a late
row inside time it already covers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.operators import relational
from beatloom.params import Series
from beatloom.plans.ordered import running
from beatloom.session import materialise


def _timed(df: DataFrame, ts_ms: str, delay: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis(F.col(ts_ms))).withWatermark("event_time", delay)


def window_metrics(df: DataFrame, length: str, min_beats: int, key: Sequence[str] = ("recording_id",), ts_ms: str = "timestamp_ms",
                   rr: str = "rr_ms", delay: str = "10 minutes") -> DataFrame:
    """Count, mean, sd and extremes per clock-aligned window, batch or stream.

    State is one row of sums per open (recording, window).
    """
    w = F.window("event_time", length)
    g = _timed(df, ts_ms, delay).groupBy(*key, w).agg(
        F.count(F.lit(1)).alias("count"), F.avg(rr).alias("mean_rr"), F.stddev_samp(rr).alias("sdnn"),
        F.min(rr).alias("min_rr"), F.max(rr).alias("max_rr"),
    )
    start = F.unix_millis(F.col("window.start")).alias("window_start_ms")
    return g.filter(F.col("count") >= min_beats).select(*key, start, "count", "mean_rr", "sdnn", "min_rr", "max_rr")


def live_sessions(df: DataFrame, gap_ms: int = 10_000, key: Sequence[str] = ("recording_id",), ts_ms: str = "timestamp_ms",
                  delay: str = "1 minute") -> DataFrame:
    """Sessions that a silence of more than ``gap_ms`` ends.

    A silence of exactly the gap still belongs to the session. For stored recordings use ``windows.sessions``, which spreads one recording
    over many tasks; this form keeps one open session per recording as state.
    """
    w = F.session_window("event_time", f"{gap_ms} milliseconds")
    g = _timed(df, ts_ms, delay).groupBy(*key, w).agg(
        F.count(F.lit(1)).alias("n_beats"), F.min(ts_ms).alias("first_ms"), F.max(ts_ms).alias("last_ms")
    )
    return g.select(*key, "first_ms", "last_ms", "n_beats")


def partial_sessions(df: DataFrame, gap_ms: int = 10_000, bucket_ms: int = 3_600_000, key: Sequence[str] = ("recording_id",),
                     ts_ms: str = "timestamp_ms", delay: str = "1 minute") -> DataFrame:
    """Sessions cut at the borders of time buckets, batch or stream.

    State is kept by recording and bucket, so one recording, however large, is many
    keys, and a session that never ends leaves its state after every bucket.
    ``merge_sessions`` of the written parts gives the sessions.
    """
    bucket = F.floor(F.col(ts_ms) / bucket_ms).alias("_bucket")
    w = F.session_window("event_time", f"{gap_ms} milliseconds")
    g = _timed(df, ts_ms, delay).groupBy(*key, bucket, w).agg(
        F.count(F.lit(1)).alias("n_beats"), F.min(ts_ms).alias("first_ms"), F.max(ts_ms).alias("last_ms")
    )
    return g.select(*key, "first_ms", "last_ms", "n_beats")


def merge_sessions(parts: DataFrame, gap_ms: int = 10_000, key: Sequence[str] = ("recording_id",)) -> DataFrame:
    """Parts no further apart than ``gap_ms`` joined: two running maxima over the
    parts, of which there is about one per recording and bucket."""
    s = Series(key=tuple(key), ts="first_ms", tie="last_ms", bucket_ms=86_400_000)
    at = {"position": F.col("first_ms"), "width": s.bucket_ms, "order": ("first_ms", "last_ms")}
    d = materialise(parts.select(*key, "first_ms", "last_ms", "n_beats"))
    d = running(d, {"_reach": ("max", F.col("last_ms"))}, s, exclusive=True, **at)
    opens = F.col("_reach").isNull() | (F.col("first_ms") - F.col("_reach") > gap_ms)
    d = running(d, {"_session": ("max", F.when(opens, F.col("first_ms")))}, s, **at)
    return d.groupBy(*key, "_session").agg(
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("n_beats").alias("n_beats")
    ).drop("_session")


def upsert_sink(path_of: Callable[[], str], commit: Callable[[str], None], key: Sequence[str]):
    """``foreachBatch`` writer: the current snapshot plus the batch, the batch
    winning, goes to a new path that ``commit`` publishes. A repeated batch
    gives the same snapshot."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = path_of()
        target = f"{current.rsplit('/', 1)[0]}/v{batch_id:06d}"
        old = spark.read.parquet(current) if current.rsplit("/", 1)[1] != "none" else None
        out = batch if old is None else relational.upsert(old, batch, key)
        out.write.mode("overwrite").parquet(target)
        commit(target)

    return write
