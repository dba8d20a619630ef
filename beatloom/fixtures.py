"""Deterministic beat, label, score and sample views over the given tables.

``FIXTURES.md`` describes them. Each view exists twice: as a DataFrame and, in
``CTE``, as SQL, so that an independent engine can check the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.params import Series
from beatloom.plans.ordered import row_index, running

T0 = 1_704_067_200_000
SRC = Series(ts="src_ms", tie="peak_id")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def segment_of(ts: Column, t0: int | Column = T0, width_ms: int = 60_000) -> Column:
    start = F.lit(t0) if isinstance(t0, int) else t0
    return F.floor((ts - start) / F.lit(width_ms)).cast("int")


def events_ms(spark: SparkSession, sf: str) -> DataFrame:
    """events with ``ts_ms`` (epoch ms)."""
    return table(spark, sf, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def beats(spark: SparkSession, sf: str) -> DataFrame:
    """One beat per event; the interval to the previous beat is 400 + 4*value ms."""
    ev = table(spark, sf, "events").select(
        (F.col("user_id") % 16).alias("recording_id"),
        F.col("event_id").alias("peak_id"),
        "event_type",
        "value",
        "props",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("src_ms"),
        F.round(400 + 4 * F.col("value")).cast("long").alias("rr_raw"),
    )
    out = running(
        ev,
        {"elapsed": ("sum", F.col("rr_raw")), "n": ("sum", F.lit(1).cast("long"))},
        SRC,
        position=F.col("src_ms"),
        width=3_600_000_000,
        order=("src_ms", "peak_id"),
    )
    ts = F.col("elapsed") + F.lit(T0)
    return out.select(
        "recording_id",
        "peak_id",
        "event_type",
        "value",
        "props",
        ts.alias("timestamp_ms"),
        (F.col("n") - 1).alias("beat_idx"),
        segment_of(ts).alias("segment_idx"),
    )


def long_beats(spark: SparkSession, sf: str) -> DataFrame:
    """Two recordings of four beats per order line, long enough for 24 h windows
    from the second scale on; intervals of 480 to 1000 ms with slow waves."""
    k = F.col("k")
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 2).alias("recording_id"), "l_orderkey", "l_partkey", "l_suppkey",
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), (F.col("l_linenumber") * 4).alias("line"),
    ).select(
        "recording_id", "l_orderkey", (F.col("line") + k).alias("line"),
        (480 + (F.col("l_partkey") * 13 + F.col("l_suppkey") * 7 + k * 101) % 400 + 20 * (F.floor(F.col("l_orderkey") / 64) % 7)).cast("long").alias("rr_raw"),
    )
    src = Series(ts="l_orderkey", tie="line")  # lines of one number are told apart by their interval
    out = running(
        li, {"elapsed": ("sum", F.col("rr_raw")), "n": ("sum", F.lit(1).cast("long"))}, src,
        position=F.col("l_orderkey"), width=16_384, order=("l_orderkey", "line", "rr_raw"),
    )
    return out.select(
        "recording_id", (F.col("n") - 1).alias("peak_id"),
        (F.col("elapsed") + F.lit(T0)).alias("timestamp_ms"), (F.col("n") - 1).alias("beat_idx"),
    )


def noisy(spark: SparkSession, sf: str) -> DataFrame:
    """Beats plus false beats 120 ms after small sign-ups and near copies 5 ms
    after small clicks; ``arrival_id`` is the order the rows came in."""
    b = beats(spark, sf).select("recording_id", "peak_id", "timestamp_ms", "event_type", "value")
    sandwich = b.filter("event_type = 'signup' and value < 15").select(
        "recording_id",
        (F.col("peak_id") + 10_000_000_000).alias("peak_id"),
        (F.col("timestamp_ms") + 120).alias("timestamp_ms"),
    )
    copies = b.filter("event_type = 'click' and value < 10").select(
        "recording_id",
        (F.col("peak_id") + 20_000_000_000).alias("peak_id"),
        (F.col("timestamp_ms") + 5).alias("timestamp_ms"),
    )
    return (
        b.select("recording_id", "peak_id", "timestamp_ms")
        .withColumn("source", F.lit("detected"))
        .unionByName(sandwich.withColumn("source", F.lit("sandwich")))
        .unionByName(copies.withColumn("source", F.lit("added")))
        .withColumn("segment_idx", segment_of(F.col("timestamp_ms")))
    )


def noisy_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return row_index(noisy(spark, sf))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return beats(spark, sf).select(
        "recording_id",
        "peak_id",
        "timestamp_ms",
        "beat_idx",
        "segment_idx",
        F.when(F.col("event_type") == "error", "artifact")
        .when((F.col("event_type") == "signup") & (F.col("value") < 30), "phys_event")
        .when((F.col("event_type") == "view") & (F.col("value") < 4), "interpolated")
        .otherwise("clean")
        .alias("label"),
        ((F.col("event_type") == "signup") & (F.col("value") < 30)).alias("phys_event_window"),
        (F.col("segment_idx") % 3 != 0).alias("reviewed"),
        (F.col("value") > 150).alias("in_bad_region"),
    )


def refs(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation times near (at, inside and outside 80 ms of) the error beats."""
    return (
        beats(spark, sf)
        .filter("event_type = 'error'")
        .select(
            "recording_id",
            F.col("peak_id").alias("ref_id"),
            (F.col("timestamp_ms") + (F.col("peak_id") % 200) - 100).alias("ref_ms"),
        )
    )


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping, nested and touching intervals around the large purchases."""
    return (
        beats(spark, sf)
        .filter("event_type = 'purchase' and value > 100")
        .select(
            "recording_id",
            F.col("peak_id").alias("interval_id"),
            (F.col("timestamp_ms") - 5000).alias("start_ms"),
            (F.col("timestamp_ms") + 5000 + (F.col("peak_id") % 7) * 1000).alias("end_ms"),
        )
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two scores per beat with many ties, and the binary truth."""
    return labels(spark, sf).select(
        "recording_id",
        "peak_id",
        "timestamp_ms",
        "segment_idx",
        "label",
        "reviewed",
        ((F.col("peak_id") * 37 % 1000) / F.lit(1000.0)).alias("p_tab"),
        ((F.col("peak_id") * 61 % 1000) / F.lit(1000.0)).alias("p_wave"),
        (F.col("label") == "artifact").cast("int").alias("truth"),
    )


def segment_quality(spark: SparkSession, sf: str) -> DataFrame:
    code = (F.col("recording_id") + F.col("segment_idx")) % 5
    return (
        beats(spark, sf)
        .select("recording_id", "segment_idx")
        .distinct()
        .withColumn(
            "quality_label",
            F.when(code == 0, "bad").when(code == 1, "noisy_ok").otherwise("clean"),
        )
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Eight samples per beat, 40 ms apart; values are exact small integers."""
    return (
        beats(spark, sf)
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
        .select(
            "recording_id",
            (F.col("timestamp_ms") + F.col("k") * 40).alias("timestamp_ms"),
            (F.col("beat_idx") * 8 + F.col("k")).alias("sample_idx"),
            ((F.col("peak_id") * F.col("k")) % 17 - 8).cast("double").alias("ecg"),
        )
        .withColumn("segment_idx", segment_of(F.col("timestamp_ms")))
    )


def waveforms(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as 64-sample windows."""
    return table(spark, sf, "embeddings").select(
        F.lit(0).alias("recording_id"),
        F.col("vec_id").alias("peak_id"),
        F.col("vec_id").alias("beat_idx"),
        (T0 + F.col("vec_id") * 800 + F.col("vec_id") * 37 % 200).alias("timestamp_ms"),
        F.floor(F.col("vec_id") / 20).cast("int").alias("segment_idx"),
        F.when(F.col("label") == 0, "artifact").otherwise("clean").alias("label"),
        (F.col("label") == 1).alias("hard_filtered"),
        F.col("embedding").cast("array<double>").alias("waveform"),
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly mean of ``value`` per event type; hours without events are absent."""
    return (
        events_ms(spark, sf)
        .withColumn("hour_ms", F.floor(F.col("ts_ms") / 3_600_000) * 3_600_000)
        .groupBy("event_type", "hour_ms")
        .agg(F.avg("value").alias("v"))
    )


# Each entry: the CTE text and the CTEs it reads.
CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_beats": (
        """SELECT recording_id, event_id AS peak_id, event_type, value, props,
             CAST(1704067200000 + sum(rr_raw) OVER w AS BIGINT) AS timestamp_ms,
             CAST(row_number() OVER w - 1 AS BIGINT) AS beat_idx,
             CAST(floor(sum(rr_raw) OVER w / 60000) AS INT) AS segment_idx
           FROM (SELECT event_id, event_type, value, props, ts, user_id % 16 AS recording_id,
                        CAST(round(400 + 4 * value) AS BIGINT) AS rr_raw FROM events)
           WINDOW w AS (PARTITION BY recording_id ORDER BY ts, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        (),
    ),
    "fx_long": (
        """SELECT recording_id, CAST(row_number() OVER w - 1 AS BIGINT) AS peak_id, CAST(1704067200000 + sum(rr_raw) OVER w AS BIGINT) AS timestamp_ms,
             CAST(row_number() OVER w - 1 AS BIGINT) AS beat_idx
           FROM (SELECT l_orderkey % 2 AS recording_id, l_orderkey, l_linenumber * 4 + k AS line,
                   480 + (l_partkey * 13 + l_suppkey * 7 + k * 101) % 400 + 20 * (l_orderkey // 64 % 7) AS rr_raw
                 FROM lineitem, (SELECT unnest(range(0, 4)) AS k))
           WINDOW w AS (PARTITION BY recording_id ORDER BY l_orderkey, line, rr_raw ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        (),
    ),
    "fx_long_rr": (
        """SELECT recording_id, timestamp_ms, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY recording_id ORDER BY timestamp_ms, peak_id) AS rr_prev_ms
           FROM fx_long""",
        ("fx_long",),
    ),
    "fx_noisy": (
        """SELECT *, CAST(floor((timestamp_ms - 1704067200000) / 60000) AS INT) AS segment_idx,
             CAST(row_number() OVER (PARTITION BY recording_id ORDER BY timestamp_ms, peak_id) - 1 AS BIGINT) AS beat_idx
           FROM (SELECT recording_id, peak_id, timestamp_ms, 'detected' AS source FROM fx_beats
                 UNION ALL SELECT recording_id, peak_id + 10000000000, timestamp_ms + 120, 'sandwich' FROM fx_beats
                   WHERE event_type = 'signup' AND value < 15
                 UNION ALL SELECT recording_id, peak_id + 20000000000, timestamp_ms + 5, 'added' FROM fx_beats
                   WHERE event_type = 'click' AND value < 10)""",
        ("fx_beats",),
    ),
    "fx_labels": (
        """SELECT recording_id, peak_id, timestamp_ms, beat_idx, segment_idx,
             CASE WHEN event_type = 'error' THEN 'artifact'
                  WHEN event_type = 'signup' AND value < 30 THEN 'phys_event'
                  WHEN event_type = 'view' AND value < 4 THEN 'interpolated'
                  ELSE 'clean' END AS label,
             (event_type = 'signup' AND value < 30) AS phys_event_window,
             segment_idx % 3 <> 0 AS reviewed, value > 150 AS in_bad_region
           FROM fx_beats""",
        ("fx_beats",),
    ),
    "fx_refs": (
        """SELECT recording_id, peak_id AS ref_id, timestamp_ms + peak_id % 200 - 100 AS ref_ms
           FROM fx_beats WHERE event_type = 'error'""",
        ("fx_beats",),
    ),
    "fx_intervals": (
        """SELECT recording_id, peak_id AS interval_id, timestamp_ms - 5000 AS start_ms,
             timestamp_ms + 5000 + (peak_id % 7) * 1000 AS end_ms
           FROM fx_beats WHERE event_type = 'purchase' AND value > 100""",
        ("fx_beats",),
    ),
    "fx_scores": (
        """SELECT recording_id, peak_id, timestamp_ms, segment_idx, label, reviewed,
             (peak_id * 37 % 1000) / 1000.0::DOUBLE AS p_tab, (peak_id * 61 % 1000) / 1000.0::DOUBLE AS p_wave,
             CASE WHEN label = 'artifact' THEN 1 ELSE 0 END AS truth
           FROM fx_labels""",
        ("fx_labels",),
    ),
    "fx_segq": (
        """SELECT recording_id, segment_idx,
             CASE (recording_id + segment_idx) % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'noisy_ok' ELSE 'clean' END AS quality_label
           FROM (SELECT DISTINCT recording_id, segment_idx FROM fx_beats)""",
        ("fx_beats",),
    ),
    "fx_samples": (
        """SELECT recording_id, timestamp_ms + k * 40 AS timestamp_ms, beat_idx * 8 + k AS sample_idx,
             CAST((peak_id * k) % 17 - 8 AS DOUBLE) AS ecg,
             CAST(floor((timestamp_ms + k * 40 - 1704067200000) / 60000) AS INT) AS segment_idx
           FROM fx_beats, (SELECT unnest(range(0, 8)) AS k)""",
        ("fx_beats",),
    ),
    "fx_waves": (
        """SELECT 0 AS recording_id, vec_id AS peak_id, vec_id AS beat_idx, 1704067200000 + vec_id * 800 + vec_id * 37 % 200 AS timestamp_ms,
             CAST(floor(vec_id / 20) AS INT) AS segment_idx, CASE WHEN label = 0 THEN 'artifact' ELSE 'clean' END AS label, label = 1 AS hard_filtered,
             CAST(embedding AS DOUBLE[]) AS waveform FROM embeddings""",
        (),
    ),
    # one row per sample of a waveform; pos counts from 0
    "fx_wave_pos": (
        """SELECT peak_id, beat_idx, segment_idx, label, hard_filtered, unnest(waveform) AS x,
             unnest(range(0, len(waveform))) AS pos FROM fx_waves""",
        ("fx_waves",),
    ),
    "fx_hourly": (
        """SELECT event_type, CAST(floor((epoch_us(ts) // 1000) / 3600000) AS BIGINT) * 3600000 AS hour_ms, avg(value) AS v
           FROM events GROUP BY ALL""",
        (),
    ),
    # rr_prev and rr_next per beat
    "fx_rr": (
        """SELECT *, timestamp_ms - lag(timestamp_ms) OVER w AS rr_prev_ms,
             lead(timestamp_ms) OVER w - timestamp_ms AS rr_next_ms
           FROM fx_beats WINDOW w AS (PARTITION BY recording_id ORDER BY timestamp_ms, peak_id)""",
        ("fx_beats",),
    ),
}


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` (which may start with further CTEs via ``, x AS``) with
    the CTEs it needs, each once and in order."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        text, needs = CTE[n]
        for m in needs:
            add(m)
        done.setdefault(n, text)

    for n in names:
        add(n)
    head = ",\n".join(f"{n} AS ({t})" for n, t in done.items())
    body = body.strip()
    if not head:
        return body
    return f"WITH {head}{body}" if body.startswith(",") else f"WITH {head}\n{body}"
