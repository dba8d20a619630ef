"""Readers and writers: signal, peak and device CSV, annotation JSON, canonical
Parquet tables, review queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from beatloom.functions.timeparse import any_ms, epoch_any_unit
from beatloom.operators import relational
from beatloom.params import DEFAULTS, LABELS, Params
from beatloom.session import materialise

# Accepted column names, in order of preference.
TIME_NAMES = ("DateTime", "datetime", "timestamp", "Timestamp", "time", "Time")
VALUE_NAMES = ("ECG", "ecg", "ecg_amplitude", "amplitude", "value")


def find_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate the frame has."""
    return next((c for c in candidates if c in df.columns), None)


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the asked columns; an error names the absent ones."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*columns)


def first_present(df: DataFrame, candidates: Sequence[str], default: Column) -> Column:
    """Value of the first present non-null column among ``candidates``."""
    have = [F.col(c) for c in candidates if c in df.columns]
    return F.coalesce(*have, default)


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all CSV files under ``path``: file (name), header and cells, two
    arrays of text. The first line that is not blank is a file's header.

    Headers are found by the tasks that read the files' beginnings and meet the rows
    by a join on the file, so the number of files costs no jobs; the driver learns
    only how many columns the widest header has. Raises without any header.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_row"),  # grows along a split
    )
    first = lines.filter((F.col("_at") == 0) & (F.trim("value") != "")).groupBy("_path").agg(F.min_by("value", "_row").alias("_line"))
    first = materialise(first)
    wide = first.select(F.max(F.size(F.split("_line", ",")))).first()[0]
    if wide is None:
        raise ValueError(f"no CSV file with a header in {path}")
    names = [f"_c{i}" for i in range(wide)]
    schema = ", ".join(f"{n} string" for n in names)
    parsed = F.from_csv("_line", schema)
    heads = first.select("_path", F.filter(F.array(*[parsed[n] for n in names]), lambda x: x.isNotNull()).alias("header"))
    rows = spark.read.csv(path, schema=schema, header=False).select(
        F.array(*names).alias("cells"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file")
    )
    d = rows.join(heads, "_path")
    return d.filter(F.slice("cells", F.lit(1), F.size("header")) != F.col("header")).select("file", "header", "cells")


def cell(names: Sequence[str], otherwise: int | None = None) -> Column:
    """Text of the first of ``names`` that the row's header has, else of the cell at
    ``otherwise``."""
    at = lambda n: F.get("cells", (F.array_position("header", n) - 1).cast("int"))
    out = F.get("cells", F.lit(otherwise)) if otherwise is not None else F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(F.array_contains("header", n), at(n)).otherwise(out)
    return out


def read_signal_csv(spark: SparkSession, path: str, flip: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Samples from CSV files: file, timestamp_ms, ecg in microvolt.

    Each file's own header decides its columns; values are read as text once and
    converted, so a wrong cell drops one row and no schema is inferred from the data.
    """
    d = csv_cells(spark, path).select(
        "file", any_ms(cell(TIME_NAMES, 0)).alias("timestamp_ms"), (cell(VALUE_NAMES, 1).try_cast("double") * 1000.0).alias("ecg")
    )
    d = d.filter((F.col("timestamp_ms") >= p.min_valid_ms) & F.col("ecg").isNotNull() & ~F.isnan("ecg"))
    d = d.filter(F.abs("ecg") < float("inf"))
    if flip is not None:
        sign = F.when(F.coalesce("invert", F.lit(False)), -1.0).otherwise(1.0)
        d = d.join(flip.select("file", "invert"), "file", "left").withColumn("ecg", F.col("ecg") * sign).drop("invert")
    return d


def with_segments(samples: DataFrame, starts: DataFrame, key: Sequence[str] = ("file",), p: Params = DEFAULTS) -> DataFrame:
    d = samples.join(starts, list(key))
    return d.withColumn("segment_idx", F.floor((F.col("timestamp_ms") - F.col("start_ms")) / p.segment_ms).cast("int")).drop("start_ms")


def read_peak_csv(spark: SparkSession, path: str) -> DataFrame:
    """Peak times (peak_id is epoch ms; else the first column), source, flag."""

    d = csv_cells(spark, path).select(
        "file", any_ms(cell(["peak_id"], 0)).alias("timestamp_ms"),
        F.coalesce(cell(["source"]), F.lit("detected")).alias("source"),
        F.coalesce(cell(["is_added_peak"]).try_cast("boolean"), F.lit(False)).alias("is_added_peak"),
        cell(["label"]).try_cast("int").alias("label"),
    )
    return d.filter(F.col("timestamp_ms").isNotNull())


# Every list is optional; mixed entries, objects included, come as text.
ANNOTATIONS = (
    "recording_id string, artifacts array<string>, validated_true_beats array<string>, validated_segments array<string>, bad_segments array<int>,"
    "flagged_poor_quality_segments array<string>, flagged_for_interpolation array<string>, interpolate_peaks array<string>,"
    "manually_added_missed_peaks array<string>, added_r_peaks array<string>,"
    "segment_timestamps array<struct<segment_idx int, first_timestamp string, last_timestamp string>>,"
    "bad_regions array<struct<segment_idx int, start_time string, end_time string>>,"
    "interpolated_replacements array<struct<peak_id string, timestamp string>>,"
    "return_to_pile array<struct<segment_idx int, start_time string, end_time string>>,"
    "tagged_physiological_events array<string>"
)
EVENT = "start string, start_time string, start_timestamp string, end string, end_time string, end_timestamp string, at string"


def read_annotations(spark: SparkSession, path: str, recording_id: str | None = None) -> DataFrame:
    """One row per document; alternate keys folded, absent lists empty.

    Documents without a recording id take ``recording_id``, or else the name of
    their file. Events are objects or bare times; both become ``EVENT`` structs.
    Files are read as text and parsed in memory: the JSON reader fetches every object
    that is kept as text by a read of its own, some KB each. A file may hold an array
    of documents.
    """
    files = spark.read.text(path, wholetext=True)
    text = F.ltrim(F.col("value"), F.lit("\ufeff \t\r\n"))
    many = F.from_json(text, ArrayType(StructType.fromDDL(ANNOTATIONS)))
    one = F.from_json(text, ANNOTATIONS)
    parsed = F.when(F.startswith(text, F.lit("[")), many).otherwise(F.array(one))
    kept = [F.col(c) for c in files.columns if c != "value"]  # partition columns
    d = files.filter(text != "").select(*kept, F.col("_metadata.file_name").alias("_file"), F.explode(F.coalesce(parsed, F.array(one))).alias("_d"))
    named = [c for c in StructType.fromDDL(ANNOTATIONS).names if c not in files.columns]
    raw = d.select("*", *[F.col(f"_d.{c}").alias(c) for c in named]).drop("_d")
    if "recording_id" in files.columns:
        raw = raw.withColumn("recording_id", F.col("recording_id").cast("string"))
    name = F.regexp_replace("_file", r"\.[^.]*$", "") if recording_id is None else F.lit(recording_id)
    raw = raw.withColumn("recording_id", F.coalesce("recording_id", name)).drop("_file")
    bare = [F.lit(None).cast("string").alias(f) for f in EVENT.replace(" string", "").split(", ")[:-1]]
    event = lambda e: F.when(F.startswith(F.ltrim(e), F.lit("{")), F.from_json(e, EVENT)).otherwise(F.struct(*bare, e.alias("at")))
    raw = raw.withColumn("tagged_physiological_events", F.transform("tagged_physiological_events", event))
    pairs = {
        "validated_segments": ("validated_true_beats", "validated_segments"),
        "added_peaks": ("manually_added_missed_peaks", "added_r_peaks"),
        "to_interpolate": ("interpolate_peaks", "flagged_for_interpolation"),
    }
    out = raw.withColumns({n: F.coalesce(*c, F.array().cast("array<string>")) for n, c in pairs.items()})
    out = out.drop(*[c for cs in pairs.values() for c in cs if c not in pairs])
    types = dict(out.dtypes)
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(t)) for c, t in types.items() if t.startswith("array")})


def times_of(docs: DataFrame, column: str, name: str = "ref_ms") -> DataFrame:
    """Parsed times of one annotation list, one row each."""
    d = docs.select("recording_id", F.explode(column).alias("_t")).select("recording_id", any_ms(F.col("_t")).alias(name))
    return d.filter(F.col(name).isNotNull())


def repair_lines(lines: DataFrame, columns: Sequence[str], text: str = "value") -> DataFrame:
    """CSV lines with surplus commas: the overflow belongs to the last column."""
    parts = F.split(F.col(text), ",", -1)
    n = len(columns)
    cells = [F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns[:-1])]
    tail = F.array_join(F.slice(parts, n, F.greatest(F.size(parts) - n + 1, F.lit(0))), ",").alias(columns[-1])
    keep = [c for c in lines.columns if c != text]
    return lines.filter(F.size(parts) >= n).select(*keep, *cells, tail)


def device_tables(raw: DataFrame, time: str = "time", min_abs: float = 1e8, max_ms: float = 2.6e12) -> dict[str, DataFrame]:
    """One wide device table to ECG, HR, RR and marker tables.

    ``raw``: time (ns, ms or s), ecg, hr, rr, marker and an ``arrival`` order.
    The four results share the scan; each keeps what its rule says: first (ECG)
    or last (others) of equal keys.
    """
    d = raw.withColumn("_t", F.col(time)).filter(F.abs("_t") >= min_abs)
    d = d.withColumn("timestamp_ms", epoch_any_unit(F.col("_t"))).filter(F.col("timestamp_ms").between(0, max_ms))
    k = [c for c in ("recording_id",) if c in raw.columns]

    def part(value: str, key: Sequence[str], newest: bool, cast: str, factor: float = 1.0) -> DataFrame:
        p = d.filter(F.col(value).isNotNull()).select(
            *k, "timestamp_ms", "arrival", (F.col(value).cast("double") * factor).cast(cast).alias(value)
        )
        return relational.latest(p, [*k, *key], ["arrival"], newest).drop("arrival")

    marks = d.filter(F.col("marker").isNotNull()).select(*k, "timestamp_ms", "arrival", "marker")
    return {
        "ecg": part("ecg", ["timestamp_ms", "ecg"], False, "double", 1000.0),
        "hr": part("hr", ["timestamp_ms"], True, "int"),
        "rr": part("rr", ["timestamp_ms", "rr"], True, "int"),
        "marker": relational.latest(marks, [*k, "timestamp_ms"], ["arrival"]).drop("arrival"),
    }


def plausible_times(df: DataFrame, raw: str, min_abs: float = 1e8, max_ms: float = 2.6e12) -> DataFrame:
    d = df.filter(F.abs(F.col(raw)) >= min_abs).withColumn("timestamp_ms", epoch_any_unit(F.col(raw)))
    return d.filter(F.col("timestamp_ms").between(0, max_ms))


# ---- canonical Parquet tables ----------------------------------------------


def write_table(df: DataFrame, path: str, segment: str = "segment_idx", per_bucket: int = 1440) -> None:
    """Parquet by recording and segment bucket (a day of one-minute segments),
    sorted by segment inside a file so that row-group statistics prune.

    The bucket is part of the shuffle key: a long recording spreads over tasks.
    """
    d = df.withColumn("segment_bucket", F.floor(F.col(segment) / per_bucket).cast("int"))
    d = d.repartition("recording_id", "segment_bucket").sortWithinPartitions("recording_id", "segment_bucket", segment)
    d.write.mode("overwrite").partitionBy("recording_id", "segment_bucket").parquet(path)


def scan_segments(df: DataFrame, lo: int, hi: int, columns: Sequence[str], margin: int = 1, per_bucket: int = 1440) -> DataFrame:
    """Rows of segments [lo - margin, hi + margin]; partitions, row groups and
    columns are pruned by the scan."""
    a, b = lo - margin, hi + margin
    if "segment_bucket" in df.columns:
        df = df.filter(F.col("segment_bucket").between(a // per_bucket, b // per_bucket))
    return df.filter(F.col("segment_idx").between(a, b)).select(*columns)


def scan_times(df: DataFrame, lo_ms: int, hi_ms: int, ts: str = "timestamp_ms") -> DataFrame:
    return df.filter(F.col(ts).between(lo_ms, hi_ms))


def scan_ids(df: DataFrame, ids: DataFrame, key: str = "peak_id") -> DataFrame:
    """Rows whose id is listed; Spark chooses broadcast by the list's size."""
    return df.join(ids.select(key), key, "left_semi")


def table_summary(df: DataFrame, ts: str, label: str) -> DataFrame:
    """Rows, time range and share per label."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"))
    total = c.agg(F.sum("n").alias("n_all"), F.min("first_ms").alias("table_first_ms"), F.max("last_ms").alias("table_last_ms"))
    return c.crossJoin(F.broadcast(total)).withColumn("pct", F.col("n") * 100.0 / F.col("n_all"))


def file_ranges(df: DataFrame, file: str, ts: str = "timestamp_ms") -> DataFrame:
    return df.groupBy(file).agg(F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"))


def edge_times(spark: SparkSession, path: str, by: Sequence[str] = ("recording_id",), ts: str = "timestamp_ms",
               partitions: Sequence[str] = ("recording_id", "segment_bucket")) -> DataFrame:
    """First and last time by some of the ``partitions`` (all of the table's) of a
    Parquet table, from the files' footers alone: no data column is read.

    The scan answers min and max from the row-group
    statistics; it does so only with settings that would change other queries, so
    the result belongs to a session of its own and is for reading, not for joins.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    edges = own.read.parquet(path).groupBy(*partitions).agg(F.min(ts).alias("first_ms"), F.max(ts).alias("last_ms"))
    return edges.groupBy(*by).agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def overlapping_files(ranges: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Files whose [first, last] meets [start, end), clamped, with duration."""
    d = ranges.filter((F.col("last_ms") >= start_ms) & (F.col("first_ms") < end_ms))
    a, b = F.greatest("first_ms", F.lit(start_ms)), F.least("last_ms", F.lit(end_ms))
    return d.withColumns({"from_ms": a, "to_ms": b, "duration_ms": b - a})


def merge_append(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old and new rows, the new one winning; the caller overwrites the
    partitions it read or merges into a table format."""
    return relational.upsert(old, new, key)


def merge_into(path: str, new: DataFrame, key: Sequence[str], partitions: Sequence[str], schema: StructType | None = None) -> None:
    """Upsert ``new`` into a partitioned Parquet table, the new rows winning. A table
    that may still be without rows needs its ``schema``.

    Only partitions that ``new`` touches are read and written; the merged rows are
    written aside first, since a table cannot be read while it is overwritten. A
    partition is one task's to write, so it is one file and not one per task.
    """
    read = new.sparkSession.read
    old = (read if schema is None else read.schema(schema)).parquet(path)
    touched = old.join(new.select(*partitions).distinct(), list(partitions), "left_semi").select(*old.columns)
    merged = materialise(merge_append(touched, new.select(*old.columns), key))
    merged = merged.repartition(*partitions)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


# ---- review queues -----------------------------------------------------------


def export_queue(candidates: DataFrame, path: str) -> None:
    """One JSON record per candidate (with context arrays) and a CSV summary."""
    candidates.write.mode("overwrite").json(f"{path}/records")
    flat = [c for c, t in candidates.dtypes if not t.startswith(("array", "struct", "map"))]
    candidates.select(*flat).write.mode("overwrite").csv(f"{path}/summary", header=True)


def check_completed(done: DataFrame, expected: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """One row of problem counts: unknown ids, unknown labels, duplicates."""
    ids = expected.select("peak_id").distinct().withColumn("_ok", F.lit(True))
    d = done.join(ids, "peak_id", "left")
    dup = done.groupBy("peak_id").count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, 1)), F.lit(0)).alias("duplicates"))
    return d.agg(
        F.count_if(F.col("_ok").isNull()).alias("unknown_ids"),
        F.count_if(~F.coalesce(F.col("label").isin(*labels), F.lit(False))).alias("unknown_labels"),
    ).crossJoin(F.broadcast(dup))


def import_completed(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Completed annotations; raises when ids or labels are not expected."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    done = required(raw, ["peak_id", "label"]).withColumn("peak_id", F.col("peak_id").try_cast("long"))
    found = check_completed(done, expected).first()
    if found["unknown_ids"] or found["unknown_labels"]:
        raise ValueError(f"completed annotations rejected: {found.asDict()}")
    return done


def reviewed_queue(completed: DataFrame, records: DataFrame, key: Sequence[str] = ("queue", "peak_id")) -> DataFrame:
    """Completed labels with their records; labels without a record are skipped."""
    return completed.join(records, list(key)).orderBy("timestamp_ms", "peak_id")
