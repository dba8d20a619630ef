"""Column maintenance, filters and encodings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.params import DEFAULT_DECIMALS, METRIC_DECIMALS, STAT_COLUMNS, Series, metrics_for

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")


def segment_bucket(df: DataFrame, ts: str, start_ms: str | int, width_ms: int = 60_000) -> DataFrame:
    t0 = F.col(start_ms) if isinstance(start_ms, str) else F.lit(start_ms)
    return df.withColumn("segment_idx", F.floor((F.col(ts) - t0) / width_ms).cast("int"))


def scale_signal(df: DataFrame, flags: DataFrame, key: Sequence[str], value: str = "ecg", factor: float = 1000.0) -> DataFrame:
    """Unit change and sign flip; ``flags`` holds one ``invert`` row per file."""
    sign = F.when(F.coalesce("invert", F.lit(False)), F.lit(-1.0)).otherwise(F.lit(1.0))
    out = df.join(flags.select(*key, "invert"), list(key), "left")
    return out.withColumn(value, F.col(value) * factor * sign).drop("invert")


def training_rows(
    df: DataFrame, *, drop_whole_bad_segments: bool = False, drop_unreviewed_artifacts: bool = False,
    drop_hard_filtered: bool = False,
) -> DataFrame:
    """Rows a beat model may learn from.

    The lenient form keeps artifacts of bad segments and unreviewed artifacts;
    the strict form drops both.
    """
    artifact = F.col("label") == "artifact"
    bad = F.col("quality_label") == "bad"
    out = df.filter(~F.coalesce(bad, F.lit(False)) if drop_whole_bad_segments else ~F.coalesce(bad & ~artifact, F.lit(False)))
    out = out.filter(~F.col("in_bad_region") & (F.col("label") != "interpolated"))
    out = out.filter(F.col("reviewed") if drop_unreviewed_artifacts else (F.col("reviewed") | artifact))
    return out.filter(~F.col("hard_filtered")) if drop_hard_filtered else out


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("label", "segment_idx")) -> list[str]:
    """Numeric columns that are neither keys, labels nor ``*_id``."""
    return [
        n
        for n, t in df.dtypes
        if t.split("(")[0] in NUMERIC and n not in exclude and not n.endswith("_id")
    ]


def patch_columns(df: DataFrame, newer: DataFrame, key: Sequence[str], columns: Sequence[str], default: int = 0) -> DataFrame:
    """Replace ``columns`` by the newer table's values, ``default`` where absent."""
    new = newer.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept).join(new, list(key), "left").select(
        *kept, *[F.coalesce(F.col(f"_{c}"), F.lit(default)).alias(c) for c in columns]
    )


def backfill(df: DataFrame, via: DataFrame, dim: DataFrame, key: str, dim_key: Sequence[str], column: str) -> DataFrame:
    """Bring ``column`` of ``dim`` onto ``df`` through the lookup ``via``."""
    return df.join(via.select(key, *dim_key), key, "left").join(dim.select(*dim_key, column), list(dim_key), "left")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def metric_subset(df: DataFrame, timeframe: str, keys: Sequence[str]) -> DataFrame:
    """The metric columns that are valid for the timeframe, as far as present."""
    return df.select(*keys, *[c for c in metrics_for(timeframe) if c in df.columns])


def stats_and_metrics(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Window descriptions and variability metrics as two tables."""
    stats = [c for c in df.columns if c in STAT_COLUMNS]
    rest = [c for c in df.columns if c not in STAT_COLUMNS and c not in keys]
    return df.select(*keys, *stats), df.select(*keys, *rest)


def round_metrics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {c: F.round(F.col(c), METRIC_DECIMALS.get(c, DEFAULT_DECIMALS)) for c in columns}
    )


def one_hot(df: DataFrame, column: str, prefix: str, values: Sequence[str]) -> DataFrame:
    """0/1 column per category of the given vocabulary; a missing category is all zeros."""
    return df.withColumns(
        {f"{prefix}{v}": F.when(F.col(column) == v, F.lit(1.0)).otherwise(F.lit(0.0)) for v in values}
    )


def encode(df: DataFrame, column: str, codes: Mapping[str, int], name: str) -> DataFrame:
    """Category -> code; rows with an unknown category are dropped."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return df.withColumn(name, F.create_map(*pairs)[F.col(column)]).filter(F.col(name).isNotNull())


def decode(df: DataFrame, column: str, codes: Mapping[str, int], name: str) -> DataFrame:
    pairs = [F.lit(x) for k, v in codes.items() for x in (v, k)]
    return df.withColumn(name, F.create_map(*pairs)[F.col(column)])


def without_bad_segments(
    df: DataFrame, quality: DataFrame, key: Sequence[str], include_noisy: bool = False
) -> DataFrame:
    drop = quality.filter(F.col("quality_label").isin(*(["bad", "noisy_ok"] if include_noisy else ["bad"])))
    return df.join(drop.select(*key), list(key), "left_anti")


def score_range(df: DataFrame, low: Mapping[str, float] | None = None, below: Mapping[str, float] | None = None) -> DataFrame:
    for c, v in (low or {}).items():
        df = df.filter(F.col(c) >= v)
    for c, v in (below or {}).items():
        df = df.filter(F.col(c) < v)
    return df


def flags_to_int(df: DataFrame, flags: Sequence[str], scores: Sequence[str] = ()) -> DataFrame:
    """Booleans as 0/1 and scores as numbers; absent columns and nulls are 0."""
    have = set(df.columns)
    cols = {f: F.coalesce(F.col(f).cast("int"), F.lit(0)) if f in have else F.lit(0) for f in flags}
    cols |= {
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0) for c in scores
    }
    return df.withColumns(cols)


def oversample(
    df: DataFrame, label: str, weights: Mapping[str, float], seed: int, n: int | None = None, key: str = "peak_id"
) -> DataFrame:
    """Exactly ``n`` rows (default: as many as there are) drawn with replacement,
    each draw by the weight of the class; classes without a weight have 1.

    Rows own stretches of the line of summed weights; ``n`` hashed points are laid
    on it, and both are put in one order, where each point takes the last row
    before it. Points per row are counted, so only counts are joined back.
    """
    from beatloom.plans.ordered import RANGE, in_ranges, running

    whole = Series(key=(), ts=RANGE, tie=key, idx="_")
    rows = class_weights(df.select(key, label), label, weights, "_w").filter("_w > 0")
    rows = in_ranges(rows.select(key, "_w"), key)
    rows = running(rows, {"_from": ("sum", F.col("_w"))}, whole, position=F.col(RANGE), width=1, order=(key,), exclusive=True)
    size = rows.agg(F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    draws = df.sparkSession.range(n) if n is not None else df.select(F.xxhash64(key).alias("id"))
    unit = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    points = draws.crossJoin(F.broadcast(size)).select((unit * F.col("_total")).alias("_at"), F.lit(None).cast(df.schema[key].dataType).alias(key))
    line = rows.select(F.col("_from").alias("_at"), key).unionByName(points).withColumn("_point", F.col(key).isNull().cast("int"))
    line = in_ranges(line, "_at", "_point")
    line = running(line, {"_hit": ("last", F.col(key))}, whole, position=F.col(RANGE), width=1, order=("_at", "_point"))
    times = line.filter("_point = 1").groupBy(F.col("_hit").alias(key)).agg(F.count(F.lit(1)).cast("int").alias("_times"))
    return df.join(times, key).withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def class_weights(df: DataFrame, label: str, weights: Mapping[str, float], name: str = "weight") -> DataFrame:
    w = F.lit(1.0)
    for k, v in weights.items():
        w = F.when(F.col(label) == k, F.lit(float(v))).otherwise(w)
    return df.withColumn(name, w)


def usable_columns(df: DataFrame, columns: Sequence[str], max_null_share: float = 0.3) -> DataFrame:
    """(column, null_share, varies, usable), in one pass over the table.

    More than one distinct value is the same as min < max, which needs no set
    of values.
    """
    wide = df.agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"_n_{c}") for c in columns],
        *[(F.min(c) < F.max(c)).alias(f"_v_{c}") for c in columns],
    )
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"_n_{c}").alias("null_share"),
            F.coalesce(f"_v_{c}", F.lit(False)).alias("varies"),
        )
        for c in columns
    ]
    out = wide.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return out.withColumn("usable", (F.col("null_share") < max_null_share) & F.col("varies"))


def classify_range(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``<metric>_class``: low / normal / high."""
    return df.withColumns(
        {
            f"{m}_class": F.when(F.col(m) < lo, "low").when(F.col(m) > hi, "high").when(F.col(m).isNotNull(), "normal")
            for m, (lo, hi) in ranges.items()
            if m in df.columns
        }
    )
