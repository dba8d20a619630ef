"""Equi joins, set operations, upserts, top-k and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.params import SERIES, Series


def left_default(
    df: DataFrame, other: DataFrame, key: Sequence[str], columns: Sequence[str], default: float = 0.0,
    order: str | None = None,
) -> DataFrame:
    """Left join that never changes the row count: the last row per key of
    ``other`` (by ``order``) wins, missing values become ``default``."""
    cols = F.struct(*columns)
    one = other.groupBy(*key).agg((F.max_by(cols, F.col(order)) if order else F.max(cols)).alias("_o"))
    out = df.join(one, list(key), "left")
    return out.select(
        *df.columns, *[F.coalesce(F.col(f"_o.{c}"), F.lit(default)).alias(c) for c in columns]
    )


def star_join(
    features: DataFrame, labels: DataFrame, peaks: DataFrame, quality: DataFrame, key: str = "peak_id",
    segment: Sequence[str] = ("recording_id", "segment_idx"),
) -> DataFrame:
    """features with labels, segments and segment quality (missing -> clean).

    The quality table is reduced to one row per segment first.
    """
    dim = quality.groupBy(*segment).agg(F.max("quality_label").alias("quality_label"))
    d = features.join(labels, key).join(peaks.select(key, *segment), key)
    return d.join(dim, list(segment), "left").withColumn(
        "quality_label", F.coalesce("quality_label", F.lit("clean"))
    )


def replace_rows(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in ``new``, then the new rows."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str], newest: bool = True) -> DataFrame:
    """One row per key: the last (or first) in ``order``.

    An aggregate, not a window: partial results shrink a hot key before the
    shuffle.
    """
    rank = F.struct(*order)
    pick = (F.max_by if newest else F.min_by)(F.struct(*df.columns), rank)
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(pick.alias("_r")).select("_r.*")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union where the new row of a key wins."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return latest(both, key, ["_v"]).drop("_v")


def union_tagged(parts: Mapping[str, DataFrame], column: str = "origin") -> DataFrame:
    out = None
    for tag, df in parts.items():
        df = df.withColumn(column, F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def first_tag(df: DataFrame, key: Sequence[str], tag: str, ranks: Sequence[str]) -> DataFrame:
    """One row per key, the tag named first in ``ranks`` wins."""
    order = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col(tag))
    return latest(df.withColumn("_rank", order), key, ["_rank"], newest=False).drop("_rank")


def minus(base: DataFrame, *others: DataFrame, key: Sequence[str]) -> DataFrame:
    out = base.select(*key).distinct()
    for o in others:
        out = out.join(o.select(*key), list(key), "left_anti")
    return out


def top_n(df: DataFrame, score: str, n: int, tie: str = "peak_id") -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(n)


def top_n_filtered(df: DataFrame, score: str, n: int, oversample: int, keep: Column, tie: str = "peak_id") -> DataFrame:
    """The n best of the n*oversample best that pass ``keep``."""
    return top_n(top_n(df, score, n * oversample, tie).filter(keep), score, n, tie)


def top_n_per_category(
    df: DataFrame, categories: Mapping[str, tuple[Column, Column, bool]], n: int, tie: str = "peak_id"
) -> DataFrame:
    """Best ``n`` rows of each category (filter, sort key, ascending) in one scan.

    A row is copied to the categories it matches; the rank filter lets Spark
    keep only ``n`` rows per category and task before the shuffle.
    """
    tags = [
        F.when(test, F.struct(F.lit(name).alias("category"), (key if asc else -key).alias("sort_key")))
        for name, (test, key, asc) in categories.items()
    ]
    d = df.withColumn("_c", F.explode(F.array_compact(F.array(*tags)))).select(*df.columns, "_c.*")
    w = Window.partitionBy("category").orderBy("sort_key", tie)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("sort_key")


def apply_order(df: DataFrame, order: DataFrame, key: str, position: str, s: Series = SERIES) -> DataFrame:
    """Listed rows in list order, then the rest by time, as 1-based out_pos;
    ids the table does not hold are ignored."""
    from beatloom.plans.ordered import RANGE, in_ranges, running

    d = df.join(order, key, "left")
    unlisted = F.col(position).isNull()
    d = d.withColumn("_pos", F.when(unlisted, F.col(s.ts)).otherwise(F.col(position)).cast("long"))
    d = d.withColumn("_late", unlisted.cast("int"))
    d = in_ranges(d, "_late", "_pos", key)
    whole = Series(key=("_late",), ts="_pos", tie=key, idx="_")
    d = running(d, {"_rank": ("sum", F.lit(1).cast("long"))}, whole, position=F.col(RANGE), width=1, order=("_pos", key))
    listed = df.join(order.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("_n"))
    return d.crossJoin(F.broadcast(listed)).withColumn(
        "out_pos", F.col("_rank") + F.when(unlisted, F.col("_n")).otherwise(F.lit(0))
    ).drop("_rank", "_pos", "_late", "_n", RANGE)


def coverage(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys in both, only old, only new; one aggregate after a tagged union."""
    both = (
        old.select(*key).distinct().withColumn("_s", F.lit(1))
        .unionByName(new.select(*key).distinct().withColumn("_s", F.lit(2)))
        .groupBy(*key).agg(F.sum("_s").alias("_s"))
    )
    return both.agg(
        F.count_if(F.col("_s") == 3).alias("both"),
        F.count_if(F.col("_s") == 1).alias("only_old"),
        F.count_if(F.col("_s") == 2).alias("only_new"),
    )


def integrity_checks(
    peaks: DataFrame, labels: DataFrame, segments: DataFrame, samples: DataFrame,
    segment: Sequence[str] = ("recording_id", "segment_idx"),
) -> DataFrame:
    """(check_name, violations) over the canonical tables."""
    seg = list(segment)

    def missing(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
        return a.select(*key).distinct().join(b.select(*key), list(key), "left_anti").agg(F.count(F.lit(1)).alias("violations"))

    checks = {
        "labels_without_peak": missing(labels, peaks, ["peak_id"]),
        "peaks_without_label": missing(peaks, labels, ["peak_id"]),
        "segments_without_samples": missing(segments, samples, seg),
        "peak_segments_unknown": missing(peaks, segments, seg),
        "null_times": peaks.agg(F.count_if(F.col("timestamp_ms").isNull()).alias("violations")),
        "null_labels": labels.agg(F.count_if(F.col("label").isNull()).alias("violations")),
        "duplicate_peak_ids": peaks.groupBy("peak_id").count().agg(F.count_if(F.col("count") > 1).alias("violations")),
    }
    out = None
    for name, df in checks.items():
        df = df.select(F.lit(name).alias("check_name"), "violations")
        out = df if out is None else out.unionByName(df)
    return out


def check_types(df: DataFrame, expected: Mapping[str, str]) -> None:
    """Raise if a column is absent or of another type."""
    have = dict(df.dtypes)
    wrong = {c: (have.get(c), t) for c, t in expected.items() if have.get(c) != t}
    if wrong:
        raise TypeError(f"columns differ (found, expected): {wrong}")
