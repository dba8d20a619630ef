"""Fusion of two score tables, uncertainty, and grid tuning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.operators.evaluation import average_precision
from beatloom.params import DEFAULTS


def uncertainty(df: DataFrame, score: str, name: str = "uncertainty") -> DataFrame:
    return df.withColumn(name, F.lit(1.0) - F.lit(2.0) * F.abs(F.col(score) - 0.5))


def fuse(
    tabular: DataFrame,
    waveform: DataFrame,
    alpha: float = DEFAULTS.ensemble_alpha,
    threshold: float = DEFAULTS.ensemble_threshold,
    key: str = "peak_id",
    p1: str = "p_tab",
    p2: str = "p_wave",
) -> DataFrame:
    """Weighted score of both models per beat, their disagreement, uncertainty
    and decision. Beats missing on one side are left out."""
    d = tabular.select(key, p1).join(waveform.select(key, p2), key)
    d = d.withColumns(
        {
            "p_ensemble": F.lit(alpha) * F.col(p1) + F.lit(1 - alpha) * F.col(p2),
            "disagreement": F.abs(F.col(p1) - F.col(p2)),
        }
    )
    return uncertainty(d, "p_ensemble", "uncertainty_ensemble").withColumn(
        "predicted_artifact", F.col("p_ensemble") >= threshold
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The same frame, or an error when it is empty (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


ALPHA_GRID = tuple(round(0.1 * i, 1) for i in range(1, 10))


def tune_alpha(
    scored: DataFrame, truth: str, p1: str = "p_tab", p2: str = "p_wave", grid: Sequence[float] = ALPHA_GRID
) -> DataFrame:
    """Average precision per weight and the best weight (first on ties; an
    undefined value counts as -1)."""
    d = scored.select(F.col(truth).alias("_t"), p1, p2).withColumn(
        "alpha", F.explode(F.array(*[F.lit(float(a)) for a in grid]))
    )
    d = d.withColumn("_s", F.col("alpha") * F.col(p1) + (F.lit(1.0) - F.col("alpha")) * F.col(p2))
    ap = average_precision(d, "_s", "_t", ["alpha"])
    ap = ap.withColumn("average_precision", F.coalesce("average_precision", F.lit(-1.0)))
    best = ap.agg(F.max_by("alpha", F.struct(F.round("average_precision", 12), -F.col("alpha"))).alias("_b"))
    return ap.crossJoin(F.broadcast(best)).select(
        "alpha", "average_precision", (F.col("alpha") == F.col("_b")).alias("is_best")
    )


def rule_baseline(df: DataFrame, zcr: str, density: str, entropy: str, max_entropy: float) -> DataFrame:
    """Bad by rule: many zero crossings, few beats or a flat spectrum."""
    return df.withColumn(
        "rule_bad", (F.col(zcr) > 0.5) | (F.col(density) < 0.3) | (F.col(entropy) > max_entropy)
    )


def tune_threshold(df: DataFrame, value: str, truth: str, grid: Sequence[float]) -> DataFrame:
    """Average precision of ``value > t`` for each threshold of the grid; the
    best is the first with the largest one."""
    d = df.select(F.col(truth).alias("_t"), value).withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in grid]))
    )
    d = d.withColumn("_s", (F.col(value) > F.col("threshold")).cast("double"))
    ap = average_precision(d, "_s", "_t", ["threshold"])
    best = ap.agg(F.max_by("threshold", F.struct(F.round("average_precision", 12), -F.col("threshold"))).alias("_b"))
    return ap.crossJoin(F.broadcast(best)).select(
        "threshold", "average_precision", (F.col("threshold") == F.col("_b")).alias("is_best")
    )
