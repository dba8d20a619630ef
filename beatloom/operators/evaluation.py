"""Evaluation of scores and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.operators.aggregates import by
from beatloom.params import Series
from beatloom.plans.ordered import RANGE, in_ranges, running
from beatloom.plans.quantiles import exact_quantiles


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def confusion(df: DataFrame, truth: str, pred: str, classes: Sequence, group: Sequence[str] = ()) -> DataFrame:
    """Counts for every (truth, pred) pair of the vocabulary, zeros included."""
    pairs = [(t, p) for t in classes for p in classes]
    wide = df.groupBy(*group).agg(
        *[F.count_if((F.col(truth) == t) & (F.col(pred) == p)).alias(f"_c{i}") for i, (t, p) in enumerate(pairs)]
    )
    cells = [
        F.struct(F.lit(t).alias("truth"), F.lit(p).alias("pred"), F.col(f"_c{i}").alias("n"))
        for i, (t, p) in enumerate(pairs)
    ]
    return wide.select(*group, F.explode(F.array(*cells)).alias("_c")).select(*group, "_c.*")


def class_report(df: DataFrame, truth: str, pred: str, classes: Sequence) -> DataFrame:
    """Precision, recall, F1 and support per class, and their macro F1."""
    cm = confusion(df, truth, pred, classes)
    cells = []
    for c in classes:
        cells.append(
            F.struct(
                F.lit(c).alias("cls"),
                F.sum(F.when((F.col("truth") == c) & (F.col("pred") == c), F.col("n")).otherwise(0)).alias("tp"),
                F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias("n_pred"),
                F.sum(F.when(F.col("truth") == c, F.col("n")).otherwise(0)).alias("support"),
            )
        )
    rows = cm.agg(F.array(*cells).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")
    p, r = _div(F.col("tp"), F.col("n_pred")), _div(F.col("tp"), F.col("support"))
    out = rows.select("cls", "support", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))
    macro = out.agg(F.avg("f1").alias("macro_f1"))
    return out.crossJoin(F.broadcast(macro))


def threshold_metrics(df: DataFrame, score: str, truth: str, threshold: float) -> DataFrame:
    hit, pos = F.col(score) >= threshold, F.col(truth) == 1
    c = df.agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn")
    )
    p = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def calibration(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """Mean score, actual rate and count per equal-width bin, empty bins as 0."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    c = df.groupBy(b.alias("bin")).agg(
        F.avg(score).alias("predicted"), F.avg(F.col(truth)).alias("actual"), F.count(F.lit(1)).alias("n")
    )
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(c), "bin", "left").fillna(0.0, ["predicted", "actual"]).fillna(0, ["n"])


def score_curve(df: DataFrame, score: str, truth: str, group: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, descending: positives and rows at it and up to it.

    Rows meet once as counts per score; the running sums go over ranges of scores
    that hold about equal numbers of them, wherever the scores gather.
    """
    pts = df.groupBy(*group, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == 1).alias("pos")
    ).withColumn("_neg", -F.col("score"))
    pts = in_ranges(pts, *group, "_neg")
    totals = pts.groupBy(*group).agg(F.sum("n").alias("n_all"), F.sum("pos").alias("n_pos"))
    s = Series(key=tuple(group), ts=RANGE, tie="_neg", idx="_")
    pts = running(
        pts,
        {"cum_n": ("sum", F.col("n")), "tp": ("sum", F.col("pos"))},
        s,
        position=F.col(RANGE),
        width=1,
        order=("_neg",),
    ).drop("_neg", RANGE)
    return by(pts, totals, group)


def average_precision(df: DataFrame, score: str, truth: str, group: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision, null without both classes."""
    return score_curve(df, score, truth, group).groupBy(*group).agg(_precision_sum().alias("average_precision"))


def _precision_sum() -> Column:
    step = F.col("pos") / F.col("n_pos") * (F.col("tp") / F.col("cum_n"))
    both = (F.max("n_pos") > 0) & (F.max("n_pos") < F.max("n_all"))
    return F.when(both, F.sum(step))


def roc_auc(df: DataFrame, score: str, truth: str, group: Sequence[str] = ()) -> DataFrame:
    """Rank statistic; equal scores count half. Null without both classes."""
    return score_curve(df, score, truth, group).groupBy(*group).agg(_rank_area().alias("roc_auc"))


def _rank_area() -> Column:
    neg = F.col("n") - F.col("pos")
    area = F.sum(neg * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    pairs = F.max("n_pos") * (F.max("n_all") - F.max("n_pos"))
    return F.when(pairs > 0, area / pairs)


def aucs(df: DataFrame, score: str, truth: str, group: Sequence[str] = ()) -> DataFrame:
    """Both areas from one curve."""
    c = score_curve(df, score, truth, group)
    return c.groupBy(*group).agg(_precision_sum().alias("average_precision"), _rank_area().alias("roc_auc"))


def pr_curve(df: DataFrame, score: str, truth: str) -> DataFrame:
    c = score_curve(df, score, truth)
    p, r = F.col("tp") / F.col("cum_n"), _div(F.col("tp"), F.col("n_pos"))
    return c.select("score", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"))


def operating_points(
    df: DataFrame, score: str, truth: str, min_precision: float = 0.9, min_recall: float = 0.9
) -> DataFrame:
    """Thresholds of the best F1, of the best recall at the asked precision and
    of the best precision at the asked recall (lowest threshold on ties), with
    the highest / lowest threshold where none qualifies."""
    c = pr_curve(df, score, truth)
    low = -F.col("score")

    def best(by_col: str, ok: Column | None = None) -> Column:
        rank = F.struct(F.col(by_col), low)
        return F.max_by("score", rank if ok is None else F.when(ok, rank))

    return c.agg(
        best("f1").alias("best_f1_threshold"),
        F.max("f1").alias("best_f1"),
        F.coalesce(best("recall", F.col("precision") >= min_precision), F.max("score")).alias("precision_threshold"),
        F.coalesce(best("precision", F.col("recall") >= min_recall), F.min("score")).alias("recall_threshold"),
    )


def model_comparison(
    old: DataFrame, new: DataFrame, score: str, threshold: float, key: Sequence[str] = ("peak_id",),
    reviewed: str = "reviewed", warn_shift: float = 0.05,
) -> DataFrame:
    """Flag shares, mean scores, agreement, flips and the boundary-shift warning
    of two score tables over the same beats, in one pass after the join."""
    j = old.select(*key, F.col(score).alias("_o")).join(
        new.select(*key, F.col(score).alias("_n"), F.col(reviewed).alias("_r")), list(key)
    )
    o, n = F.col("_o") >= threshold, F.col("_n") >= threshold
    return j.agg(
        F.count(F.lit(1)).alias("n_beats"),
        F.avg(o.cast("double")).alias("old_share"),
        F.avg(n.cast("double")).alias("new_share"),
        F.avg("_o").alias("old_mean"),
        F.avg("_n").alias("new_mean"),
        F.avg((o == n).cast("double")).alias("agreement"),
        F.count_if(~o & n).alias("clean_to_artifact"),
        F.count_if(o & ~n).alias("artifact_to_clean"),
        F.count_if((o != n) & F.col("_r")).alias("reviewed_flips"),
    ).withColumn("shift_warning", F.abs(F.col("new_share") - F.col("old_share")) > warn_shift)


def template_thresholds(
    df: DataFrame, value: str, label: str, clean: str = "clean", artifact: str = "artifact"
) -> DataFrame:
    """p5 of the clean and p90 of the artifact values, what each retains, and
    the ambiguous zone between them."""
    is_clean, is_art = F.col(label) == clean, F.col(label) == artifact
    a = exact_quantiles(df.filter(is_clean), value, {"clean_p5": 0.05})
    b = exact_quantiles(df.filter(is_art), value, {"artifact_p90": 0.90})
    v, lo, hi = F.col(value), F.col("artifact_p90"), F.col("clean_p5")
    ends = a.crossJoin(F.broadcast(b))
    return df.crossJoin(F.broadcast(ends)).groupBy("clean_p5", "artifact_p90").agg(
        F.count_if(is_clean & (v >= hi)).alias("clean_above"),
        F.count_if(is_art & (v >= hi)).alias("artifact_above"),
        F.count_if(is_clean & (v <= lo)).alias("clean_below"),
        F.count_if(is_art & (v <= lo)).alias("artifact_below"),
        F.count_if(is_clean & (v > lo) & (v < hi)).alias("clean_ambiguous"),
        F.count_if(is_art & (v > lo) & (v < hi)).alias("artifact_ambiguous"),
        F.max(lo >= hi).alias("overlap"),
    )


def stage_comparison(a: DataFrame, b: DataFrame, label: str, key: Sequence[str], bad: str = "bad") -> DataFrame:
    """Both labels per segment, agreement and the exactly-one-bad flag."""
    j = a.select(*key, F.col(label).alias("label_a")).join(b.select(*key, F.col(label).alias("label_b")), list(key))
    x, y = F.col("label_a") == bad, F.col("label_b") == bad
    return j.withColumns(
        {"agree": F.col("label_a") == F.col("label_b"), "both_bad": x & y, "one_bad": x != y}
    )


def prevalence(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(score) >= threshold).cast("double")).alias("prevalence")
    )
