"""Active-learning candidates and label upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.params import LABELS

STRATEGIES = ("margin", "committee", "priority")


def composite_score(max_priority: Column) -> Column:
    """Beats without a priority score count as 0 there."""
    top = F.when(F.coalesce(max_priority, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(max_priority)
    base = (
        0.4 * F.col("uncertainty_ensemble")
        + 0.4 * F.col("disagreement")
        + 0.2 * (F.coalesce("review_priority_score", F.lit(0.0)) / top)
    )
    noisy = F.when(F.col("quality_label") == "noisy_ok", F.lit(1.2)).otherwise(F.lit(1.0))
    moving = F.when(F.coalesce("pots_transition_candidate", F.lit(False)), F.lit(1.1)).otherwise(F.lit(1.0))
    return base * noisy * moving


def candidate_pool(
    beats: DataFrame,
    segment_quality: DataFrame,
    n: int,
    strategy: str = "combined",
    band: tuple[float, float] = (0.3, 0.7),
    min_disagreement: float = 0.3,
    segment: Sequence[str] = ("recording_id", "segment_idx"),
) -> DataFrame:
    """Unreviewed beats outside bad segments that one strategy asks for, tagged
    with the first strategy that does.

    margin and committee are properties of the row; only the priority pool needs
    an order, and that is a top-n.
    """
    quality = segment_quality.select(*segment, "quality_label")
    work = beats.filter(~F.coalesce(F.col("reviewed"), F.lit(False))).join(quality, list(segment), "left")
    work = work.filter(F.coalesce(F.col("quality_label"), F.lit("")) != "bad")
    top = work.orderBy(F.desc("review_priority_score"), "peak_id").limit(n)
    if strategy == "priority":
        return top.withColumn("selection_strategy", F.lit("priority"))
    margin = F.col("p_ensemble").between(*band)
    committee = F.col("disagreement") >= min_disagreement
    tags = {"margin": [("margin", margin)], "committee": [("committee", committee)]}.get(
        strategy, [("margin", margin), ("committee", committee)]
    )
    tag = F.lit(None).cast("string")
    for name, test in reversed(tags):
        tag = F.when(test, name).otherwise(tag)
    tagged = work.withColumn("selection_strategy", tag).filter(F.col("selection_strategy").isNotNull())
    if strategy != "combined":
        return tagged
    rest = top.filter(~(F.coalesce(margin, F.lit(False)) | F.coalesce(committee, F.lit(False))))
    return tagged.unionByName(rest.withColumn("selection_strategy", F.lit("priority")))


def select_candidates(
    beats: DataFrame, segment_quality: DataFrame, n: int = 500, iteration: int = 1, **options
) -> DataFrame:
    """The ``n`` best candidates by composite score; ties by peak_id."""
    pool = candidate_pool(beats, segment_quality, n, **options)
    top = pool.agg(F.max("review_priority_score").alias("_max"))
    scored = pool.crossJoin(F.broadcast(top)).withColumn("composite_score", composite_score(F.col("_max")))
    return (
        scored.drop("_max")
        .withColumn("al_iteration", F.lit(iteration))
        .orderBy(F.desc("composite_score"), "peak_id")
        .limit(n)
    )


def record_labels(labels: DataFrame, results: DataFrame, iteration: int, key: str = "peak_id", arrival: str | None = None) -> DataFrame:
    """Overwrite label, review mark and iteration of the given beats; ids the
    table does not hold and labels outside the vocabulary are ignored.

    Of several labels for a beat the last in ``arrival`` stays; without it, the
    last by name, so that the result does not depend on the order of rows.
    Uncertainty and disagreement are taken along where the results have them.
    """
    more = [c for c in ("uncertainty_ensemble", "disagreement") if c in results.columns and c not in labels.columns]
    order = F.struct(*([arrival] if arrival else []), "label")
    valid = results.filter(F.col("label").isin(*LABELS))
    new = valid.groupBy(key).agg(*[F.max_by(c, order).alias(c if c != "label" else "_new") for c in ("label", *more)])
    d = labels.join(new, key, "left")
    hit = F.col("_new").isNotNull()
    before = F.col("al_iteration") if "al_iteration" in labels.columns else F.lit(None).cast("int")
    return d.withColumns(
        {
            "label": F.coalesce("_new", "label"),
            "reviewed": F.when(hit, F.lit(True)).otherwise(F.col("reviewed")),
            "al_iteration": F.when(hit, F.lit(iteration)).otherwise(before),
        }
    ).drop("_new")


def iteration_summary(labels: DataFrame, scores: Sequence[str] = ()) -> DataFrame:
    """Per iteration: label map, total, and the mean of each score."""
    from beatloom.operators.aggregates import label_counts

    counts = label_counts(labels, ["al_iteration"])
    if not scores:
        return counts
    means = labels.groupBy("al_iteration").agg(*[F.avg(c).alias(f"mean_{c}") for c in scores])
    return counts.join(means, "al_iteration")


def export_disagreements(
    scored: DataFrame, segment_quality: DataFrame, samples: DataFrame, n: int, oversample: int = 3,
    max_ensemble: float = 0.5, min_wave: float = 0.5, half_ms: int = 2500, margin: int = 10,
    segment: Sequence[str] = ("recording_id", "segment_idx"),
) -> DataFrame:
    """Unreviewed beats outside bad segments on which the models disagree most,
    with their signal context; beats at a context edge are dropped after an
    over-request of ``oversample``."""
    from beatloom.operators import columns, relational, temporal

    pool = columns.without_bad_segments(scored.filter(~F.col("reviewed")), segment_quality, segment)
    pool = columns.score_range(pool, {"p_wave": min_wave}, {"p_ensemble": max_ensemble})
    top = relational.top_n(pool, "disagreement", n * oversample)
    ctx = temporal.snap_context(temporal.context_windows(top, samples, half_ms), 5, margin)
    return relational.top_n(ctx.filter(~F.col("at_edge")), "disagreement", n)


def presort_queue(windows: DataFrame, template: DataFrame, pristine: float = 0.80, artifact: float = 0.50) -> DataFrame:
    """Queue ordered by falling correlation with the clean template, with a
    category from two cut-offs."""
    from beatloom.operators.waveforms import template_similarity

    d = template_similarity(windows, template, (), name="template_corr")
    cat = F.when(F.col("template_corr") >= pristine, "pristine").when(F.col("template_corr") >= artifact, "ambiguous")
    return d.withColumn("presort_category", cat.otherwise("likely_artifact")).orderBy(F.desc("template_corr"), "peak_id")
