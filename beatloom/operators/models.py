"""Models as Spark ML jobs, motif and category discovery, augmentation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.functions import arrays as A
from beatloom.operators.columns import decode, encode
from beatloom.params import (
    BRADYCARDIC_BPM,
    LEAF_ARTIFACT,
    LEAF_LOW_AMPLITUDE,
    LEAF_NOISY,
    LEAF_NORMAL,
    LEAF_PRISTINE,
    MOTIF_ERRATIC_CV,
    MOTIF_NOISY_SPREAD,
    TACHYCARDIC_BPM,
)


def impute(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the training medians (one row), else 0."""
    m = medians.select(*[F.col(c).alias(f"_m_{c}") for c in columns])
    d = df.crossJoin(F.broadcast(m))
    return d.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}).drop(
        *[f"_m_{c}" for c in columns]
    )


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (classes * n of the class), per row."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    t = c.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    w = c.crossJoin(F.broadcast(t)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(name))
    return df.join(w, label)


def _assemble(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def train_segment_quality(df: DataFrame, features: Sequence[str], label: str, codes: Mapping[str, int], trees: int = 40, seed: int = 42) -> PipelineModel:
    """Three-class forest with balanced weights; unknown labels are left out."""
    d = balanced_weights(encode(df, label, codes, "_y"), "_y")
    rf = RandomForestClassifier(labelCol="_y", weightCol="weight", numTrees=trees, maxDepth=6, seed=seed)
    return Pipeline(stages=[_assemble(features), rf]).fit(d)


def predict_segment_quality(model: PipelineModel, df: DataFrame, keys: Sequence[str], codes: Mapping[str, int]) -> DataFrame:
    d = model.transform(df).withColumn("_p", vector_to_array("probability"))
    d = d.withColumn("quality_pred", F.col("prediction").cast("int"))
    return decode(d, "quality_pred", codes, "quality_label").select(
        *keys, "quality_pred", "quality_label", *[F.col("_p")[i].alias(f"p_{n}") for n, i in codes.items()]
    )


def train_beats(df: DataFrame, features: Sequence[str], truth: str, is_train: str, pos_weight: float, rounds: int = 20, seed: int = 42) -> PipelineModel:
    """Boosted trees with a positive-class weight; rows outside training stop it early."""
    d = df.withColumn("_w", F.when(F.col(truth) == 1, F.lit(pos_weight)).otherwise(F.lit(1.0))).withColumn(
        "_val", ~F.col(is_train)
    )
    gbt = GBTClassifier(labelCol=truth, weightCol="_w", validationIndicatorCol="_val", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed)
    return Pipeline(stages=[_assemble(features), gbt]).fit(d)


def predict_beats(model: PipelineModel, df: DataFrame, keys: Sequence[str], name: str, threshold: float = 0.5) -> DataFrame:
    d = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return d.select(*keys, name, (F.col(name) >= threshold).alias("predicted_artifact"))


def top_features(model: PipelineModel, features: Sequence[str], n: int) -> list[tuple[str, float]]:
    """Names and gains of the most important inputs; a list as long as the model
    has inputs, so it lives on the driver."""
    imp = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, imp), strict=True), key=lambda kv: (-kv[1], kv[0]))[:n]


def train_stacking(df: DataFrame, truth: str, p1: str = "p_tab", p2: str = "p_wave") -> PipelineModel:
    d = balanced_weights(with_disagreement(df, p1, p2), truth)
    lr = LogisticRegression(labelCol=truth, weightCol="weight", maxIter=50)
    return Pipeline(stages=[_assemble([p1, p2, "disagreement"]), lr]).fit(d)


def with_disagreement(df: DataFrame, p1: str = "p_tab", p2: str = "p_wave") -> DataFrame:
    return df.withColumn("disagreement", F.abs(F.col(p1) - F.col(p2)))


def waveform_vector(df: DataFrame, waveform: str, features: Sequence[str] = (), name: str = "features") -> DataFrame:
    """z-scored window followed by the tabular features, as one vector."""
    cells = A.zscore(F.col(waveform))
    if features:
        cells = F.concat(cells, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]))
    return df.withColumn(name, array_to_vector(cells))


def train_waveform_classifier(df: DataFrame, truth: str, width: int, hidden: int = 16, seed: int = 42):
    """Multilayer perceptron on ``features``: the second, waveform-based score."""
    return MultilayerPerceptronClassifier(labelCol=truth, layers=[width, hidden, 2], maxIter=40, seed=seed).fit(df)


# ---- motifs ------------------------------------------------------------------


def hr_class(mean_rr: Column, normal: str) -> Column:
    """Class of a mean interval by heart rate, else ``normal``."""
    hr = F.lit(60000.0) / F.coalesce(mean_rr, F.lit(600.0))
    return F.when(hr < BRADYCARDIC_BPM, "bradycardic").when(hr > TACHYCARDIC_BPM, "tachycardic").otherwise(normal)


def _clusters(df: DataFrame, vector: Column, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    d = df.withColumn("_vec", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, featuresCol="_vec", predictionCol="idx", maxIter=50).fit(d)
    spark = df.sparkSession
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return model.transform(d).drop("_vec"), spark.createDataFrame(rows, "idx int, centroid array<double>")


def qrs_motifs(df: DataFrame, k: int = 12, seed: int = 42, waveform: str = "waveform", rr: str = "rr_prev_ms") -> DataFrame:
    """Cluster centres of z-scored windows with a label from spread and rate."""
    z = df.withColumn("_z", A.zscore(F.col(waveform)))
    assigned, centres = _clusters(z, F.col("_z"), k, seed)
    ptp = F.array_max("_z") - F.array_min("_z")
    stats = assigned.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n_beats"), F.avg(ptp).alias("_m"), F.stddev_pop(ptp).alias("_s"), F.avg(rr).alias("_rr")
    )
    noisy = (F.col("_s") > MOTIF_NOISY_SPREAD * F.col("_m")) & (F.col("_m") > 0)
    label = F.when(noisy, "noisy_cluster").otherwise(hr_class(F.col("_rr"), "normal_sinus"))
    return centres.join(stats, "idx").select("idx", label.alias("label"), "n_beats", "centroid")


def rr_motifs(df: DataFrame, k: int = 8, seed: int = 42, vector: str = "rr_vector") -> DataFrame:
    """Cluster centres of globally z-scored, +-4 sd clipped interval vectors;
    keeps the scaling values and the centre in ms."""
    flat = df.select(F.explode(vector).alias("x")).agg(F.avg("x").alias("scale_mean"), F.stddev_pop("x").alias("scale_sd"))
    d = df.crossJoin(F.broadcast(flat))
    z = F.transform(vector, lambda x: F.least(F.greatest((x - F.col("scale_mean")) / F.col("scale_sd"), F.lit(-4.0)), F.lit(4.0)))
    assigned, centres = _clusters(d, z, k, seed)
    one = assigned.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n_beats"), F.avg(A.mean(F.col(vector))).alias("_m"),
        F.avg(A.sum_squares(F.col(vector).cast("array<double>")) / F.size(vector)).alias("_q"),
    )
    c = centres.join(one, "idx").crossJoin(F.broadcast(flat))
    c = c.withColumn("centroid_ms", F.transform("centroid", lambda x: x * F.col("scale_sd") + F.col("scale_mean")))
    cv = F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))) / F.col("_m")
    ramp = A.rr_pattern(F.col("centroid_ms"))
    label = F.when(ramp != "", ramp).when(cv > MOTIF_ERRATIC_CV, "erratic").otherwise(hr_class(F.col("_m"), "stable_sinus"))
    return c.select("idx", label.alias("label"), "n_beats", "centroid", "centroid_ms", "scale_mean", "scale_sd")


def save_motifs(motifs: DataFrame, path: str) -> None:
    motifs.write.mode("overwrite").parquet(path)


# ---- categories --------------------------------------------------------------


def fit_categories(df: DataFrame, features: Sequence[str], truth: str, depth: int = 6, min_leaf: int = 100, seed: int = 42) -> PipelineModel:
    """Depth-limited tree on balanced classes; leaves of equal prediction merge."""
    df = balanced_weights(df, truth)
    tree = DecisionTreeClassifier(labelCol=truth, weightCol="weight", maxDepth=depth, minInstancesPerNode=min_leaf, leafCol="leaf", seed=seed)
    return Pipeline(stages=[_assemble(features), tree]).fit(df)


_RULE = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)$")


def leaf_paths(model: PipelineModel, features: Sequence[str]) -> list[tuple[int, list[tuple[str, str, float]]]]:
    """Every leaf, numbered left to right, with its split conditions. The tree is
    small (its depth is limited), so its text is read on the driver."""
    stack: list[tuple[str, str, float]] = []
    out = []
    for line in model.stages[-1].toDebugString.splitlines():
        m = _RULE.match(line)
        if m:
            level = (len(m[1]) - 3) // 1
            stack = [c for c in stack if c[0] < level] + [(level, (features[int(m[3])], m[4], float(m[5])))]
        elif "Predict:" in line:
            out.append((len(out), [c for _, c in stack]))
    return out


def path_text(path: Sequence[tuple[str, str, float]]) -> str:
    return " AND ".join(f"{f}{op}{t:.4g}" for f, op, t in path)


def leaf_table(model: PipelineModel, features: Sequence[str], assigned: DataFrame, truth: str) -> DataFrame:
    """leaf, path text, splits as 'feature op' strings and class counts."""
    spark = assigned.sparkSession
    rows = [(i, path_text(p), [f"{f} {op}" for f, op, _ in p]) for i, p in leaf_paths(model, features)]
    paths = spark.createDataFrame(rows, "leaf int, tree_path string, splits array<string>")
    n = assigned.groupBy(F.col("leaf").cast("int").alias("leaf")).agg(
        F.count_if(F.col(truth) == 0).alias("n_clean"), F.count_if(F.col(truth) == 1).alias("n_artifact")
    )
    return paths.join(n, "leaf", "left").fillna(0, ["n_clean", "n_artifact"])


def categorise_leaves(leaves: DataFrame) -> DataFrame:
    """Category of each leaf by the first rule that holds, and its purity."""
    total = F.col("n_clean") + F.col("n_artifact")
    clean = F.when(total > 0, F.col("n_clean") / total).otherwise(F.lit(0.0))
    art = F.when(total > 0, F.col("n_artifact") / total).otherwise(F.lit(0.0))

    def has(feature: str, op: str) -> Column:
        return F.array_contains("splits", f"{feature} {op}")

    corr, snr, iqr = "global_corr_clean", "r_peak_snr", "window_iqr"
    zcr = has("window_zcr", ">") | has("window_zero_crossing_rate", ">")
    rules = (
        F.when(total == 0, "uncertain")
        .when(has(corr, ">") & has(snr, ">") & (clean >= LEAF_PRISTINE), "pristine")
        .when(has(corr, ">") & (clean >= LEAF_NORMAL), "clean_normal")
        .when(has(iqr, "<=") & (clean >= LEAF_LOW_AMPLITUDE), "clean_low_amplitude")
        .when(has("window_hf_noise_rms", ">") & (clean >= LEAF_NOISY), "clean_noisy")
        .when(has("window_wander_slope", ">") | (has(iqr, ">") & (clean < LEAF_NOISY)), "baseline_wander")
        .when((art >= LEAF_ARTIFACT) & has(corr, "<="), "artifact_morphology")
        .when((art >= LEAF_ARTIFACT) & zcr, "artifact_noise")
        .when(art >= LEAF_ARTIFACT, "artifact_general")
        .otherwise("uncertain")
    )
    return leaves.withColumns({"category": rules, "category_confidence": F.greatest(clean, art)})


def apply_categories(model: PipelineModel, leaves: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Category, purity and path per beat; the leaf table has one row per leaf."""
    d = model.transform(df).withColumn("leaf", F.col("leaf").cast("int"))
    cols = ["category", "category_confidence", "tree_path"]
    return d.join(F.broadcast(leaves.select("leaf", *cols)), "leaf", "left").select(
        *keys, F.col("leaf").alias("leaf_id"), *cols, F.col("category").alias("auto_category")
    )


def principal_axes(df: DataFrame, columns: Sequence[str], k: int = 2) -> tuple[DataFrame, list[list[float]]]:
    """Mean-imputed, standardised scores on ``k`` axes, and the loadings."""
    filled = [f"_f_{c}" for c in columns]
    pipe = Pipeline(
        stages=[
            Imputer(inputCols=list(columns), outputCols=filled, strategy="mean"),
            VectorAssembler(inputCols=filled, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
            PCA(k=k, inputCol="_std", outputCol="_pc"),
        ]
    ).fit(df)
    out = pipe.transform(df).withColumn("_pc", vector_to_array("_pc"))
    out = out.select(*df.columns, *[F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(k)])
    return out, pipe.stages[-1].pc.toArray().tolist()


# ---- augmentation ------------------------------------------------------------
#
# Every draw is a hash of the row's key, the run and a name, so a retried task
# makes the same rows; all of it stays in built-in expressions.

# Kinds of synthetic artifacts, of label-preserving changes and of damage.
ARTIFACT_KINDS = ("baseline_wander", "electrode_pop", "emg_burst", "lead_off_transient", "motion_artifact", "gaussian_noise")
JITTER_KINDS = ("gaussian", "amplitude", "timeshift")
DAMAGE_KINDS = ("gaussian", "masking", "baseline_wander", "amplitude_scaling")
CORRUPTION_KINDS = (*DAMAGE_KINDS, "combined")
RATE_HZ = 130


def _unit(name: str, *at: Column) -> Column:
    """Uniform in (0, 1) for the row, the name and a position."""
    h = F.pmod(F.xxhash64(F.col("_seed"), F.lit(name), *at), F.lit(1 << 53))
    return (h + 0.5) / F.lit(float(1 << 53))


def _uniform(name: str, low: float | Column, high: float | Column) -> Column:
    return low + (high - low) * _unit(name)


def _whole(name: str, low: int | Column, high: int | Column) -> Column:
    """A whole number from ``low`` up to, not including, ``high``."""
    return (low + F.floor((high - low) * _unit(name))).cast("int")


def _normal(name: str, at: Column) -> Column:
    return F.sqrt(-2.0 * F.ln(_unit(name, at, F.lit(0)))) * F.cos(2.0 * np.pi * _unit(name, at, F.lit(1)))


def _wave(name: str, amplitude: Column, low_hz: float, high_hz: float, i: Column) -> Column:
    phase = _unit(f"{name} phase") * 2.0 * np.pi
    return amplitude * F.sin(2.0 * np.pi * _uniform(f"{name} hz", low_hz, high_hz) * i / RATE_HZ + phase)


def _lead_off(w: Column, n: Column) -> Column:
    """A block close to zero, then a straight ramp back to the signal."""
    block, ramp = _whole("block", 10, 41), _whole("ramp", 10, 21)
    start = _whole("start", 0, F.greatest(n - block - ramp, F.lit(0)) + 1)
    stop = F.least(start + block, n)
    back = F.least(stop + ramp, n)
    low = _uniform("scale", 0.0, 0.05)
    a = F.get(w, F.greatest(stop - 1, F.lit(0))) * low
    b = F.get(w, F.least(back, n - 1))
    at = lambda i: a + (b - a) * (i - stop) / F.greatest(back - stop - 1, F.lit(1))
    return F.transform(w, lambda x, i: F.when((i >= start) & (i < stop), x * low).when((i >= stop) & (i < back), at(i)).otherwise(x))


def _artifact(kind: str, w: Column, n: Column, sd: Column) -> Column:
    if kind == "baseline_wander":
        return F.transform(w, lambda x, i: x + _wave(kind, _uniform("amp", 0.3, 1.5) * sd, 0.05, 0.5, i))
    if kind == "electrode_pop":
        size = _uniform("amp", 3.0, 8.0) * sd * F.when(_unit("sign") < 0.5, -1.0).otherwise(1.0)
        return F.transform(w, lambda x, i: F.when(i == _whole("at", 0, n), x + size).otherwise(x))
    if kind == "emg_burst":
        size = _whole("len", 30, 81)
        first = _whole("at", 0, F.greatest(n - size, F.lit(1)))
        amp = _uniform("amp", 0.5, 2.0) * sd
        return F.transform(w, lambda x, i: F.when((i >= first) & (i < first + size), x + amp * _normal("burst", i)).otherwise(x))
    if kind == "lead_off_transient":
        return _lead_off(w, n)
    if kind == "motion_artifact":
        return F.transform(w, lambda x, i: x + _wave(kind, _uniform("amp", 1.0, 3.0) * sd, 1.0, 5.0, i))
    return F.transform(w, lambda x, i: x + _uniform("amp", 0.2, 0.6) * sd * _normal("noise", i))


def _jitter(kind: str, w: Column, n: Column, sd: Column) -> Column:
    if kind == "gaussian":
        return F.transform(w, lambda x, i: x + 0.05 * sd * _normal("noise", i))
    if kind == "amplitude":
        return F.transform(w, lambda x: x * _uniform("amp", 0.9, 1.1))
    return F.transform(w, lambda x, i: F.get(w, F.pmod(i - _whole("shift", -2, 3), n)))


def _damage(kind: str, w: Column, n: Column, sd: Column, level: float) -> Column:
    if kind == "gaussian":
        return F.transform(w, lambda x, i: x + level * 0.3 * sd * _normal("noise", i))
    if kind == "masking":
        size = F.floor(level * n).cast("int")
        first = _whole("mask", 0, F.greatest(n - size, F.lit(1)))
        return F.transform(w, lambda x, i: F.when((size < n) & (i >= first) & (i < first + size), 0.0).otherwise(x))
    if kind == "baseline_wander":
        return F.transform(w, lambda x, i: x + _wave(kind, level * sd, 0.05, 0.5, i))
    return F.transform(w, lambda x: x * _uniform("scale", 1.0 - 0.3 * level, 1.0 + 0.3 * level))


def _augment(df: DataFrame, run: int, kinds: Sequence[str], make, keys: Sequence[str], waveform: str, kind: str | None) -> DataFrame:
    """One new window per row with the kind drawn for it, or the given one."""
    d = df.select(*keys, F.col(waveform).cast("array<double>").alias(waveform), F.xxhash64(*keys, F.lit(run)).alias("_seed"))
    pick = F.lit(kind) if kind else F.get(F.array(*map(F.lit, kinds)), _whole("kind", 0, len(kinds)))
    d = d.withColumn("_sd", A.sd(F.col(waveform)))
    # flat windows get a small scale of their own
    d = d.withColumns({"_sd": F.when(F.col("_sd") < 1e-10, 1e-3).otherwise(F.col("_sd")), "_n": F.size(waveform), "kind": pick})
    out = F.col(waveform)
    for k in kinds:
        out = F.when(F.col("kind") == k, make(k, d)).otherwise(out)
    return d.withColumn(waveform, out).select(*keys, "kind", waveform)


def augment_artifacts(df: DataFrame, run: int, keys: Sequence[str] = ("peak_id",), waveform: str = "waveform", kind: str | None = None) -> DataFrame:
    """Synthetic artifact windows from clean ones, labelled by kind."""
    w, n, sd = F.col(waveform), F.col("_n"), F.col("_sd")
    return _augment(df, run, ARTIFACT_KINDS, lambda k, d: _artifact(k, w, n, sd), keys, waveform, kind)


def augment_jitter(df: DataFrame, run: int, keys: Sequence[str] = ("peak_id",), waveform: str = "waveform", kind: str | None = None) -> DataFrame:
    """Small noise, scale or shift that keeps the label: one of them per row."""
    w, n, sd = F.col(waveform), F.col("_n"), F.col("_sd")
    return _augment(df, run, JITTER_KINDS, lambda k, d: _jitter(k, w, n, sd), keys, waveform, kind)


def corrupt(df: DataFrame, run: int, level: float = 0.5, keys: Sequence[str] = ("peak_id",), waveform: str = "waveform", kind: str | None = None) -> DataFrame:
    """Damaged copies for denoising, scaled by ``level``; ``combined`` applies two
    or three kinds one after the other, in random order, at half the level."""
    n, sd = F.col("_n"), F.col("_sd")

    def make(k: str, d: DataFrame) -> Column:
        if k != "combined":
            return _damage(k, F.col(waveform), n, sd, level)
        ranked = F.array_sort(F.array(*[F.struct(_unit(f"rank {x}").alias("u"), F.lit(x).alias("k")) for x in DAMAGE_KINDS]))
        w = F.col(waveform)
        for step in range(3):
            this = F.get(ranked, F.lit(step))["k"]
            new = w
            for x in DAMAGE_KINDS:
                new = F.when(this == x, _damage(x, w, n, sd, level * 0.5)).otherwise(new)
            w = new if step < 2 else F.when(_unit("three") < 0.5, new).otherwise(w)
        return w

    return _augment(df, run, CORRUPTION_KINDS, make, keys, waveform, kind)
