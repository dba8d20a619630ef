"""Category tree: splits searched over distributed class histograms.

Each feature gets candidate thresholds once (quantiles); rows keep the numbers of
their bins. A level of the tree is one aggregation: counts of both classes by node,
feature and bin, added up inside the tasks first, then running sums over the bins
give the impurity of every split. What leaves Spark is the best split of each node,
at most 2^depth rows. Leaves of equal prediction stay apart, since their purity and
path make the category.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.session import materialise

BINS = 64


@dataclass(frozen=True)
class Node:
    """A leaf (``feature`` is None) or a split: left where value <= threshold or
    the value is missing."""

    n_clean: int
    n_artifact: int
    feature: str | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


Path = list[tuple[str, str, float]]


def leaves(tree: Node, path: Path | None = None) -> list[tuple[Path, Node]]:
    """Leaves from left to right with their conditions."""
    path = path or []
    if tree.feature is None:
        return [(path, tree)]
    return leaves(tree.left, [*path, (tree.feature, "<=", tree.threshold)]) + leaves(tree.right, [*path, (tree.feature, ">", tree.threshold)])


def thresholds(df: DataFrame, features: Sequence[str], bins: int = BINS, error: float = 0.001) -> list[list[float]]:
    """Ascending candidate thresholds per feature: quantiles, without the largest value."""
    found = df.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(list(features), [i / bins for i in range(1, bins)] + [1.0], error)
    return [sorted(set(q[:-1]) - {q[-1]}) if q else [] for q in found]


def _bin(feature: str, cuts: Sequence[float]) -> Column:
    """How many cuts are below the value; 0 if it is missing."""
    x = F.col(feature).cast("double")
    if not cuts:
        return F.lit(0)
    below = F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < x)
    return F.coalesce(F.size(F.when(x.isNotNull(), below).otherwise(F.array().cast("array<double>"))), F.lit(0))


def fit(df: DataFrame, features: Sequence[str], truth: str, depth: int = 6, min_leaf: int = 100, bins: int = BINS) -> Node:
    """Tree of at most ``depth`` levels on balanced classes (0 clean, 1 artifact).

    The split of a node lowers the weighted Gini impurity most; ties go to the first
    feature, then the lower threshold. Both sides keep ``min_leaf`` rows or more.
    Rows without class are left out. Raises if one class is absent.
    """
    d = df.filter(F.col(truth).isin(0, 1))
    cuts = thresholds(d, features, bins)
    rows = materialise(d.select(F.col(truth).cast("int").alias("y"), F.lit(0).alias("node"), F.array(*[_bin(f, c) for f, c in zip(features, cuts)]).alias("bins")))
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        raise ValueError("a tree needs both classes")
    n = sum(total.values())
    weight = {c: n / (2 * k) for c, k in total.items()}
    counts: dict[int, tuple[int, int]] = {0: (total[0], total[1])}
    splits: dict[int, tuple[int, int]] = {}
    for _ in range(depth):
        best = _best_splits(rows, weight, min_leaf).collect()  # a row per node of the level
        if not best:
            break
        for r in best:
            splits[r["node"]] = (r["feature"], r["bin"])
            counts[2 * r["node"] + 1] = (r["l0"], r["l1"])
            counts[2 * r["node"] + 2] = (r["n0"] - r["l0"], r["n1"] - r["l1"])
        # rows of leaves leave the search
        step = F.broadcast(rows.sparkSession.createDataFrame([(r["node"], r["feature"], r["bin"]) for r in best], "node int, _f int, _c int"))
        side = F.when(F.get("bins", F.col("_f")) > F.col("_c"), 2).otherwise(1)
        rows = rows.join(step, "node").select("y", (F.col("node") * 2 + side).cast("int").alias("node"), "bins")

    def build(i: int) -> Node:
        if i not in splits:
            return Node(*counts[i])
        f, c = splits[i]
        return Node(*counts[i], features[f], float(cuts[f][c]), build(2 * i + 1), build(2 * i + 2))

    return build(0)


def _best_splits(rows: DataFrame, weight: dict[int, float], min_leaf: int) -> DataFrame:
    """node, feature, bin (the left side's last), counts of both sides."""
    h = rows.select("node", "y", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(
        F.count_if(F.col("y") == 0).alias("c0"), F.count_if(F.col("y") == 1).alias("c1")
    )
    upto = Window.partitionBy("node", "feature").orderBy("bin")
    all_ = Window.partitionBy("node", "feature")
    h = h.select(
        "node", "feature", "bin",
        *[F.sum(f"c{c}").over(upto).alias(f"l{c}") for c in (0, 1)], *[F.sum(f"c{c}").over(all_).alias(f"n{c}") for c in (0, 1)],
    )

    def impurity(a: Column, b: Column) -> Column:
        """Weighted mass times Gini impurity."""
        x, y = a * weight[0], b * weight[1]
        return F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(F.lit(0.0))

    l0, l1, r0, r1 = F.col("l0"), F.col("l1"), F.col("n0") - F.col("l0"), F.col("n1") - F.col("l1")
    gain = impurity(F.col("n0"), F.col("n1")) - impurity(l0, l1) - impurity(r0, r1)
    ok = h.withColumn("gain", F.round(gain, 9)).filter((l0 + l1 >= min_leaf) & (r0 + r1 >= min_leaf) & (F.col("gain") > 0))
    first = F.struct(-F.col("gain"), F.col("feature"), F.col("bin"))
    return ok.groupBy("node").agg(F.min_by(F.struct("feature", "bin", "l0", "l1", "n0", "n1"), first).alias("s")).select("node", "s.*")


def leaf_id(tree: Node) -> Column:
    """Number of the row's leaf, from left to right: one nested expression."""

    def walk(node: Node, first: int) -> tuple[Column, int]:
        if node.feature is None:
            return F.lit(first), first + 1
        left, mid = walk(node.left, first)
        right, last = walk(node.right, mid)
        return F.when(F.col(node.feature).cast("double") > node.threshold, right).otherwise(left), last

    return walk(tree, 0)[0]


def path_text(path: Path) -> str:
    return " AND ".join(f"{f}{op}{t:.4g}" for f, op, t in path)


def leaf_table(df: DataFrame, tree: Node) -> DataFrame:
    """leaf, path text, splits as 'feature op' strings and counts of the rows the
    tree was fitted on; input of ``categorise_leaves``. ``df`` lends its session."""
    rows = [(i, path_text(p), [f"{f} {op}" for f, op, _ in p], n.n_clean, n.n_artifact) for i, (p, n) in enumerate(leaves(tree))]
    return df.sparkSession.createDataFrame(rows, "leaf int, tree_path string, splits array<string>, n_clean long, n_artifact long")


def apply(tree: Node, categories: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaf, category, purity and path per row; a row per leaf is broadcast, at most
    2^depth."""
    cols = ["category", "category_confidence", "tree_path"]
    d = df.select(*keys, leaf_id(tree).alias("leaf_id"))
    return d.join(F.broadcast(categories.select(F.col("leaf").alias("leaf_id"), *cols)), "leaf_id", "left").select(
        *keys, "leaf_id", *cols, F.col("category").alias("auto_category")
    )
