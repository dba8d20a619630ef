"""Category tree against a search over all splits on the driver."""

import random

import pytest

from beatloom.operators import categorytree, models

FEATURES = ["a", "b", "c"]


def rows(seed, n=600):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = rng.randint(0, 30), rng.choice([0.5, 1.5, 2.5]), 7.0
        p = 0.9 if a > 17 and b > 1 else 0.15 if a > 6 else 0.5
        out.append((float(a) if rng.random() > 0.05 else None, b, c, int(rng.random() < p)))
    return out


def best_tree(data, total, depth, least, cuts):
    """Nested (feature, threshold, left, right) or (n_clean, n_artifact)."""
    n = [sum(r[3] == k for r in data) for k in (0, 1)]
    w = [sum(total) / (2 * k) for k in total]
    gini = lambda c: 2 * c[0] * w[0] * c[1] * w[1] / (c[0] * w[0] + c[1] * w[1]) if sum(c) else 0.0
    best = None
    for f in range(3) if depth else ():
        for t in cuts[f]:
            right = [r for r in data if r[f] is not None and r[f] > t]
            left = [r for r in data if r[f] is None or r[f] <= t]
            if min(len(left), len(right)) < least:
                continue
            gain = round(gini(n) - gini([sum(r[3] == k for r in left) for k in (0, 1)]) - gini([sum(r[3] == k for r in right) for k in (0, 1)]), 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, f, t, left, right)
    if best is None:
        return tuple(n)
    _, f, t, left, right = best
    return FEATURES[f], t, best_tree(left, total, depth - 1, least, cuts), best_tree(right, total, depth - 1, least, cuts)


def shape(node):
    return (node.n_clean, node.n_artifact) if node.feature is None else (node.feature, node.threshold, shape(node.left), shape(node.right))


@pytest.mark.parametrize("seed,depth,least", [(1, 3, 20), (2, 5, 5)])
def test_tree_equals_search(spark, seed, depth, least):
    data = rows(seed)
    d = spark.createDataFrame(data, "a double, b double, c double, y int")
    tree = categorytree.fit(d, FEATURES, "y", depth, least)
    total = [sum(r[3] == k for r in data) for k in (0, 1)]
    assert shape(tree) == best_tree(data, total, depth, least, categorytree.thresholds(d, FEATURES))
    table = categorytree.leaf_table(d, tree).collect()
    assert sum(r.n_clean + r.n_artifact for r in table) == len(data) and len(table) > 3
    assert [r.leaf for r in table] == list(range(len(table)))
    out = categorytree.apply(tree, models.categorise_leaves(categorytree.leaf_table(d, tree)), d, ["y"])
    n = {(r.leaf_id, r.y): r["count"] for r in out.groupBy("leaf_id", "y").count().collect()}
    for r in table:
        assert (n.get((r.leaf, 0), 0), n.get((r.leaf, 1), 0)) == (r.n_clean, r.n_artifact)


def test_equal_predictions_stay_apart(spark):
    """Two leaves that both say artifact, with different purity, are two leaves."""
    data = [(float(i % 10), 1.0, 1.0, 0 if i % 10 < 5 else int(i % 10 != 7 or i % 3 != 0)) for i in range(1000)]
    d = spark.createDataFrame(data, "a double, b double, c double, y int")
    tree = categorytree.fit(d, FEATURES, "y", 4, 50)
    leaves = [n for _, n in categorytree.leaves(tree)]
    assert sum(n.n_artifact > n.n_clean for n in leaves) >= 2
    assert len({n.n_artifact / (n.n_clean + n.n_artifact) for n in leaves if n.n_artifact > n.n_clean}) >= 2


def test_odd_input(spark):
    s = "a double, b double, c double, y int"
    with pytest.raises(ValueError):
        categorytree.fit(spark.createDataFrame([(1.0, 1.0, 1.0, 0)] * 9, s), FEATURES, "y")
    with pytest.raises(ValueError):
        categorytree.fit(spark.createDataFrame([], s), FEATURES, "y")
    only = spark.createDataFrame([(None, 2.0, 3.0, i % 2) for i in range(50)] + [(1.0, 1.0, 1.0, None)], s)
    tree = categorytree.fit(only, FEATURES, "y", min_leaf=1)
    assert tree.feature is None and (tree.n_clean, tree.n_artifact) == (25, 25)
    assert {r.leaf_id for r in categorytree.apply(tree, models.categorise_leaves(categorytree.leaf_table(only, tree)), only, ["y"]).collect()} == {0}
