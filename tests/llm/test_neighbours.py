"""Approximate nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.llm import neighbours

S = "vec_id long, embedding array<float>, label int"


def brute(rows, key, k=10):
    """Nearest usable rows of each query, by (distance, key)."""
    ok = [(i, np.array(v, dtype=float)) for i, v, *_ in rows if i is not None and v is not None and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    out = {}
    for n, (i, v) in enumerate(ok):
        if key(i):
            far = sorted((float(np.sqrt(np.square(w - v).sum())), j) for m, (j, w) in enumerate(ok) if m != n)
            out[i] = far[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def f32(x):
    return [float(np.float32(v)) for v in x]


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f32(rng.standard_normal(8)), 0) for i in range(60)]
    rows[7] = (7, rows[0][1], 0)  # ties at distance 0 and everywhere else
    rows[8] = (8, rows[0][1], 0)
    rows += [(500, None, 0), (600, [0.0] * 8, 0), (700, [None, *[1.0] * 7], 0), (800, [float("nan")] * 8, 0),
             (900, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (1000, [1.0, 2.0], 0), (1100, [], 0)]
    d = spark.createDataFrame(rows, S).withColumns({c: F.lit("x") for c in ("_id", "_vec", "node", "query", "score", "rank", "beam")})
    got = found(neighbours.nearest(d, F.col("vec_id") % 20 == 0))
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 8], lambda i: i % 20 == 0)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [j for _, j in got[q]] == [j for _, j in w]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in w], rtol=1e-14, atol=1e-14)


@pytest.mark.parametrize("rows", [[], [(0, None, 0)], [(0, [1.0, 2.0], 0)], [(0, [1.0, 2.0], 0)] * 3])
def test_tables_without_pairs(spark, rows):
    got = neighbours.neighbour_report(spark.createDataFrame(rows, S))
    assert got.collect() == [] and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_fewer_candidates_and_repeated_keys(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (1, [2.0, 0.0], 0), (1, [3.0, 0.0], 0)]
    assert found(neighbours.neighbour_report(spark.createDataFrame(rows, S))) == {0: [(1.0, 1), (2.0, 1)]}


def test_recall_with_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24))
    x[1000:2000] = x[0]  # a third of all rows is one vector
    rows = [(i, f32(v), 0) for i, v in enumerate(x)]
    got = found(neighbours.neighbour_report(spark.createDataFrame(rows, S)))
    want = brute(rows, lambda i: i % 100 == 0)
    assert got.keys() == want.keys()
    hit = sum(len({j for _, j in got[q]} & {j for _, j in w}) for q, w in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))
    # the copies come first, by key
    assert [j for _, j in got[0]] == list(range(1000, 1010)) and got[1500][0] == (0.0, 0)


def test_queries_outside_the_graph(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1200, 8))
    rows = [(i, f32(v), 0) for i, v in enumerate(x)]
    graph = neighbours.build(spark.createDataFrame(rows, S))
    new = [(10_000 + i, f32(rng.standard_normal(8))) for i in range(20)]
    q = neighbours.clean(spark.createDataFrame(new, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = found(neighbours.search(graph, q))
    hit = 0
    for i, v in new:
        far = np.square(np.array([r[1] for r in rows]) - np.array(v)).sum(axis=1)
        hit += len(set(np.argsort(far)[:10].tolist()) & {j for _, j in got[i]})
    assert hit >= 0.9 * 10 * len(new)


def test_lists_are_bounded():
    owner = np.repeat(np.arange(3), 100)
    node = np.tile(np.arange(50), 6)
    pick = neighbours.nearest_few(owner, node, node.astype(float), np.zeros(300, bool), 7)
    assert pick.tolist() and (np.bincount(owner[pick]) == 7).all() and sorted(node[pick].tolist()) == sorted([*range(7)] * 3)


def test_recall_on_the_given_vectors(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = found(neighbours.neighbour_report(d))
    want = brute([(r.vec_id, list(r.embedding)) for r in d.collect()], lambda i: i % 100 == 0)
    hit = sum(len({j for _, j in got[q]} & {j for _, j in w}) for q, w in want.items())
    assert hit >= 0.9 * sum(map(len, want.values()))
