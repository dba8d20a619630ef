"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node of the graph; a node remembers its smallest keys, as many
as a result can show. The graph starts from random cells (signs of projections,
large cells cut by hash), inside which all pairs are compared. Then neighbours of
neighbours are joined: every node receives the vectors of its neighbours and of some
nodes that have it as neighbour, compares them with one another and sends each the
others that are nearer than its worst neighbour. Rounds end when few lists change.

A query keeps the nearest nodes seen so far (its beam). Each round the nearest
unopened ones are joined with their lists, whose vectors stand beside them, and
what is nearer than the beam's worst joins the beam. At last the beam is measured
on the original vectors.

Vectors travel as one byte per component and a scale. Lists, cells and beams are
bounded, so no group grows with the data. The state of a round is written to the
shared folder; a lost executor costs at most the round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beatloom.llm.text import map_batches
from beatloom.session import materialise

K = 32  # neighbours of a node
REVERSE = 16  # nodes that have it as neighbour, in a join round
CELL = 512  # nodes of a starting cell
CELLS = 4  # starting cells of a node
ROUNDS = 6
STILL = 0.02  # rounds end when so few neighbours are new
BEAM = 256
OPENED = 64  # nodes of a beam opened per round
HOPS = 12
ENTRIES = 16  # nodes from which a query without an equal node starts
SEED = 20_240_229
CODE = "code binary, scale float"
FEW = 1024  # groups compared at once
FAR = np.float32(np.inf)


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (``_id``, ``_vec``) of usable rows: see ``nearest``."""
    x = F.col("_vec")
    d = vectors.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_vec"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    d = d.filter(F.col("_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
    # -0.0 and 0.0 are one value
    return d.withColumn("_vec", F.transform(x, lambda v: v + F.lit(0.0))).distinct()


def _commonest_length(d: DataFrame) -> int | None:
    top = d.groupBy(F.size("_vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return None if top is None else top.n


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as bytes and the scale of each vector."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / np.maximum(scale, 1e-300)[:, None]).astype(np.int8), scale.astype(np.float32)


def _bytes(column: pa.Array, dims: int) -> np.ndarray:
    """The codes of a binary column without nulls, one row each."""
    at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.int8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.int8)
    return flat.reshape(-1, dims)


def _decoded(struct: pa.StructArray, dims: int) -> np.ndarray:
    return _bytes(struct.field("code"), dims).astype(np.float32) * struct.field("scale").to_numpy(zero_copy_only=False)[:, None]


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _as_list(sizes: np.ndarray, *values: tuple[str, pa.Array]) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([v for _, v in values], [n for n, _ in values]))


def nearest_few(owner: np.ndarray, node: np.ndarray, dist: np.ndarray, flag: np.ndarray, most: int) -> np.ndarray:
    """Indices of the ``most`` nearest different nodes of each owner, in order of
    owner, distance and node. Of equal (owner, node) the one without flag stays."""
    order = np.lexsort((flag, node, owner))
    o, n = owner[order], node[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (o[1:] != o[:-1]) | (n[1:] != n[:-1])
    order = order[first]
    order = order[np.lexsort((node[order], dist[order], owner[order]))]
    o = owner[order]
    begin = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, int)
    place = np.arange(len(o)) - np.repeat(begin, np.diff(np.append(begin, len(o))))
    return order[place < most]


NEAR = "array<struct<node:long,dist:float,fresh:boolean>>"


def _near(owner: np.ndarray, node: np.ndarray, dist: np.ndarray, fresh: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(owners, their lists) from picked entries that stand in order of owner."""
    owners, sizes = np.unique(owner[pick], return_counts=True)
    return owners, _as_list(sizes, ("node", pa.array(node[pick])), ("dist", pa.array(dist[pick].astype(np.float32))), ("fresh", pa.array(fresh[pick])))


def _all_pairs(row: np.ndarray, x: np.ndarray):
    """Squared distances inside groups, padded: (slots of elements, distances)."""
    rows, sizes = np.unique(row, return_counts=True)
    wide = int(sizes.max())
    at = np.full((len(rows), wide), -1)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(row)) - np.repeat(begin, sizes)
    at[np.repeat(np.arange(len(rows)), sizes), place] = np.arange(len(row))
    v = x[np.maximum(at, 0)]
    sq = np.einsum("gid,gid->gi", v, v)
    d = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    hole = at < 0
    d[hole[:, :, None] | hole[:, None, :]] = FAR
    i = np.arange(wide)
    d[:, i, i] = FAR
    return at, np.maximum(d, 0)


@dataclass
class Graph:
    """Nodes (``node``, ``vec``, ``ids``, code), links (``node``, ``links`` with the
    codes of its neighbours) and a few nodes to start from."""

    nodes: DataFrame
    links: DataFrame
    entries: DataFrame
    dims: int


def _nodes(rows: DataFrame, shown: int, dims: int) -> DataFrame:
    """One node per vector with its ``shown`` smallest keys, its code and its cells."""
    # the rank limit is applied before the shuffle, so a vector of many keys stays small
    small = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_vec").orderBy("_id"))).filter(F.col("_r") <= shown)
    d = small.groupBy("_vec").agg(F.sort_array(F.collect_list("_id")).alias("ids"))
    d = materialise(d.select(F.monotonically_increasing_id().alias("node"), F.col("_vec").alias("vec"), "ids"))
    n = d.count()
    middle = dict(d.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col")).collect())
    mean = np.array([middle.get(i, 0.0) for i in range(dims)])
    bits = max(0, math.ceil(math.log2(n / CELL))) if n > CELL else 0
    planes = np.random.default_rng(SEED).standard_normal((CELLS, min(bits, 62), dims))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("vec").flatten().to_numpy().reshape(-1, dims)
            code, scale = encode(x)
            side = np.einsum("nd,cbd->ncb", x - mean, planes) > 0
            cell = (side << np.arange(planes.shape[1], dtype=np.int64)).sum(axis=2).astype(np.int64)
            yield {
                **{c: batch.column(c) for c in ("node", "vec", "ids")},
                "code": [c.tobytes() for c in code], "scale": scale,
                "cells": pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * CELLS, pa.array(cell.ravel())),
            }

    schema = StructType.fromDDL(f"node long, vec array<double>, ids array<long>, {CODE}, cells array<long>")
    return materialise(map_batches(d, run, schema))


def _start(nodes: DataFrame, dims: int) -> DataFrame:
    """First lists: the nearest nodes of a node's cells."""
    d = nodes.select("node", "code", "scale", F.posexplode("cells").alias("_tree", "_cell"))
    sizes = d.groupBy("_tree", "_cell").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("_parts"))
    part = F.pmod(F.xxhash64("node", "_tree"), F.col("_parts")).alias("_part")
    d = d.join(sizes, ["_tree", "_cell"]).groupBy("_tree", "_cell", part).agg(F.collect_list(F.struct("node", "code", "scale")).alias("_in"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):  # a cell at a time: cells are large
                some = batch.column("_in").slice(i, 1).flatten()
                if len(some) < 2:
                    continue
                x = _decoded(some, dims)
                _, dist = _all_pairs(np.zeros(len(x), int), x)
                k = min(K, len(x) - 1)
                best = np.argpartition(dist[0], k - 1, axis=1)[:, :k]
                ids = some.field("node").to_numpy()
                owner, node = np.repeat(ids, k), ids[best.ravel()]
                far = np.take_along_axis(dist[0], best, 1).ravel()
                order = np.argsort(owner, kind="stable")
                owners, lists = _near(owner, node, far, np.ones(len(node), bool), order)
                yield {"node": owners, "near": lists}

    parts = map_batches(d.select("_in"), run, StructType.fromDDL(f"node long, near {NEAR}"))
    # nodes that are alone in all cells have empty lists
    return _merge(parts, nodes)


def _merge(parts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nearest ``K`` of all lists of a node."""
    none = nodes.select("node", F.array().cast(NEAR).alias("near"))
    d = parts.unionByName(none).groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near"))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            row, e = _lists(batch.column("near"))
            node, dist = e.field("node").to_numpy(), e.field("dist").to_numpy()
            fresh = e.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
            pick = nearest_few(row, node, dist, fresh, K)
            sizes = np.bincount(row[pick], minlength=len(batch))
            yield {
                "node": batch.column("node"),
                "near": _as_list(sizes, ("node", pa.array(node[pick])), ("dist", pa.array(dist[pick])), ("fresh", pa.array(fresh[pick]))),
            }

    return map_batches(d, run, StructType.fromDDL(f"node long, near {NEAR}"))


def _descend(graph: DataFrame, nodes: DataFrame, dims: int, round_: int) -> DataFrame:
    """One round: neighbours of a node learn of one another."""
    e = graph.select("node", F.explode("near").alias("_e")).select("node", F.col("_e.node").alias("at"), F.col("_e.fresh").alias("fresh"))
    some = Window.partitionBy("node").orderBy(F.xxhash64("node", "at", F.lit(round_)))
    back = e.select(F.col("at").alias("node"), F.col("node").alias("at"), "fresh")
    back = back.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= REVERSE).drop("_r")
    worst = F.when(F.size("near") >= K, F.element_at("near", -1)["dist"]).otherwise(F.lit(float("inf")).cast("float"))
    known = nodes.select("node", "code", "scale").join(graph.select("node", worst.alias("worst")), "node").withColumnRenamed("node", "at")
    d = e.unionByName(back).join(known, "at").groupBy("node").agg(F.collect_list(F.struct("at", "fresh", "code", "scale", "worst")).alias("_in"))

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), FEW):
                part = batch.slice(i, FEW)
                row, e = _lists(part.column("_in"))
                if not len(row):
                    continue
                ids, worst_ = e.field("at").to_numpy(), e.field("worst").to_numpy()
                fresh = e.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
                at, dist = _all_pairs(row, _decoded(e, dims))
                g, x, y = np.nonzero(dist < np.where(at >= 0, worst_[np.maximum(at, 0)], -1)[:, :, None])
                a, b = at[g, x], at[g, y]
                new = (fresh[a] | fresh[b]) & (ids[a] != ids[b])
                a, b, far = a[new], b[new], dist[g, x, y][new]
                pick = nearest_few(ids[a], ids[b], far, np.zeros(len(a), bool), K)
                owners, lists = _near(ids[a], ids[b], far, np.ones(len(a), bool), pick)
                yield {"node": owners, "near": lists}

    found = map_batches(d.select("_in"), run, StructType.fromDDL(f"node long, near {NEAR}"))
    # what took part in this round is no longer fresh
    old = graph.select("node", F.transform("near", lambda v: F.struct(v["node"].alias("node"), v["dist"].alias("dist"), F.lit(False).alias("fresh"))).alias("near"))
    return _merge(found.unionByName(old.select("node", F.col("near").cast(NEAR).alias("near"))), nodes)


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shown: int = 11, rounds: int = ROUNDS) -> Graph | None:
    """The neighbour graph of the usable vectors (None if there are none)."""
    rows = clean(vectors, key, vector)
    dims = _commonest_length(rows)
    if dims is None:
        return None
    nodes = _nodes(rows.filter(F.size("_vec") == dims), shown, dims)
    graph = materialise(_start(nodes, dims))
    for i in range(rounds):
        graph = materialise(_descend(graph, nodes, dims, i))
        fresh, all_ = graph.select(
            F.sum(F.size(F.filter("near", lambda v: v["fresh"]))), F.sum(F.size("near"))
        ).first()
        if not fresh or fresh < STILL * all_:
            break
    code = nodes.select(F.col("node").alias("at"), "code", "scale")
    e = graph.select("node", F.explode("near.node").alias("at")).join(code, "at")
    links = materialise(e.groupBy("node").agg(F.collect_list(F.struct(F.col("at").alias("node"), "code", "scale")).alias("links")))
    entries = nodes.select("node", "code", "scale").orderBy(F.xxhash64("node"), "node").limit(ENTRIES)
    return Graph(nodes, links, entries, dims)


BEAMS = "beam array<struct<node:long,dist:float,open:boolean>>"


def _beams(d: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The nearest ``BEAM`` entries of a query; opened ones stay opened."""
    schema = StructType([*[d.schema[c] for c in keep], *StructType.fromDDL(BEAMS)])

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            row, e = _lists(batch.column("beam"))
            node, dist = e.field("node").to_numpy(), e.field("dist").to_numpy()
            open_ = e.field("open").to_numpy(zero_copy_only=False).astype(bool)
            pick = nearest_few(row, node, dist, open_, BEAM)
            sizes = np.bincount(row[pick], minlength=len(batch))
            yield {
                **{c: batch.column(c) for c in keep},
                "beam": _as_list(sizes, ("node", pa.array(node[pick])), ("dist", pa.array(dist[pick])), ("open", pa.array(open_[pick]))),
            }

    return map_batches(d, run, schema)


def _seen(frontier: DataFrame, dims: int) -> DataFrame:
    """What queries find behind the nodes they open, if nearer than their worst."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), FEW):
                part = batch.slice(i, FEW)
                row, e = _lists(part.column("links"))
                if not len(row):
                    continue
                q = _bytes(part.column("code"), dims).astype(np.float32) * part.column("scale").to_numpy()[:, None]
                dist = np.square(_decoded(e, dims) - q[row]).sum(axis=1)
                worst, query = part.column("worst").to_numpy(), part.column("query").to_numpy()
                node = e.field("node").to_numpy()
                ok = dist < worst[row]
                owner, node, dist = query[row[ok]], node[ok], dist[ok]
                pick = nearest_few(owner, node, dist, np.zeros(len(node), bool), BEAM)
                owners, sizes = np.unique(owner[pick], return_counts=True)
                yield {
                    "query": owners,
                    "beam": _as_list(sizes, ("node", pa.array(node[pick])), ("dist", pa.array(dist[pick])), ("open", pa.array(np.ones(len(pick), bool)))),
                }

    return map_batches(frontier, run, StructType.fromDDL(f"query long, {BEAMS}"))


def search(graph: Graph, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` nearest rows found for each row of ``queries`` (``_id``, ``_vec``).

    A query whose vector is a node starts there, all start from the entries too.
    Returns ``query_id``, ``rank``, ``vec_id`` and ``score``; the row of the graph
    with the query's own key and vector is left out.
    """
    dims = graph.dims
    q = queries.filter(F.size("_vec") == dims).select(F.monotonically_increasing_id().alias("query"), "_id", "_vec")
    own = graph.nodes.select(F.col("vec").alias("_vec"), F.col("node").alias("_own"))
    q = materialise(_coded(q, dims).join(own, "_vec", "left"))
    state = q.select("query", "code", "scale", _beam(F.array(F.coalesce("_own", F.lit(-1)))).alias("beam"))
    first = graph.entries.agg(F.collect_list(F.struct("node", "code", "scale")).alias("links"))  # ENTRIES at most
    start = state.select("query", "code", "scale", F.lit(float("inf")).cast("float").alias("worst")).crossJoin(F.broadcast(first))
    state = _widen(state, _seen(start, dims))
    for _ in range(HOPS):
        state = materialise(state)
        opened = F.slice(F.filter("beam", lambda v: v["open"]), 1, OPENED)
        if state.select(F.max(F.size(opened))).first()[0] in (None, 0):
            break
        worst = F.when(F.size("beam") >= BEAM, F.element_at("beam", -1)["dist"]).otherwise(F.lit(float("inf")).cast("float"))
        step = state.select("query", "code", "scale", worst.alias("worst"), F.explode(opened["node"]).alias("node"))
        last = F.element_at(opened, -1)
        closed = F.transform("beam", lambda v: v.withField("open", v["open"] & (F.struct(v["dist"], v["node"]) > F.struct(last["dist"], last["node"]))))
        state = state.withColumn("beam", F.when(F.size(opened) > 0, closed).otherwise(F.col("beam")))
        state = _widen(state, _seen(step.join(graph.links, "node").drop("node"), dims))
    # original vectors decide; of a beam all nodes are measured
    pairs = state.select("query", F.explode("beam.node").alias("node")).join(q.select("query", "_id", "_vec"), "query")
    square = F.aggregate(F.zip_with("_vec", "vec", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    pairs = pairs.join(graph.nodes.select("node", "vec", "ids"), "node").select("query", "_id", F.sqrt(square).alias("score"), (F.col("_vec") == F.col("vec")).alias("_same"), F.explode("ids").alias("vec_id"))
    pairs = pairs.filter(~(F.col("_same") & (F.col("_id") == F.col("vec_id"))))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    out = pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select(F.col("_id").alias("query_id"), "rank", "vec_id", "score")


def _coded(q: DataFrame, dims: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if len(batch):
                code, scale = encode(batch.column("_vec").flatten().to_numpy().reshape(-1, dims))
                yield {**{c: batch.column(c) for c in ("query", "_id", "_vec")}, "code": [c.tobytes() for c in code], "scale": scale}

    return map_batches(q, run, StructType.fromDDL(f"query long, _id long, _vec array<double>, {CODE}"))


def _beam(own: Column) -> Column:
    """A beam with the query's own node, if it has one."""
    some = F.filter(own, lambda v: v >= 0)
    return F.transform(some, lambda v: F.struct(v.alias("node"), F.lit(0.0).cast("float").alias("dist"), F.lit(True).alias("open")))


def _widen(state: DataFrame, seen: DataFrame) -> DataFrame:
    both = state.select("query", "beam", "code", "scale").unionByName(seen, allowMissingColumns=True)
    d = both.groupBy("query").agg(F.flatten(F.collect_list("beam")).alias("beam"), F.max("code").alias("code"), F.max("scale").alias("scale"))
    return _beams(d, ("query", "code", "scale"))


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(
    vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, rounds: int = ROUNDS
) -> DataFrame:
    """For the rows where ``queries`` is true: ``query_id``, ``rank`` (from 1),
    ``vec_id`` and ``score`` (Euclidean distance in double precision on the original
    vectors) of the ``k`` nearest other rows found; ties go to the smaller key.

    Rows whose key or vector is null, whose vector is zero, holds a null, NaN or
    infinity, or has another length than most, take no part. Rows of equal key and
    vector are one row; a key with several vectors is several rows and queries.
    Without usable rows the result is empty.
    """
    spark = vectors.sparkSession
    graph = build(vectors, key, vector, k + 1, rounds)
    if graph is None:
        return spark.createDataFrame([], RESULT)
    return search(graph, clean(vectors.filter(queries), key, vector), k)


def neighbour_report(embeddings: DataFrame) -> DataFrame:
    """``nearest`` for the rows whose ``vec_id`` is divisible by 100."""
    return nearest(embeddings, F.col("vec_id") % 100 == 0)
