"""Near-duplicate classes from MinHash signatures in an inverted index.

Documents with equal shingle sets become one representative. A representative is
posted under its coordinate-value pairs. Two signatures of K coordinates that
agree in ``matches`` of them share a posting among the ``n - matches + 1`` rarest
shared pairs of each (prefix); only those lists are merged, the long lists are
skipped and looked up in the signature when agreements are counted.

A list never yields all its pairs. Where it is searched, agreements of its members
are counted on short signatures (a byte of each coordinate, so that no agreement is
lost) and pairs at or above the match threshold become ties; members that are tied
already are skipped. A list too long for one task ties all its members to one.
Tied documents form a family, and every pair above the threshold lies inside one.
Inside a family agreements are counted on the signatures, and pairs at or above the
threshold are confirmed on the full shingle sets; pairs of one known class are
skipped. The most typical document goes first, so most members join its class at
once. A family too large for one task is cut into blocks that each hold its most
typical document; what has not joined that class is then compared with the
documents of the other blocks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beatloom.llm.text import blobs, keyed, map_batches, schema_of, sift
from beatloom.session import materialise

_M64 = (1 << 64) - 1
SMALL_LIST = 8
LONG_LIST = 2048  # members beyond which a list is not searched in one place
BLOCK_DOCUMENTS = 1024  # of a family, searched in one place
BLOCK_SHINGLES = 2_000_000
_KNOWN = 300_000  # remembered word hashes per worker; forgetting costs time only


class Shingler:
    """64-bit hashes of the distinct k-word shingles of a text."""

    def __init__(self, k: int):
        self.k = k
        self.known: dict[bytes, int] = {}

    def word_hashes(self, text: bytes) -> np.ndarray:
        """ASCII letters are lower-cased, ASCII white space separates."""
        words = text.lower().split()
        known = self.known
        try:
            h = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > _KNOWN:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = list(map(known.__getitem__, words))
        return np.array(h, dtype=np.uint64)

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted; the whole sequence is one shingle if it is shorter than k."""
        h = self.word_hashes(text)
        n = len(h)
        if n == 0:
            return h
        width = min(self.k, n)
        x = np.full(n - width + 1, width, dtype=np.uint64)
        for i in range(width):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i])
        return np.unique(x)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of len(a) hash functions, upper halves; rows of empty sets are 0."""
    out = np.zeros((len(sets), len(a)), dtype=np.int32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for j in range(len(a)):
            low = np.minimum.reduceat(x * a[j] + b[j], starts)
            out[full, j] = (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _functions(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, _M64, k, dtype=np.uint64, endpoint=True) | np.uint64(1)
    return a, rng.integers(0, _M64, k, dtype=np.uint64, endpoint=True)


def sign(docs: DataFrame, key: str, text: str, k: int, coordinates: int, seed: int) -> DataFrame:
    """``key``, ``n_shingles``, ``digest`` of the whole set, ``sig`` and a byte of
    each coordinate of it in ``short``."""
    d = keyed(docs, key, text)
    a, b = _functions(coordinates, seed)

    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            data = blobs(batch)
            n, digest, sig, at = [], [], [], 0
            while at < len(data):
                sets, size = [], 0
                while at < len(data) and size < 1_000_000:
                    sets.append(shingler.shingles(data[at]))
                    size += len(sets[-1])
                    at += 1
                n += map(len, sets)
                digest += [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                sig += list(signatures(sets, a, b))
            short = [(x & 255).astype(np.uint8).tobytes() for x in sig]
            yield {key: batch.column(key), "n_shingles": n, "digest": digest, "sig": sig, "short": short}

    return map_batches(d, run, schema_of(d, key, "n_shingles long, digest binary, sig array<int>, short binary"))


def list_ties(size: np.ndarray, short: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) tied within lists of the given sizes that follow each other.

    Small lists of one size are compared together, all pairs; in a longer list
    the members go one by one and meet only those not yet tied to them. Ties that
    join nothing new are left out, so a list has fewer ties than members.
    """
    first = np.cumsum(size) - size
    left, right = [], []
    for m in np.unique(size).tolist():
        at = first[size == m]
        if m <= SMALL_LIST:
            x, y = np.triu_indices(m, 1)
            roots = np.tile(np.arange(m), (len(at), 1))
            for i, j in zip(x.tolist(), y.tolist()):
                ok = (roots[:, i] != roots[:, j]) & ((short[at + i] == short[at + j]).sum(axis=1) >= matches)
                r = roots[ok]
                roots[ok] = np.where(r == r[:, j : j + 1], r[:, i : i + 1], r)
                left.append(at[ok] + i)
                right.append(at[ok] + j)
            continue
        for a in at.tolist():
            here, root = short[a : a + m], np.arange(m)
            for i in range(m - 1):
                near = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
                near = near[(here[near] == here[i]).sum(axis=1) >= matches]
                if len(near):
                    root[np.isin(root, root[near])] = root[i]
                    left.append(np.full(len(near), a + i))
                    right.append(a + near)
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _ties(posts: DataFrame, matches: int) -> DataFrame:
    """Ties of the lists in ``posts`` (cv, id, weight, short), searched list by list.

    The most typical members come first and are tied to the others: the lists of one
    group of near copies repeat the same few ties instead of adding their own.
    """
    kind = posts.schema["id"].dataType.simpleString()

    def run(batches):
        cv, ids, short = np.empty(0, dtype=np.int64), [], []

        def out(n):
            edge = np.concatenate([[0], np.flatnonzero(np.diff(cv[:n])) + 1, [n]])
            s = np.frombuffer(b"".join(short[:n]), dtype=np.uint8).reshape(n, -1)
            a, b = list_ties(np.diff(edge), s, matches)
            pairs = {(min(x, y), max(x, y)) for x, y in zip((ids[i] for i in a.tolist()), (ids[j] for j in b.tolist()))}
            return {"a": [x for x, _ in pairs], "b": [y for _, y in pairs]}

        for batch in batches:
            cv = np.concatenate([cv, batch.column("cv").to_numpy()])
            ids += batch.column("id").to_pylist()
            short += batch.column("short").to_pylist()
            n = int(np.searchsorted(cv, cv[-1])) if len(cv) else 0  # the last list may go on
            if n > 20_000:
                yield out(n)
                cv, ids, short = cv[n:], ids[n:], short[n:]
        if len(cv):
            yield out(len(cv))

    posts = posts.select("cv", "id", "weight", "short").repartition("cv").sortWithinPartitions("cv", F.desc("weight"), "id")
    return map_batches(posts, run, StructType.fromDDL(f"a {kind}, b {kind}"))


def components(links: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over undirected links (a, b).

    Every round takes the smallest label of the neighbours and then the label of
    that label; the number of rounds grows with the logarithm of a chain.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = label.join(near, "id").select("id", "comp", F.least("comp", "near").alias("to"))
        jump = label.select(F.col("id").alias("to"), F.col("comp").alias("far"))
        new = materialise(step.join(jump, "to", "left").select("id", "comp", F.least("to", F.coalesce("far", "to")).alias("new")))
        label = new.select("id", F.col("new").alias("comp"))
        if new.filter("new <> comp").isEmpty():
            return label


class Member(NamedTuple):
    """A document in a block. Pairs are compared if their sides differ or are 0."""

    id: object
    comp: object
    side: int
    weight: int
    text: bytes


def link_block(members: list[Member], shingler: Shingler, a: np.ndarray, b: np.ndarray, matches: int, percent: int) -> list[tuple]:
    """Links (id, id) that join the classes of a block; pairs within a class that
    is known, by ``comp`` or by links found before, are not compared."""
    members = sorted(members, key=lambda m: (-m.weight, m.id))
    n = len(members)
    sets = [shingler.shingles(m.text) for m in members]
    size = np.array([len(s) for s in sets])
    sig = signatures(sets, a, b)
    # a bit for each shingle that two of the documents hold
    kinds, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bit = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]
    owner = np.repeat(np.arange(n), size)[bit >= 0]
    bit = bit[bit >= 0]
    bits = np.zeros((n, int((times > 1).sum()) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    names: dict = {}
    root = np.array([names.setdefault(m.comp, len(names)) for m in members])
    side = np.array([m.side for m in members])
    links = []
    for i in range(n - 1):
        near = np.arange(i + 1, n)
        low, high = np.minimum(size[near], size[i]), np.maximum(size[near], size[i])
        near = near[(root[near] != root[i]) & ((side[near] != side[i]) | (side[i] == 0)) & (100 * low >= percent * high)]
        if len(near):
            near = near[(sig[near] == sig[i]).sum(axis=1) >= matches]
        if len(near):
            both = np.bitwise_count(bits[near] & bits[i]).sum(axis=1).astype(np.int64)
            near = near[100 * both >= percent * (size[near] + size[i] - both)]
        for j in near.tolist():
            if root[j] != root[i]:
                links.append((members[i].id, members[j].id))
                root[root == root[j]] = root[i]
    return links


def _link(rows: DataFrame, k: int, coordinates: int, seed: int, matches: int, percent: int) -> DataFrame:
    """Links of the blocks in ``rows`` (block, side, weight, id, comp, text)."""
    a, b = _functions(coordinates, seed)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        shingler = Shingler(k)
        block, members = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("id", "comp", "side", "weight")]
            for name, *m in zip(batch.column("block").to_pylist(), *cols, blobs(batch, "text")):
                if name != block and members:
                    yield out(link_block(members, shingler, a, b, matches, percent))
                    members = []
                block = name
                members.append(Member(*m))
        if members:
            yield out(link_block(members, shingler, a, b, matches, percent))

    def out(links):
        return {"a": [x for x, _ in links], "b": [y for _, y in links]}

    rows = rows.repartition("block").sortWithinPartitions("block")
    return map_batches(rows.select("block", "side", "weight", "id", "comp", "text"), run, StructType.fromDDL(f"a {kind}, b {kind}"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80,
    coordinates: int = 64, matches: int = 36, seed: int = 7,
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key reachable over links
    of similarity ``percent`` or more) and ``kept`` (the document has that key).

    Null, empty and blank texts have no shingles and are alone. Equal keys would
    be one document: keys must be unique. With 64 coordinates and 36 matches a
    pair at the limit is missed with a probability near 1e-5.
    """
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    signed = materialise(sign(d, "id", "text", k, coordinates, seed))
    full = signed.filter("n_shingles > 0")
    firsts = full.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = materialise(full.join(firsts.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n_shingles", "sig"))

    # postings under shared coordinate-value pairs, rarest first
    pair = F.col("_c").cast("long") * F.lit(1 << 32) + F.col("_v")
    posts = reps.select("id", "n_shingles", F.posexplode("sig").alias("_c", "_v")).select("id", "n_shingles", pair.alias("cv"))
    shared = posts.groupBy("cv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    mine = posts.join(shared, "cv").groupBy("id", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("n", "cv"))).alias("own"), F.sum("n").alias("weight"))
    mine = materialise(mine.filter(F.size("own") >= matches))
    shortest = F.slice("own", F.lit(1), F.size("own") - (matches - 1))
    prefix = mine.select("id", "weight", F.explode(shortest).alias("x")).select("id", "weight", "x.cv")
    sizes = prefix.groupBy("cv").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("weight", "id")).alias("top"))
    lists = materialise(sizes.filter("m > 1").select("cv", "m", F.col("top.id").alias("head")))
    # short lists are searched; a long one ties its members to its most typical one
    brief = prefix.join(lists.filter(F.col("m") <= LONG_LIST).select("cv"), "cv").join(signed.select("id", "short"), "id")
    long = prefix.join(lists.filter(F.col("m") > LONG_LIST), "cv").filter("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    ties = _ties(brief, matches).union(long).distinct()
    family = components(ties).withColumnRenamed("comp", "family")
    family = materialise(family.join(mine.select("id", "weight", "n_shingles"), "id"))
    typical = F.struct("weight", "id")
    sizes = family.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("held"), F.max(typical).alias("m"))
    cuts = F.ceil(F.greatest(F.col("n") / BLOCK_DOCUMENTS, F.col("held") / BLOCK_SHINGLES)).cast("int")
    sizes = materialise(sizes.select("family", F.col("m.id").alias("head"), cuts.alias("cuts")))
    where = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    placed = family.join(sizes, "family").withColumn("cut", where)
    # the most typical document of a family stands in each of its blocks
    guests = F.when(F.col("id") == F.col("head"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("cut"))
    member = placed.select("family", "id", "weight", "cuts", "head", "cut", F.explode(guests).alias("slot"))
    texts = materialise(sift(d, family.select("id"), "id"))

    def linked(rows: DataFrame) -> DataFrame:
        block = F.xxhash64("family", "slot", "other")
        return _link(rows.withColumn("block", block).join(texts, "id"), k, coordinates, seed, matches, percent)

    links = materialise(linked(member.withColumns({"other": F.lit(-1), "side": F.lit(0), "comp": F.col("id")})))
    label = components(links)
    # larger families: documents outside the head's class meet the other blocks
    large = placed.filter("cuts > 1").join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    main = large.filter("id = head").select("family", F.col("comp").alias("main"))
    large = materialise(large.join(main, "family").withColumn("stray", F.col("comp") != F.col("main")))
    strays = large.filter("stray").groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    parts = strays.select("family", F.ceil(F.col("n") / BLOCK_DOCUMENTS).cast("int").alias("parts"))
    large = large.join(parts, "family")  # families without strays are done
    part = F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts")).cast("int")
    here = large.select("family", "id", "weight", "comp", F.lit(1).alias("side"), F.col("cut").alias("slot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    there = large.filter("stray").select("family", "id", "weight", "comp", F.lit(2).alias("side"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("slot"), part.alias("other"))
    more = materialise(linked(here.union(there)))
    if not more.isEmpty():
        label = components(links.union(more))
    out = signed.join(firsts, "digest", "left")
    out = out.join(label.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    comp = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "rep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), "n_shingles", comp.alias("component_id"), (comp == F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each class (the one with the smallest key), columns unchanged."""
    kept = near_duplicates(docs, key, text, **how).filter("kept").select(key)
    return docs.join(kept, key, "left_semi").select(*docs.columns)
