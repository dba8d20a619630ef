"""Masked pseudo-likelihood: every word scored from both of its sides.

A bidirectional window network reads the ``SIDE`` words before and behind a masked
word and predicts it: embeddings by position, one tanh layer, a softmax over
classes of tokens, then a binary tree of logistic decisions inside the class. A
token is a frequent word or a group of about ``GROUP`` rare words with one ending;
a group has a tree of its own down to the single word. Every decision starts at
the counted shares and is tilted by the context. The sum of the conditional
log-probabilities is the document's score.

All distinct words are counted; groups and trees grow with them. The network is
trained in NumPy inside tasks on every word of the corpus: in each round the tasks
start from common weights and run over a disjoint part of the documents, Spark
averages their weights by the number of words. The trees of the groups stay in a
Spark table; the rare words' contexts are dealt to them by group. Where the texts
scored are those learned from, one deal serves both: a task reads a group's contexts
to learn its tree and then again to score them.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beatloom.llm.text import keyed, map_batches, schema_of
from beatloom.session import materialise

SIDE = 2
WIDTH = 16
CLASSES = 48
VOCABULARY = 2048
RARE = 256  # classes of last letters, for words outside the vocabulary
GROUP = 4096  # rare words of one group, about
ROUNDS = 2
BATCH = 8192
_OFFSETS = (*range(-SIDE, 0), *range(1, SIDE + 1))
_COUNTED = 1 << 23  # bytes of text whose words are counted at once
_READ = 3 << 19  # bytes of text whose words are numbered at once
_PACKED = 1 << 18  # rare words a task holds before it passes them on
_SPOOL = 1 << 25  # bytes of one group's contexts in memory; more lie in a temporary file


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin; ``x`` is not empty."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])


class Tree:
    """Binary trees over leaves, split at about half of their mass. A decision's
    logit is that of the masses plus the product of context and node vector."""

    def __init__(self, parts: list[np.ndarray], mass: np.ndarray):
        lows, mids, highs, base = [], [], [], []
        order = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
        cum = np.concatenate([[0.0], np.cumsum(mass[order])])
        at = 0
        for p in parts:
            todo = [(at, at + len(p))]
            at += len(p)
            while todo:
                lo, hi = todo.pop()
                if hi - lo < 2:
                    continue
                mid = int(np.searchsorted(cum, (cum[lo] + cum[hi]) / 2))
                mid = min(max(mid, lo + 1), hi - 1)
                lows.append(lo)
                mids.append(mid)
                highs.append(hi)
                base.append(np.log(max(cum[mid] - cum[lo], 1e-9) / max(cum[hi] - cum[mid], 1e-9)))
                todo += [(lo, mid), (mid, hi)]
        lo, mid, hi = (np.array(x, dtype=np.int64) for x in (lows, mids, highs))
        self.base = np.array(base, dtype=np.float32)
        size = hi - lo
        node = np.repeat(np.arange(len(lo)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[node]
        leaf, sign = order[place], np.where(place < mid[node], 1.0, -1.0)
        by = np.argsort(leaf, kind="stable")
        self.node, self.sign = node[by], sign[by].astype(np.float32)
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(mass)))])
        self.rank = np.empty(len(mass), dtype=np.min_scalar_type(len(mass)))  # place from left to right
        self.rank[order] = np.arange(len(order))

    def sort(self, leaves: np.ndarray) -> np.ndarray:
        """Rows by leaf from left to right, as ``gradient`` wants them."""
        return np.argsort(self.rank[leaves], kind="stable")

    def paths(self, leaves: np.ndarray, by_level: bool = False):
        """Row and place in ``node`` and ``sign`` of every decision, by row or by
        level; then also where the levels end."""
        start = self.ptr[leaves]
        n = self.ptr[leaves.astype(np.int64) + 1] - start
        row, begin = np.repeat(np.arange(len(leaves)), n), np.cumsum(n) - n
        level = np.arange(len(row)) - begin[row]
        at = level + start[row]
        if not by_level:
            return row, at
        by = np.argsort(level.astype(np.uint16), kind="stable")
        return row[by], at[by], np.cumsum(np.bincount(level))

    def log_prob(self, leaves: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
        row, at = self.paths(leaves)
        node = self.node[at]
        z = self.sign[at] * (self.base[node] + np.einsum("ij,ij->i", h.take(row, axis=0), v.take(node, axis=0)))
        loss = np.log(1 + np.exp(-np.abs(z))) + np.maximum(-z, 0)
        return np.bincount(row, -loss, minlength=len(leaves))

    def gradient(self, leaves: np.ndarray, h: np.ndarray, v: np.ndarray, back: np.ndarray | None = None):
        """Of the loss: touched nodes and their gradients; that of ``h`` is added to
        ``back``. Rows come in the order of ``sort``: those of one node in one level lie
        together."""
        row, at, ends = self.paths(leaves, by_level=True)
        node, sign = self.node[at], self.sign[at]
        if not len(row):
            return node, np.empty((0, h.shape[1]), dtype=h.dtype)
        mine, own = h.take(row, axis=0), v.take(node, axis=0)
        z = sign * (self.base[node] + np.einsum("ij,ij->i", mine, own))
        g = (-sign / (1 + np.exp(np.minimum(z, 60))))[:, None]
        if back is not None:
            own *= g
            a = 0
            for b in ends.tolist():  # a row has one decision in a level
                back[row[a:b]] += own[a:b]
                a = b
        mine *= g
        first = _runs(node)
        return node[first], np.add.reduceat(mine, first, axis=0)


class Words(NamedTuple):
    """Tokens: vocabulary words, groups of rare words, and the text's edge."""

    number: dict[bytes, int]
    of_class: np.ndarray
    log_share: np.ndarray  # of a token in its class
    edge: int
    first: np.ndarray  # first group of each class of last letters
    groups: np.ndarray  # and how many it has
    tree: Tree  # inside the classes
    tail: DataFrame | None  # (token, digest, n) of every rare word; not sent to tasks

    def rare_token(self, word: bytes) -> int:
        s = zlib.crc32(word[-2:]) % RARE
        return int(self.first[s]) + zlib.crc32(word) % int(self.groups[s])

    def rare_tokens(self, words: pa.Array) -> np.ndarray:
        """``rare_token`` of each of the words, none of which is empty."""
        end = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset :][1 : len(words) + 1]
        size, data = pc.binary_length(words).to_numpy(), np.frombuffer(words.buffers()[2], dtype=np.uint8)
        s = _endings()[np.where(size > 1, data[end - 2] * np.int32(256), 65536) + data[end - 1]]
        token, several = self.first[s], np.flatnonzero(self.groups[s] > 1)
        crc = np.fromiter(map(zlib.crc32, words.take(pa.array(several)).to_numpy(zero_copy_only=False)), np.int64, len(several))
        token[several] += crc % self.groups[s[several]]
        return token

    def read(self, texts: pa.Array, digests: bool = False):
        """Words of each text; neighbours by offset and token of every word; the
        digests of the rare ones among them. Distinct words are hashed once."""
        lists = split_words(texts)
        each = lists.values.dictionary_encode()
        distinct = each.dictionary.cast(pa.binary())
        token = pc.index_in(distinct, pa.array(list(self.number), pa.binary())).fill_null(-1).to_numpy().astype(np.int64)
        size = pc.binary_length(distinct).to_numpy()
        rare = np.flatnonzero((token < 0) & (size > 0))
        unknown = distinct.take(pa.array(rare))
        if len(rare):
            token[rare] = self.rare_tokens(unknown)
        place = each.indices.to_numpy()
        row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        if not size.all():
            word = size[place] > 0
            row, place = row[word], place[word]
        word = token.astype(self.kind)[place]
        # texts are separated by edges
        at = np.arange(len(word)) + SIDE * (row + 1)
        line = np.full(len(word) + SIDE * (len(texts) + 1), self.edge, dtype=word.dtype)
        line[at] = word
        around, n = [line[at + o] for o in _OFFSETS], np.bincount(row, minlength=len(texts))
        if not digests:
            return n, around, word, None
        digest = np.zeros(len(token), dtype=np.uint64)
        digest[rare] = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in unknown.to_numpy(zero_copy_only=False)), np.uint64, len(rare))
        return n, around, word, digest[place[word >= self.first[0]]].view(np.int64)

    @property
    def kind(self) -> np.dtype:
        """Of an array of tokens."""
        return np.min_scalar_type(self.edge)

    def digests(self, text: bytes) -> np.ndarray:
        """Of the rare words, in text order, as Spark's xxhash64."""
        known = self.number
        return np.array([xxhash.xxh64_intdigest(w, 42) for w in text.lower().split() if w not in known], dtype=np.uint64).view(np.int64)


@cache
def _endings() -> np.ndarray:
    """Class of last letters by the last two bytes of a word, then by its only byte."""
    pairs = [bytes(divmod(i, 256)) for i in range(65536)] + [bytes([i]) for i in range(256)]
    return np.array([zlib.crc32(x) % RARE for x in pairs])


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-cased words of each text, also empty ones at its ends."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def blocks(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Slices of about ``size`` bytes."""
    block = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // size
    cuts = [*_runs(block).tolist(), len(block)] if len(block) else [0]
    return zip(cuts[:-1], cuts[1:])


def count_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n) over all texts; tasks count before they pass on."""
    d = keyed(docs, key, text).select("_text")

    def run(batches):
        for batch in batches:
            data = batch.column("_text")
            for a, b in blocks(data, _COUNTED):
                c = split_words(data.slice(a, b - a)).values.value_counts()
                c = c.filter(pc.not_equal(c.field("values"), ""))
                yield {"word": c.field("values").cast(pa.binary()), "n": c.field("counts")}

    return map_batches(d, run, StructType.fromDDL("word binary, n long")).groupBy("word").agg(F.sum("n").alias("n"))


def learn_words(docs: DataFrame, key: str, text: str) -> Words:
    """The most frequent words, and groups of all others by their last letters."""
    counts = materialise(count_words(docs, key, text))  # read several times
    head = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY)
    top = head.collect()
    number = {bytes(r["word"]): i for i, r in enumerate(top)}
    known = docs.sparkSession.createDataFrame([(bytearray(w),) for w in number], "word binary")
    ending = F.crc32(F.expr("substring(word, -2, 2)")) % RARE
    tail = counts.join(F.broadcast(known), "word", "left_anti").withColumn("s", ending.cast("int"))
    groups = np.ones(RARE, dtype=np.int64)
    for r in tail.groupBy("s").count().collect():
        groups[r["s"]] = -(-r["count"] // GROUP)
    first = VOCABULARY + np.cumsum(groups) - groups
    edge = VOCABULARY + int(groups.sum())
    lists = {c: F.expr(f"array({','.join(map(str, v.tolist()))})") for c, v in (("first", first), ("groups", groups))}
    token = (F.get(lists["first"], F.col("s")) + F.crc32("word") % F.get(lists["groups"], F.col("s"))).cast("int")
    tail = materialise(tail.select(token.alias("token"), F.xxhash64("word").alias("digest"), "n"))
    mass = np.zeros(edge + 1)
    mass[: len(top)] = [r["n"] for r in top]
    for r in tail.groupBy("token").agg(F.sum("n").alias("n")).collect():
        mass[r["token"]] = r["n"]
    mass += 0.5
    # classes of about equal mass over the tokens by frequency
    order = np.argsort(-mass, kind="stable")
    cum = np.cumsum(mass[order]) - mass[order] / 2
    of_class = np.empty(len(mass), dtype=np.int16)
    of_class[order] = np.minimum((cum / mass.sum() * CLASSES).astype(int), CLASSES - 1)
    class_mass = np.bincount(of_class, weights=mass, minlength=CLASSES)
    tree = Tree([order[of_class[order] == c] for c in range(CLASSES)], mass)
    return Words(number, of_class, np.log(mass / class_mass[of_class]), edge, first, groups, tree, tail)


class Network:
    """The weights as one matrix: embeddings by position, output and biases,
    then the nodes of the trees inside the classes."""

    trees: DataFrame | None = None  # of the groups of rare words; not sent to tasks

    def __init__(self, n_tokens: int, seed: int = 11):
        self.n_tokens = n_tokens
        rng = np.random.default_rng(seed)
        self.nodes = self.n_tokens * len(_OFFSETS) + CLASSES + 1 + -(-CLASSES // WIDTH)
        self.rows = self.nodes + self.n_tokens
        self.w = rng.normal(0, 0.1, (self.rows, WIDTH)).astype(np.float32)
        self.w[self.n_tokens * len(_OFFSETS) + CLASSES :] = 0

    def parts(self):
        n = self.n_tokens * len(_OFFSETS)
        embed = self.w[:n].reshape(len(_OFFSETS), self.n_tokens, WIDTH)
        return embed, self.w[n : n + CLASSES], self.w[n + CLASSES], self.w[n + CLASSES + 1 :].reshape(-1)[:CLASSES]

    def hidden(self, around: list[np.ndarray]) -> np.ndarray:
        embed, _, b, _ = self.parts()
        x = embed[0].take(around[0], axis=0)
        x += b
        for e, a in zip(embed[1:], around[1:]):
            x += e.take(a, axis=0)
        return np.tanh(x, out=x)

    def classes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits below 0 and their exponentials, a row per class."""
        _, out, _, b = self.parts()
        z = out @ h.T
        z += b[:, None]
        z -= z.max(axis=0)
        return z, np.exp(z)


class Trainer:
    """Adagrad over batches of words, in the order of the texts."""

    def __init__(self, net: Network, rate: float = 0.08):
        self.net, self.rate = net, rate
        self.squares = np.full(net.w.shape, 1e-3, dtype=np.float32)

    def _step(self, rows: np.ndarray | slice, grad: np.ndarray) -> None:
        s = self.squares[rows] + grad * grad
        self.squares[rows] = s
        self.net.w[rows] -= self.rate * grad / np.sqrt(s)

    def fit(self, around: list[np.ndarray], word: np.ndarray, ws: Words) -> None:
        net, n = self.net, self.net.n_tokens * len(_OFFSETS)
        by = ws.tree.sort(word)
        word, around = word[by], [a[by] for a in around]
        h = net.hidden(around)
        _, d = net.classes(h)
        d /= d.sum(axis=0)
        d[ws.of_class[word], np.arange(len(word))] -= 1
        _, out, _, _ = net.parts()
        back = d.T @ out
        node, tilt = ws.tree.gradient(word, h, net.w[net.nodes :], back)
        back *= 1 - h * h
        size = np.float32(1.0 / np.sqrt(len(word)))
        bias = np.zeros(WIDTH * -(-CLASSES // WIDTH), dtype=np.float32)
        bias[:CLASSES] = d.sum(axis=1)
        rest = np.concatenate([d @ h, back.sum(axis=0)[None], bias.reshape(-1, WIDTH)]) * size
        for i, a in enumerate(around):
            order = np.argsort(a, kind="stable")
            a = a[order]
            first = _runs(a)
            self._step(a[first].astype(np.int64) + i * net.n_tokens, np.add.reduceat(back.take(order, axis=0), first, axis=0) * size)
        self._step(slice(n, net.nodes), rest)
        self._step(node + net.nodes, tilt * size)


def train(docs: DataFrame, words: Words, key: str, text: str, rounds: int = ROUNDS, seed: int = 11) -> Network:
    """The network, then the trees of the rare words' groups, on all documents."""
    net = train_network(docs, words, key, text, rounds, seed)
    net.trees = learn_trees(docs, words, net, key, text)
    return net


def train_network(docs: DataFrame, words: Words, key: str, text: str, rounds: int = ROUNDS, seed: int = 11) -> Network:
    """Weights after ``rounds`` parallel passes over disjoint parts of the corpus,
    dealt by the hash of the text; together they hold every document once."""
    net = Network(words.edge + 1, seed)
    spark = docs.sparkSession
    d = keyed(docs, key, text).select("_text")
    columns = [f"w{j}" for j in range(WIDTH)]
    schema = StructType.fromDDL("row int, n double, " + ", ".join(f"{c} float" for c in columns))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((net, words._replace(tail=None)))
        mine = d.filter(F.pmod(F.xxhash64("_text"), F.lit(rounds)) == r)

        def run(batches, shared=shared):
            start, ws = shared.value
            own = Network.__new__(Network)
            own.__dict__.update(start.__dict__)
            own.w = start.w.copy()
            trainer, n = Trainer(own), 0
            for batch in batches:
                data = batch.column("_text")
                for i, j in blocks(data, _READ):
                    _, around, word, _ = ws.read(data.slice(i, j - i))
                    for a in range(0, len(word), BATCH):
                        b = slice(a, a + BATCH)
                        trainer.fit([x[b] for x in around], word[b], ws)
                    n += len(word)
            if n:
                yield {"row": np.arange(own.rows), "n": np.full(own.rows, float(n))} | {c: own.w[:, j] for j, c in enumerate(columns)}

        moved = map_batches(mine, run, schema).groupBy("row").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in columns])
        rows = moved.collect()  # as many as the network has, whatever the corpus
        for row in rows:
            net.w[row["row"]] = row[1:]
    return net


def _light(net: Network) -> Network:
    own = Network.__new__(Network)
    own.__dict__.update({k: v for k, v in net.__dict__.items() if k != "trees"})
    return own


def route(docs: DataFrame, words: Words, net: Network, key: str, text: str, scored: bool) -> DataFrame:
    """Packs (token, data) of rare words: the words around them, digest and number
    of the document in this task. With ``scored`` also a row per document, its
    likelihood down to the groups; it has a negative token."""
    d = keyed(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast((_light(net), words._replace(tail=None)))

    def log_probs(around: list[np.ndarray], word: np.ndarray, ws: Words, model: Network) -> np.ndarray:
        out = np.empty(len(word))
        for a in range(0, len(word), BATCH):
            b = slice(a, a + BATCH)
            h, w = model.hidden([x[b] for x in around]), word[b]
            z, e = model.classes(h)
            out[b] = z[ws.of_class[w], np.arange(len(w))] - np.log(e.sum(axis=0)) + ws.tree.log_prob(w, h, model.w[model.nodes :])
        return out

    def packs(held: list[tuple[np.ndarray, np.ndarray]], at: int) -> dict:
        token = np.concatenate([x[0] for x in held])
        by = np.argsort(token, kind="stable")
        token, data = token[by], np.concatenate([x[1] for x in held])[by]
        cuts = np.append(_runs(token), len(token))
        n = len(cuts) - 1
        return {
            "token": token[cuts[:-1]], "kind": [1] * n, "data": [data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])],
            "base": [at] * n, key: [None] * n, "n_words": [None] * n, "lp": [None] * n,
        }

    def run(batches):
        model, ws = shared.value
        pack = pack_type(ws.kind)
        start = TaskContext.get().partitionId() << 33
        done = 0
        for batch in batches:
            keys, data = batch.column(key), batch.column("_text")
            held, size = [], 0
            for a, b in blocks(data, _READ):
                n, around, word, digests = ws.read(data.slice(a, b - a), digests=True)
                if scored:
                    part = np.concatenate([[0.0], np.cumsum(log_probs(around, word, ws, model))])
                    ends = np.concatenate([[0], np.cumsum(n)])
                    m = b - a
                    yield {
                        "token": [-1 - (i & 1023) for i in range(m)], "kind": [1] * m, "data": [None] * m,
                        "base": range(start + done + a, start + done + b), key: keys.slice(a, m),
                        "n_words": n, "lp": part[ends[1:]] - part[ends[:-1]],
                    }
                rare = np.flatnonzero(word >= ws.first[0])
                if len(rare):
                    row = np.empty(len(rare), dtype=pack)
                    row["around"] = np.stack([x[rare] for x in around], axis=1)
                    row["digest"] = digests
                    row["doc"] = np.repeat(np.arange(a, b), n)[rare]
                    held.append((word[rare], row))
                    size += len(rare)
                if size >= _PACKED:
                    yield packs(held, start + done)
                    held, size = [], 0
            if held:
                yield packs(held, start + done)
            done += len(data)

    return map_batches(d, run, schema_of(d, key, "token int, kind int, data binary, base long, n_words long, lp double"))


def pack_type(kind: np.dtype) -> np.dtype:
    return np.dtype([("around", kind, (len(_OFFSETS),)), ("digest", "<i8"), ("doc", "<i4")])


def _with_trees(packs: DataFrame, trees: DataFrame) -> DataFrame:
    """Rows of one group together, its tree (kind 0) first."""
    return packs.unionByName(trees.withColumn("kind", F.lit(0)), allowMissingColumns=True).repartition("token").sortWithinPartitions("token", "kind")


class _Group:
    """The tree of a group: leaves by digest, the last one for words never seen."""

    def __init__(self, digests: np.ndarray, n: np.ndarray, v: np.ndarray | None = None):
        by = np.argsort(digests)
        self.digests, self.n = digests[by], n[by]
        self.tree = Tree([np.arange(len(n) + 1)], np.append(self.n, 0.5).astype(float))
        self.v = np.zeros((len(n), WIDTH), dtype=np.float32) if v is None else v
        self.squares = np.full(self.v.shape, 1e-3, dtype=np.float32)

    def leaves(self, digest: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.digests, digest), len(self.digests) - 1)
        return np.where(self.digests[at] == digest, at, len(self.digests))

    def fit(self, rows: np.ndarray, net: Network, rate: float = 0.08) -> None:
        leaves = self.leaves(rows["digest"])
        by = self.tree.sort(leaves)
        node, g = self.tree.gradient(leaves[by], net.hidden(list(rows["around"][by].T)), self.v)
        g /= np.float32(np.sqrt(len(rows)))
        s = self.squares[node] + g * g
        self.squares[node] = s
        self.v[node] -= rate * g / np.sqrt(s)

    def log_prob(self, rows: np.ndarray, net: Network) -> np.ndarray:
        return self.tree.log_prob(self.leaves(rows["digest"]), net.hidden(list(rows["around"].T)), self.v)


class _Contexts:
    """A group's packs, to be read more than once; many lie in a temporary file."""

    def __init__(self, pack: np.dtype, held: int):
        self.pack, self.file = pack, tempfile.SpooledTemporaryFile(max_size=held)
        self.bases: list[int] = []
        self.ends: list[int] = []

    def add(self, data: bytes, base: int) -> None:
        self.file.write(data)
        self.bases.append(base)
        self.ends.append((self.ends[-1] if self.ends else 0) + len(data) // self.pack.itemsize)

    def blocks(self, n: int) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while data := self.file.read(n * self.pack.itemsize):
            yield np.frombuffer(data, dtype=self.pack)

    def numbered(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks with the number of each row's document."""
        bases, ends, at = np.array(self.bases, dtype=np.int64), np.array(self.ends, dtype=np.int64), 0
        for rows in self.blocks(n):
            yield rows, bases[np.searchsorted(ends, np.arange(at, at + len(rows)), side="right")] + rows["doc"]
            at += len(rows)


def _per_group(packs: DataFrame, trees: DataFrame, words: Words, net: Network, schema: StructType, learn: bool, key: str | None) -> DataFrame:
    """Each group's packs meet its tree in one task, one group at a time. With
    ``learn`` the tree is first trained on them. Gives the trees, or with a ``key``
    the parts of the documents' likelihoods; a group without words gives all its mass
    to new ones."""
    kind, shared = words.kind, packs.sparkSession.sparkContext.broadcast(_light(net))

    def run(batches):
        model, pack = shared.value, pack_type(kind)
        token, group, rows = None, None, None

        def parts(number, part):
            base, place = np.unique(np.concatenate(number), return_inverse=True)
            lp = np.bincount(place, np.concatenate(part), minlength=len(base))
            return {"base": base, key: [None] * len(base), "n_words": [None] * len(base), "lp": lp}

        def close():
            if group is None:
                return
            if learn:
                for block in rows.blocks(BATCH // 4):
                    group.fit(block, model)
            if key is None:
                yield {"token": [token], "digests": [group.digests], "counts": [group.n], "v": [group.v.tobytes()]}
                return
            number, part, held = [], [], 0
            for block, docs_ in rows.numbered(BATCH // 2):
                number.append(docs_)
                part.append(group.log_prob(block, model))
                held += len(block)
                if held >= _PACKED:
                    yield parts(number, part)
                    number, part, held = [], [], 0
            if number:
                yield parts(number, part)

        for batch in batches:
            if key is not None:
                own = batch.filter(pc.less(batch.column("token"), 0))
                if own.num_rows:
                    yield {c: own.column(c) for c in ("base", key, "n_words", "lp")}
                batch = batch.filter(pc.greater_equal(batch.column("token"), 0))
            names = ("token", "base", "data", "digests", "counts", "v")
            for t, base, data, digests, counts, v in zip(*(batch.column(c) for c in names)):
                if t.as_py() != token:
                    yield from close()
                    token, group, rows = t.as_py(), None, _Contexts(pack, _SPOOL)
                if digests.is_valid:
                    w = np.frombuffer(v.as_py(), dtype=np.float32).reshape(-1, WIDTH) if v.is_valid else None
                    group = _Group(digests.values.to_numpy(), counts.values.to_numpy(), w)
                elif group is not None:
                    rows.add(data.as_py(), base.as_py())
        yield from close()

    if "v" not in trees.columns:
        trees = trees.withColumn("v", F.lit(None).cast("binary"))
    return map_batches(_with_trees(packs, trees), run, schema)


def _leaves(words: Words) -> DataFrame:
    """(token, digests, counts) of the rare words of each group."""
    pairs = F.array_sort(F.collect_list(F.struct("digest", "n")))
    return words.tail.groupBy("token").agg(pairs.alias("w")).select("token", F.col("w.digest").alias("digests"), F.col("w.n").alias("counts"))


def learn_trees(docs: DataFrame, words: Words, net: Network, key: str, text: str) -> DataFrame:
    """(token, digests, counts, v): one tree per group of rare words, trained on
    all their occurrences."""
    packs = route(docs, words, net, key, text, False).select("token", "kind", "data", "base")
    schema = StructType.fromDDL("token int, digests array<long>, counts array<long>, v binary")
    return materialise(_per_group(packs, _leaves(words), words, net, schema, True, None))


def score(docs: DataFrame, words: Words, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Likelihood down to the groups where the text is, the rest where the group's
    tree is; the parts meet under a number of the row, so keys may repeat. A network
    without trees learns them from these documents, in the same deal."""
    packs = route(docs, words, net, key, text, True)
    trees = _leaves(words) if net.trees is None else net.trees
    parts = _per_group(packs, trees, words, net, schema_of(packs, key, "base long, n_words long, lp double"), net.trees is None, key)
    out = parts.groupBy("base").agg(F.first(key, ignorenulls=True).alias(key), F.max("n_words").alias("n_words"), F.sum("lp").alias("log_likelihood"))
    return out.select(key, "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")).alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``log_likelihood`` (sum over words) and its mean.

    Words are split at ASCII white space, ASCII letters lower-cased. Null, empty
    and blank texts have 0 words, likelihood 0 and a null mean. An empty table
    trains nothing and gives no rows.
    """
    words = learn_words(docs, key, text)
    return score(docs, words, train_network(docs, words, key, text), key, text)
