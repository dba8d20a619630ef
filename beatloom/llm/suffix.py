"""Removal of byte strings that stand more than once in a corpus.

A window of ``length`` bytes has an anchor: the place of its smallest
``GRAM``-byte hash. The anchor depends on the window's bytes alone, so equal
windows meet under the same anchor hash. Neighbouring windows with one anchor
form a context; equal contexts are counted, and the different contexts of one
anchor hash go to a suffix array, which finds the windows they share.

Contexts of one hash that are too many for one suffix array are anchored anew by
longer and longer grams: windows that share little part, and parts that are equal as
a whole are counted. What still shares a gram of almost the window's length has few
windows left; Spark counts their digests and joins the repeated ones back.
The suffix array is built by two-stage sorting: suffixes smaller than their
successor are sorted directly, the others are induced by bucket scans; adjacent
common prefixes of ``length`` bytes or more mark the repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from beatloom.llm.text import blobs, keyed, map_batches, schema_of, sift, sifted
from beatloom.session import materialise

LENGTH = 400
GRAM = 64
SORTED = 512  # different contexts of one anchor hash that one suffix array takes
CHUNK = 1 << 19  # bytes of contexts sorted together
SEGMENT = 1 << 20  # windows whose anchors are found together
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, dtype=np.uint64))])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


STEP = 1 << 16


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of every ``width``-byte substring: prefix sums of a polynomial
    modulo 2^64, in steps, so that no table of powers grows with the text."""
    n = len(data) - width + 1
    out = np.empty(n, dtype=np.uint64)
    p = _powers(STEP + width)
    for at in range(0, n, STEP):
        part = data[at : at + STEP + width - 1].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * p[: len(part)])])
        m = len(part) - width + 1
        out[at : at + m] = (sums[width : width + m] - sums[:m]) * p[STEP - np.arange(m)]
    return _mix(out)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): runs of windows, starts first..last, that have one
    anchor, with its hash. Of equal smallest hashes the leftmost is the anchor."""
    h = gram_hashes(data, gram)
    w = length - gram + 1  # grams per window
    n = len(h) - w + 1
    # minimum of every w grams: running minima inside blocks of w, both ways
    pad = (-len(h)) % w
    hp = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(hp, axis=1).reshape(-1)
    back = np.minimum.accumulate(hp[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    # a run ends where the minimum changes or where its leftmost place leaves the window
    cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
    first = np.concatenate([[0], cuts])
    last = np.concatenate([cuts - 1, [n - 1]])
    hs, firsts, lasts = [], [], []
    for f, e in zip(first.tolist(), last.tolist()):
        v = low[f]
        spots = np.flatnonzero(h[f : e + w] == v) + f
        at = f
        for s in spots.tolist():
            if at > e:
                break
            to = min(e, s)
            if to >= at:
                hs.append(v)
                firsts.append(at)
                lasts.append(to)
                at = to + 1
    return np.array(hs, dtype=np.uint64), np.array(firsts), np.array(lasts)


def suffix_order(text: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes, compared over ``depth`` bytes.

    Two-stage sorting. A suffix is directly sorted if it is smaller than its
    successor; each of the others has a chain of larger predecessors that ends
    before a directly sorted one, so a scan of the buckets from small to large
    first bytes puts it behind its already placed successor.
    """
    t = np.frombuffer(text, dtype=np.uint8)
    n = len(t)
    # smaller than the successor: the next differing byte is larger; the end is smallest
    change = np.flatnonzero(t[1:] != t[:-1])
    runs = np.searchsorted(change, np.arange(n))
    small = np.zeros(n, dtype=bool)
    inside = runs < len(change)
    edge = change[np.minimum(runs, len(change) - 1)] if len(change) else np.zeros(n, dtype=int)
    small[inside] = t[edge[inside] + 1] > t[edge[inside]]
    # wanted suffixes and the chains from them to the next small one or the end
    ends = np.append(np.flatnonzero(small), n)
    chain = ends[np.searchsorted(ends, starts)]
    mark = np.zeros(n + 2, dtype=np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, chain + 1, -1)
    need = np.cumsum(mark[:n]) > 0
    direct = np.flatnonzero(need & small)
    keys = [text[i : i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    by_first: list[list[np.ndarray]] = [[] for _ in range(256)]  # induced, in order
    if need[n - 1]:  # the predecessor of the end
        by_first[t[n - 1]].append(np.array([n - 1]))
    lead = t[direct]
    bounds = np.searchsorted(lead, np.arange(257))
    out = []
    wanted = np.zeros(n, dtype=bool)
    wanted[starts] = True

    def induce(done: np.ndarray, c: int) -> np.ndarray:
        """Put the larger predecessors behind; returns those of the same bucket."""
        before = done - 1
        before = before[(done > 0)]
        before = before[need[before] & ~small[before]]
        head = t[before]
        same = before[head == c]
        far, head = before[head > c], head[head > c]
        if len(far):
            order = np.argsort(head, kind="stable")
            far, head = far[order], head[order]
            cut = np.flatnonzero(np.diff(head)) + 1
            for part in np.split(far, cut):
                by_first[t[part[0]]].append(part)
        return same

    for c in range(256):
        wave = np.concatenate(by_first[c]) if by_first[c] else np.empty(0, dtype=np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        own = direct[bounds[c] : bounds[c + 1]]
        if len(own):
            out.append(own)
            induce(own, c)
    order = np.concatenate(out) if out else np.empty(0, dtype=np.int64)
    return order[wanted[order]]


def common_prefixes(t: np.ndarray, order: np.ndarray, depth: int, step: int = 16) -> np.ndarray:
    """Lengths, up to ``depth``, of the common prefixes of neighbours in ``order``;
    every suffix has ``depth`` bytes."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    for at in range(0, depth, step):
        ahead = np.arange(at, min(at + step, depth))
        differ = t[a[live, None] + ahead] != t[b[live, None] + ahead]
        stop = differ.any(axis=1)
        out[live] = at + np.where(stop, differ.argmax(axis=1), len(ahead))
        live = live[~stop]
        if not len(live):
            break
    return out


def repeated_starts(contexts: list[bytes], spans: list[int], depth: int) -> list[np.ndarray]:
    """For each context, which of its first ``span`` windows of ``depth`` bytes
    stand in another context or elsewhere in it; boolean arrays."""
    text = b"".join(contexts)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])
    starts = np.concatenate([np.arange(b, b + s) for b, s in zip(base[:-1].tolist(), spans)])
    order = suffix_order(text, starts, depth)
    equal = common_prefixes(np.frombuffer(text, dtype=np.uint8), order, depth) >= depth
    again = np.zeros(len(text) + 1, dtype=bool)
    again[order[:-1][equal]] = True
    again[order[1:][equal]] = True
    return [again[b : b + s] for b, s in zip(base[:-1].tolist(), spans)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


CONTEXT = "array<struct<hash:long,ctx:long,first:int,last:int>>"


def survey(docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    """``key``, ``n_bytes``, ``sha`` of the text and its ``contexts``."""
    d = keyed(docs, key, text)

    def contexts(data: bytes) -> list[dict]:
        out, view = [], memoryview(data)
        for at in range(0, len(data) - length + 1, SEGMENT):
            part = np.frombuffer(view[at : at + SEGMENT + length - 1], dtype=np.uint8)
            hs, first, last = anchors(part, length, gram)
            out += [
                {"hash": h, "ctx": xxhash.xxh3_64_intdigest(view[f : e + length]) - (1 << 63), "first": f, "last": e}
                for h, f, e in zip(hs.view(np.int64).tolist(), (first + at).tolist(), (last + at).tolist())
            ]
        return out

    def run(batches):
        for batch in batches:
            data = blobs(batch)
            yield {
                key: batch.column(key), "n_bytes": [len(x) for x in data],
                "sha": [hashlib.sha256(x).digest() for x in data], "contexts": [contexts(x) for x in data],
            }

    return map_batches(d, run, schema_of(d, key, f"n_bytes long, sha binary, contexts {CONTEXT}"))


def equal_windows(windows: DataFrame) -> DataFrame:
    """``hash``, ``ctx`` and ``runs`` of the windows (hash, ctx, i, w1, w2) whose
    digest (w1, w2) stands in more than one row.

    Tasks count before they pass on, and the join back streams its rows past one
    row per digest (Spark splits a hot one): no list of equal windows is held. A
    context has a bounded number of windows.
    """
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    run = F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("b"))
    return windows.join(again.hint("merge"), ["w1", "w2"], "left_semi").groupBy("hash", "ctx").agg(F.collect_list(run).alias("runs"))


def _grams(gram: int, length: int) -> list[int]:
    """Gram lengths of the next anchors: doubled, the last leaves 16 places."""
    out = []
    while 2 * gram < length - 16:
        gram *= 2
        out.append(gram)
    return [*out, length - 16] if length - 16 > (out[-1] if out else gram) else out


RUNS = "runs array<struct<a:int,b:int>>"


def _sorted_runs(contexts: DataFrame, length: int) -> DataFrame:
    """``hash``, ``ctx``, ``runs`` from one suffix array per some hashes."""

    def sort(batches):
        def flush(rows):
            flags = repeated_starts([r[3] for r in rows], [r[2] for r in rows], length)
            hit = [(r[0], r[1], _runs(f)) for r, f in zip(rows, flags) if f.any()]
            return {"hash": [h[0] for h in hit], "ctx": [h[1] for h in hit], "runs": [[{"a": a, "b": b} for a, b in h[2]] for h in hit]}

        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("hash", "ctx", "span", "bytes"))):
                if rows and row[:2] == rows[-1][:2]:
                    continue  # the same context, from a row where key and text are the same
                if size >= CHUNK and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield flush(rows)

    d = contexts.repartition("hash").sortWithinPartitions("hash", "ctx")
    return map_batches(d, sort, StructType.fromDDL(f"hash long, ctx long, {RUNS}"))


def _parts(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Contexts of contexts: ``hash`` and ``ctx`` of the whole, ``off`` of the part's
    first window in it, and the part's own ``hash2``, ``ctx2``, ``span``, ``bytes``."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("hash", "ctx", "off", "hash2", "ctx2", "span", "bytes")}
            for h, c, data in zip(*(batch.column(n).to_pylist() for n in ("hash", "ctx", "bytes"))):
                for g, f, e in zip(*(x.tolist() for x in anchors(np.frombuffer(data, dtype=np.uint8), length, gram))):
                    part = data[f : e + length]
                    # equal windows share the anchors of all levels
                    pair = (h & ((1 << 64) - 1)).to_bytes(8, "little") + g.to_bytes(8, "little")
                    for n, v in zip(out, (h, c, f, xxhash.xxh3_64_intdigest(pair) - (1 << 63), xxhash.xxh3_64_intdigest(part) - (1 << 63), e - f + 1, part)):
                        out[n].append(v)
            yield out

    return map_batches(contexts, run, StructType.fromDDL("hash long, ctx long, off int, hash2 long, ctx2 long, span int, bytes binary"))


def _windows(contexts: DataFrame, length: int) -> DataFrame:
    """Each window of a context by its digest."""

    def run(batches):
        for batch in batches:
            hs, ctxs, places, digests = [], [], [], []
            for h, c, span, data in zip(*(batch.column(n).to_pylist() for n in ("hash", "ctx", "span", "bytes"))):
                hs += [h] * span
                ctxs += [c] * span
                places += range(span)
                digests += [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(span)]
            w = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield {"hash": hs, "ctx": ctxs, "i": places, "w1": w[:, 0], "w2": w[:, 1]}

    return map_batches(contexts, run, StructType.fromDDL("hash long, ctx long, i int, w1 long, w2 long"))


def shared_windows(kinds: DataFrame, bytes_of: Callable[[DataFrame], DataFrame], length: int, grams: list[int]) -> DataFrame:
    """``hash``, ``ctx``, ``runs``: windows of different contexts of one hash that
    are equal. ``kinds`` are distinct contexts of hashes with two or more;
    ``bytes_of`` gives some of them with ``span`` and ``bytes``. Hashes with too many
    contexts for one suffix array go through ``grams``."""
    m = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("m"))
    many = materialise(m.filter(F.col("m") > SORTED).select("hash"))
    if many.isEmpty():
        return _sorted_runs(bytes_of(kinds), length)
    few = _sorted_runs(bytes_of(kinds.join(many, "hash", "left_anti")), length)
    hot = materialise(bytes_of(kinds.join(many, "hash", "left_semi")).dropDuplicates(["hash", "ctx"]))
    if not grams:
        return few.unionByName(equal_windows(materialise(_windows(hot, length))))
    parts = materialise(_parts(hot, length, grams[0]))
    named = parts.select(F.col("hash2").alias("hash"), F.col("ctx2").alias("ctx"), "span", "bytes")
    own = materialise(named.groupBy("hash", "ctx").agg(F.count(F.lit(1)).alias("n"), F.first("span").alias("span")))
    alone = own.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("hash")
    # the bytes stay where they are written once; copies of a part are one
    own_bytes = lambda some: named.join(some.select("hash", "ctx"), ["hash", "ctx"], "left_semi").dropDuplicates(["hash", "ctx"])
    deeper = shared_windows(materialise(own.join(alone, "hash", "left_semi")), own_bytes, length, grams[1:])
    whole = own.filter("n > 1").select("hash", "ctx", F.array(F.struct(F.lit(0).alias("a"), F.col("span").alias("b"))).alias("runs"))
    found = deeper.unionByName(whole).withColumnsRenamed({"hash": "hash2", "ctx": "ctx2"})
    back = parts.select("hash", "ctx", "off", "hash2", "ctx2").join(found, ["hash2", "ctx2"])
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("off")).alias("a"), (r["b"] + F.col("off")).alias("b")))
    return few.unionByName(back.groupBy("hash", "ctx").agg(F.flatten(F.collect_list(moved)).alias("runs")))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id``: the key with a hash of the text, so that rows of one key or without a
    key are told apart by their texts; ``text``."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.struct(F.col(f"`{key}`").alias("key"), F.xxhash64(t).alias("hash")).alias("id"), t.alias("text"))


def repeated_starts_of(d: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(survey, starts) of ``id`` and ``text``: the surveyed documents, and for those
    with repeated windows the runs [a, b) of their starts, unordered and overlapping."""
    seen = materialise(survey(d, "id", "text", length, gram))
    posts = seen.select("id", F.inline("contexts"))
    kinds = posts.groupBy("hash", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "first", "last")).alias("at"))
    kinds = materialise(kinds.select("hash", "ctx", "n", "at.*"))
    groups = materialise(kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("hash"))
    mixed = materialise(sifted(kinds, groups, "hash").join(groups, "hash"))

    # contexts that are not alone under their hash: cut from the texts, from one of
    # the rows where id and text are equal
    def near(some: DataFrame) -> DataFrame:
        cuts = some.groupBy("id").agg(F.collect_list(F.struct("hash", "ctx", "first", "last")).alias("cuts"))
        texts = sift(d, some.select("id"), "id").join(cuts, "id").select(F.col("text").alias("_text"), "cuts")
        return map_batches(texts, cut, StructType.fromDDL("hash long, ctx long, span int, bytes binary"))

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {"hash": [], "ctx": [], "span": [], "bytes": []}
            for data, wanted in zip(blobs(batch), batch.column("cuts").to_pylist()):
                for c in wanted:  # the context, with its number of windows
                    f, span = c["first"], c["last"] - c["first"] + 1
                    out["hash"].append(c["hash"])
                    out["ctx"].append(c["ctx"])
                    out["span"].append(span)
                    out["bytes"].append(data[f : f + span - 1 + length])
                    if len(out["hash"]) > 50_000:
                        yield out
                        out = {n: [] for n in out}
            yield out

    shared = shared_windows(mixed, near, length, _grams(gram, length))
    whole = kinds.filter("n > 1").select("hash", "ctx", F.array(F.struct(F.lit(0).alias("a"), (F.col("last") - F.col("first") + 1).alias("b"))).alias("runs"))
    found = materialise(whole.unionByName(shared))
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b")))
    starts = sifted(posts, found, "ctx").join(found, ["hash", "ctx"]).groupBy("id").agg(F.flatten(F.collect_list(moved)).alias("starts"))
    return seen.select("id", "n_bytes", "sha"), starts


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``n_removed``, ``n_spans`` and
    ``kept_sha256`` of the remaining bytes.

    A byte goes if any ``length``-byte string that covers it starts anywhere else.
    Null and empty texts have no bytes. Rows of one key, or without one, are rows of
    their own, and their equal texts repeat one another. ``has_repeats`` says whether
    bytes were removed.
    """
    d = _named(docs, key, text)
    seen, starts = repeated_starts_of(d, length, gram)
    starts = materialise(starts)
    torn = sift(d, starts, "id").join(starts, "id").select("id", F.col("text").alias("_text"), "starts")

    def tear(batches):
        for batch in batches:
            removed, n, sha = [], [], []
            for data, starts in zip(blobs(batch), batch.column("starts").to_pylist()):
                flags = np.zeros(len(data) + 1, dtype=np.int32)
                a = np.array([s["a"] for s in starts])
                b = np.array([s["b"] for s in starts]) + length - 1
                np.add.at(flags, a, 1)
                np.add.at(flags, b, -1)
                gone = np.cumsum(flags[:-1]) > 0
                removed.append(int(gone.sum()))
                n.append(len(_runs(gone)))
                sha.append(hashlib.sha256(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()).hexdigest())
            yield {"id": batch.column("id"), "removed": removed, "spans": n, "left": sha}

    torn = map_batches(torn, tear, schema_of(seen.select("id"), "id", "removed long, spans long, left string")).dropDuplicates(["id"])
    none = F.lit(0).cast("long")
    return seen.join(torn, "id", "left").select(
        F.col("id.key").alias(key), "n_bytes", F.coalesce("removed", none).alias("n_removed"),
        F.coalesce("spans", none).alias("n_spans"), F.coalesce("left", F.lower(F.hex("sha"))).alias("kept_sha256"),
        (F.coalesce("removed", none) > 0).alias("has_repeats"),
    )
