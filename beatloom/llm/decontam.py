"""Benchmark decontamination with a positional index by document.

The index holds, per document, the postings (term, position) of benchmark terms.
It is cut by document, so every phrase is answered inside one block of the index
and no posting list of a frequent term is ever gathered. Term frequencies come
from the index; each benchmark window is looked up from its rarest terms, whose
position lists are shifted by their offsets and intersected.

The benchmark is a stated query set: it is read in blocks of bounded size, and
each block is looked up against all documents. The index is built again for every
block and holds that block's terms only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.text import blobs, keyed, map_batches, schema_of
from beatloom.session import materialise

# Word bytes are digits, ASCII letters and everything above ASCII.
_WORD = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 32 for b in range(256))

WINDOW = 10
BLOCK_BYTES = 8 << 20  # benchmark text per block: the bound of what is broadcast


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words. Only the space separates after folding."""
    return text.translate(_FOLD).split()


class Phrases(NamedTuple):
    """Windows of one block of items as term numbers; short items are padded."""

    terms: dict[bytes, int]
    windows: np.ndarray  # windows x WINDOW, -1 behind the end
    items: list[list[int]]  # item numbers of each window
    ids: list  # item keys by number


def phrases_of(items: list[tuple[object, bytes]], width: int = WINDOW) -> Phrases:
    terms: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[int]] = {}
    numbers: dict[object, int] = {}  # rows of one item are one item
    for item, text in items:
        ws = [terms.setdefault(w, len(terms)) for w in words_of(text)]
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            owners = windows.setdefault(tuple(ws[i : i + width]), set())
            if item is not None:  # words of an item without a key hit, but name nothing
                owners.add(numbers.setdefault(item, len(numbers)))
    rows = [[*w, *[-1] * (width - len(w))] for w in windows]
    return Phrases(terms, np.array(rows, dtype=np.int32).reshape(-1, width), [sorted(o) for o in windows.values()], list(numbers))


def blocks_of(items: DataFrame, key: str, text: str, size: int) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark, streamed to the driver in blocks of about ``size`` bytes."""
    block, n = [], 0
    for row in items.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator():
        block.append((row[0], row[1].encode()))
        n += len(block[-1][1])
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def build_index(docs: DataFrame, terms: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``key``, ``n_words`` and the postings in text order: ``terms``, ``at``."""
    d = keyed(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by BLOCK_BYTES

    def run(batches):
        get = shared.value.get
        for batch in batches:
            n, found, places = [], [], []
            for data in blobs(batch):
                ws = words_of(data)
                t = np.fromiter(map(get, ws, repeat(-1)), dtype=np.int32, count=len(ws))
                at = np.flatnonzero(t >= 0).astype(np.int32)
                n.append(len(ws))
                found.append(t[at])
                places.append(at)
            yield {key: batch.column(key), "n_words": n, "terms": found, "at": places}

    return map_batches(d, run, schema_of(d, key, "n_words long, terms array<int>, at array<int>"))


def term_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Postings per term over all documents; one row per benchmark term."""
    counts = index.select(F.explode("terms").alias("t")).groupBy("t").count()
    out = np.zeros(n_terms, dtype=np.int64)
    for t, n in counts.toLocalIterator():
        out[t] = n
    return out


class _Lookup:
    """Windows ordered for lookup: for each, offsets from the rarest term on."""

    def __init__(self, p: Phrases, freq: np.ndarray, near: int):
        self.p, self.near = p, near
        f = np.where(p.windows >= 0, freq[p.windows], np.iinfo(np.int64).max)
        self.order = np.argsort(f, axis=1, kind="stable")
        self.length = (p.windows >= 0).sum(axis=1)
        rarest = p.windows[np.arange(len(p.windows)), self.order[:, 0]] if len(p.windows) else np.empty(0, int)
        self.by_rarest: dict[int, list[int]] = {}
        self.by_near: dict[int, list[int]] = {}  # windows with absent terms, which only match nearly
        self.absent = ((p.windows >= 0) & (f == 0)).sum(axis=1)
        for w, t in enumerate(rarest.tolist()):
            gone = int(self.absent[w])
            if not gone:
                self.by_rarest.setdefault(t, []).append(w)
            elif 2 * gone <= self.length[w]:  # from the rarest term that does occur
                self.by_near.setdefault(int(p.windows[w][self.order[w][gone]]), []).append(w)
        self.is_rarest = np.zeros(max(1, len(freq)), dtype=bool)
        self.is_rarest[[*self.by_rarest, *self.by_near]] = True

    def run(self, n_words: int, terms: np.ndarray, at: np.ndarray) -> tuple[int, list[int], list[int], list[tuple[int, int]]]:
        """Hit words, items with an exact phrase, items with only a near match,
        and the merged hit runs [start, end) of a document."""
        heads = np.unique(terms[self.is_rarest[terms]]) if len(terms) else []
        if not len(heads):
            return 0, [], [], []
        lists: dict[int, np.ndarray] = {}

        def places(t: int) -> np.ndarray:
            if t not in lists:
                lists[t] = at[terms == t]
            return lists[t]

        hit = np.zeros(n_words + 1, dtype=np.int32)
        items: set[int] = set()
        close: set[int] = set()
        for head in heads.tolist():
            for w in self.by_near.get(head, ()):
                known = self.order[w][self.absent[w] : min(self.absent[w] + 4, self.length[w])]
                if self._near([int(self.p.windows[w][o]) for o in known], places):
                    close.update(self.p.items[w])
            for w in self.by_rarest.get(head, ()):
                row, size = self.p.windows[w], int(self.length[w])
                order = self.order[w][:size].tolist()
                starts = places(head) - order[0]
                starts = starts[(starts >= 0) & (starts + size <= n_words)]
                for o in order[1:]:
                    if not len(starts):
                        break
                    starts = starts[np.isin(starts + o, places(int(row[o])), assume_unique=True)]
                if len(starts):
                    np.add.at(hit, starts, 1)
                    np.add.at(hit, starts + size, -1)
                    items.update(self.p.items[w])
                elif self._near([int(row[o]) for o in order[: min(4, size)]], places):
                    close.update(self.p.items[w])
        covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
        cuts = np.flatnonzero(np.diff(covered) > 1) + 1
        runs = [(int(r[0]), int(r[-1]) + 1) for r in np.split(covered, cuts)] if len(covered) else []
        return len(covered), sorted(items), sorted(close - items), runs

    def _near(self, terms: list[int], places) -> bool:
        """The rarest terms, in any order, within ``near`` words of the first."""
        here = places(terms[0])
        for t in terms[1:]:
            there = places(t)
            if not len(there) or not len(here):
                return False
            i = np.searchsorted(there, here - self.near)
            ok = i < len(there)
            ok[ok] = there[i[ok]] <= here[ok] + self.near
            here = here[ok]
        return bool(len(here)) and len(set(terms)) > 1


def match_benchmark(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", width: int = WINDOW, near: int = 20, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``runs`` (hit word runs, start
    and exclusive end), ``items`` (keys of items with an exact phrase, as strings)
    and ``near_items`` (items of which only the rarest terms stand close together; of a window's terms
    at most half may occur in no document).

    Null and empty texts have no words and match nothing; so does an empty
    benchmark. Keys of documents must be unique if the benchmark needs more than
    one block.
    """
    parts = []
    for block in blocks_of(items, item_key, item_text, block_bytes):
        p = phrases_of(block, width)
        index = materialise(build_index(docs, p.terms, key, text))
        look = docs.sparkSession.sparkContext.broadcast(_Lookup(p, term_frequencies(index, len(p.terms)), near))

        def run(batches, look=look):
            lookup = look.value
            names = [str(i) for i in lookup.p.ids]
            for batch in batches:
                n = batch.column("n_words").to_pylist()
                rows = [
                    lookup.run(size, t, a)
                    for size, t, a in zip(n, _slices(batch.column("terms")), _slices(batch.column("at")))
                ]
                yield {
                    key: batch.column(key), "n_words": n,
                    "runs": [[{"start": s, "end": e} for s, e in r[3]] for r in rows],
                    "items": [[names[i] for i in r[1]] for r in rows],
                    "near_items": [[names[i] for i in r[2]] for r in rows],
                }

        schema = schema_of(index, key, "n_words long, runs array<struct<start:int,end:int>>, items array<string>, near_items array<string>")
        parts.append(map_batches(index, run, schema))
    if not parts:
        nothing = build_index(docs, {}, key, text)
        none = F.array().cast("array<string>")
        return nothing.select(key, "n_words", F.array().cast("array<struct<start:int,end:int>>").alias("runs"), none.alias("items"), none.alias("near_items"))
    if len(parts) == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    flat = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  a row per block of the benchmark
    out = out.groupBy(key).agg(
        F.first("n_words").alias("n_words"), F.array_sort(flat("runs")).alias("runs"),
        F.array_distinct(flat("items")).alias("items"), F.array_distinct(flat("near_items")).alias("near_items"),
    )
    return out.withColumns({"near_items": F.array_except("near_items", "items"), "runs": _union("runs")})


def _union(runs: str):
    """Sorted runs with overlapping and touching ones joined."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(
        runs, none,
        lambda a, r: F.when((F.size(a) > 0) & (r["start"] <= F.coalesce(F.get(a, F.size(a) - 1)["end"], F.lit(-1))),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], r["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(r))),
    )


def _slices(column) -> list[np.ndarray]:
    """The lists of an Arrow list column as views of one array."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    d = match_benchmark(docs, items)
    hit = F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"]).cast("long")
    return d.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without an exact benchmark phrase, columns unchanged."""
    bad = match_benchmark(docs, items, key, text, **how).filter(F.size("runs") > 0).select(key)
    return docs.join(bad, key, "left_anti").select(*docs.columns)


CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, array_to_string(w[p + 1 : p + 10], ' ') AS k, least(len(w), 10) AS n FROM i),
sizes AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS p, w FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, p, g.n, item_id FROM g JOIN q ON q.k = array_to_string(w[p + 1 : p + g.n], ' ') AND q.n = g.n),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS k FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items,
  sha256(coalesce(k, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
