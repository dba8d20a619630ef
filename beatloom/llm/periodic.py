"""Periodic runs of words inside documents, by seed-and-extend on diagonals.

A run with period q matches itself at lag q over at least ``max(6, 4q) - q`` words:
5 words for q = 1, 6 for q = 2, then 3q. So a k-gram with q <= k <= that overlap
stands at i and at i + q inside the run, and k = 5, 18, 57, ... (each three times
one more than the last) serve the lags up to k that the smaller ones do not.

Only the next occurrence of a k-gram in the same document is paired, so pairs are
linear in the words. Nothing is lost: q is the smallest period of a run of length
4q or more, so its parts of k >= q words recur at multiples of q only, and the next
occurrence is q words on. For the same reason a stretch found at lag d has no
smaller period. Pairs at one lag are one diagonal; a table of how far each diagonal
is covered lets every stretch be extended once.

k-grams are exact ranks (doubling of gram lengths), not hashes. Only words whose
shorter grams recur in their own document stay in play from one length to the next.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.llm.text import blobs, keyed, map_batches, schema_of

FEWEST = 6  # words of a run
REPEATS = 4  # periods of a run
BLOCK = 4_000_000  # bytes of texts whose words are ranked together

RUN = "array<struct<start:long,length:long,period:long>>"
FIELDS = f"n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs {RUN}, collapsed string"


def _recurring(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, dense ranks) of the keys that occur twice or more."""
    _, rank, n = np.unique(keys, return_inverse=True, return_counts=True)
    stay = n[rank] > 1
    return at[stay], rank[stay]


def _pairs(at: np.ndarray, rank: np.ndarray, above: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of next occurrences at a lag in (above, k]."""
    order = np.argsort(rank, kind="stable")
    p, r = at[order], rank[order]
    lag = p[1:] - p[:-1]
    ok = (r[1:] == r[:-1]) & (lag > above) & (lag <= k)
    return p[:-1][ok], lag[ok]


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of k-gram pairs of all levels; ``words`` are ranks of words
    that differ between documents."""
    n = len(words)
    places, lags = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    at, rank = _recurring(words, np.arange(n))
    width, above, k = 1, 0, FEWEST - 1
    full = np.full(n + 1, -1, dtype=np.int64)
    while len(at):
        full[:] = -1
        full[at] = rank
        shift = width if 2 * width <= k else k - width
        other = full[np.minimum(at + shift, n)]
        both = other >= 0
        at, key = at[both], rank[both] * (n + 1) + other[both]
        if 2 * width <= k:
            at, rank = _recurring(key, at)
            width *= 2
            continue
        # two grams of ``width`` cover k words; longer levels go on from ``width``
        p, d = _pairs(*_recurring(key, at), above, k)
        places.append(p)
        lags.append(d)
        at = np.flatnonzero(full >= 0)
        rank = full[at]
        above, k = k, 3 * (k + 1)
    return np.concatenate(places), np.concatenate(lags)


def _reach(words: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from i on, in direction ``step``, equal those ``lag`` later."""
    size, done, n = 16, 0, len(words)
    while True:
        first = i + step * done
        room = n - lag - first if step > 0 else first + 1
        take = min(size, room)
        if take <= 0:
            return done
        lo = first if step > 0 else first - take + 1
        differ = np.flatnonzero(words[lo : lo + take] != words[lo + lag : lo + lag + take])
        if len(differ):
            return done + int(differ[0] if step > 0 else take - 1 - differ[-1])
        done += take
        size *= 4


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    place, lag = seeds(words)
    order = np.lexsort((place, lag))
    place, lag = place[order], lag[order]
    head = np.ones(len(place), dtype=bool)
    head[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
    covered: dict[int, int] = {}
    out = []
    for i, d in zip(place[head].tolist(), lag[head].tolist()):
        if i < covered.get(d, 0):
            continue
        start = i - _reach(words, i - 1, d, -1)
        end = i + _reach(words, i, d, 1)
        covered[d] = end
        length = end - start + d
        if length >= max(FEWEST, REPEATS * d):
            out.append((start, length, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None


def _describe(texts: list[bytes]) -> dict[str, list]:
    """Columns of some texts, ranked together."""
    words = [t.split() for t in texts]  # bytes split at \x20 and \x09-\x0D alone
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.fromiter((x for w in words for x in w), dtype=object, count=int(sizes.sum()))
    code, known = pd.factorize(flat)
    doc = np.repeat(np.arange(len(texts)), sizes)
    own = doc * (len(known) + 1) + code  # no two documents share a word
    begin = np.concatenate([[0], np.cumsum(sizes)])
    per: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    dropped: dict[int, np.ndarray] = {}
    for s, n, q in runs_of(own):
        j = int(doc[s])
        s -= int(begin[j])
        per[j].append((s, n, q))
        gone = dropped.setdefault(j, np.zeros(sizes[j], dtype=bool))
        gone[s + q : s + n] = True
    best = [_strongest(r) for r in per]
    kept = [w if j not in dropped else [x for x, g in zip(w, dropped[j].tolist()) if not g] for j, w in enumerate(words)]
    return {
        "n_words": sizes.tolist(),
        "n_runs": [len(r) for r in per],
        **{f: [None if b is None else b[i] for b in best] for i, f in enumerate(("start", "length", "period"))},
        "exponent_milli": [None if b is None else 1000 * b[1] // b[2] for b in best],
        "runs": [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in per],
        "collapsed": [b" ".join(w).decode("utf-8", "replace") for w in kept],
    }


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``n_words``, ``n_runs``, the strongest run (``start``, ``length``,
    ``period``, ``exponent_milli``), all ``runs`` and the ``collapsed`` text.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, numbered from 0. The
    strongest run has the greatest length / period; ties go to the smaller start,
    then period; without runs its fields are null. ``collapsed`` keeps of each run
    its first period and joins the kept words by a space. Null, empty and blank
    texts have no words and an empty ``collapsed``. Rows are judged each for
    itself: null and repeated keys do no harm. A text is held by one task, as a row
    is; its memory and time grow with its words (times the logarithm), not with the
    squares of its repeats.
    """
    d = keyed(docs, key, text)
    schema = schema_of(d, key, FIELDS)

    def run(batches):
        for batch in batches:
            cols: dict[str, list] = {f.name: [] for f in schema.fields if f.name != key}
            part: list[bytes] = []
            size = 0
            rows = blobs(batch)
            for i, t in enumerate(rows):
                part.append(t)
                size += len(t)
                if size >= BLOCK or i == len(rows) - 1:
                    for name, values in _describe(part).items():
                        cols[name] += values
                    part, size = [], 0
            yield {key: batch.column(key), **cols}

    return map_batches(d, run, schema)


def plant_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text, where every tenth text (by the checksum h of its key, h % 10 = 0)
    ends in a repeated part.

    With n words, g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), word
    i >= a becomes word a + (i - a) % p; the words are then joined by a space. Other
    texts, those without words and rows without a key stay as they are.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    d = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("_t"), h.alias("_h"))
    words = F.filter(F.split("_t", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    d = d.withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    d = d.withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.floor(F.col("_h") / 10))
    n, g = F.col("_n"), F.col("_g")
    d = d.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    a, p = F.col("_a"), F.col("_p")

    def source(i: Column) -> Column:
        return F.element_at("_w", (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))

    planted = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), source), " ")
    return d.select(key, F.when(F.col("_a").isNotNull(), planted).otherwise(F.col("_t")).alias(text))


def run_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``find_runs`` on ``plant_runs``, with digests in place of runs and texts."""
    d = find_runs(plant_runs(docs, key, text), key, text)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return d.select(
        key, "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
