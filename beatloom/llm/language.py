"""Language identification with bit-sliced Bloom filters of n-grams.

One filter per language, stored across: slot ``i`` holds 64-bit masks, one for every
64 languages, with a bit for every language whose filter has slot ``i`` set, so one lookup of an n-gram
returns all languages that hold it. A document's n-grams are looked up, counted
per language, and the counts are corrected by each filter's false-positive rate.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.text import keyed, map_batches, schema_of, texts

LETTER = regex.compile(r"\p{L}")
GRAMS = (3, 4)  # bytes
SLOTS = 1 << 18
HASHES = 3
MASK = 64  # languages per mask
_BUCKETS = 1 << 20  # n-grams are counted in as many classes
# Bytes of letters (ASCII letters lower-cased, all other bytes of
# UTF-8 sequences); everything else counts as a space.
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)], dtype=np.uint32)


def gram_codes(text: str) -> np.ndarray:
    """Codes in [0, 2^20) of all n-grams of a text, spaces at the ends included."""
    b = _FOLD[np.frombuffer(f" {text} ".encode(), dtype=np.uint8)]
    out = []
    for n in GRAMS:
        m = len(b) - n + 1
        if m > 0:
            x = np.full(m, n, dtype=np.uint32)
            for i in range(n):
                x = x * np.uint32(0x01000193) ^ b[i : i + m]
            x *= np.uint32(0x9E3779B1)
            out.append((x ^ (x >> np.uint32(15))) & np.uint32(_BUCKETS - 1))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


class Filters(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # masks x slots; language i is bit i % 64 of mask i // 64
    false_rate: np.ndarray  # per language


def _slots_of(code: np.ndarray) -> list[np.ndarray]:
    x = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return [((x >> np.uint64(64 - 18 - 18 * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def count_grams(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(lang, gram, n) over all labelled texts. Every task sums its texts first,
    so a language adds at most one row per n-gram class and task."""
    d = docs.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("lang"), F.col(text).alias("_text"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, t in zip(texts(batch, "lang"), texts(batch)):
                if lang not in sums:
                    if len(sums) == MASK:  # memory stays bounded with any labels
                        yield from out(sums)
                        sums = {}
                    sums[lang] = np.zeros(_BUCKETS, dtype=np.int64)
                codes = gram_codes(t)
                if len(codes) > _BUCKETS >> 3:
                    sums[lang] += np.bincount(codes, minlength=_BUCKETS)
                else:
                    u, n = np.unique(codes, return_counts=True)
                    sums[lang][u] += n
        yield from out(sums)

    def out(sums):
        for lang, s in sums.items():
            g = np.flatnonzero(s)
            yield {"lang": [lang] * len(g), "gram": g, "n": s[g]}

    counts = map_batches(d, run, schema_of(d.select("lang"), "lang", "gram int, n long"))
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", label: str = "lang", ratio: float = 0.5, least: float = 2e-5) -> Filters:
    """Filters from all labelled texts.

    A language's filter takes the n-grams whose share in the language is at least
    ``least`` and ``ratio`` times the largest share in any language: what is common
    everywhere is in all filters and decides nothing. The result is bounded by the
    number of n-gram classes times languages.
    """
    counts = count_grams(docs, text, label)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = share.groupBy("gram").agg(F.max("share").alias("best"))
    held = share.join(best, "gram").filter((F.col("share") >= least) & (F.col("share") >= ratio * F.col("best"))).select("lang", "gram")
    languages = [r[0] for r in total.select("lang").orderBy("lang").collect()]
    number = {lang: i for i, lang in enumerate(languages)}
    # at most 1 / least classes of a language reach the share
    rows = held.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    slots = np.zeros((max(1, -(-len(languages) // MASK)), SLOTS), dtype=np.uint64)
    for r in rows:
        i = number[r["lang"]]
        for s in _slots_of(np.array(r["grams"], dtype=np.uint32)):
            slots[i // MASK, s] |= np.uint64(1 << i % MASK)
    fill = np.array([float(((slots[i // MASK] >> np.uint64(i % MASK)) & np.uint64(1)).mean()) for i in range(len(languages))])
    return Filters(languages, slots, fill**HASHES)


def classify(f: Filters, text: str | None) -> tuple[str, float]:
    """Best language and its share of the corrected counts; ``und`` and 0 without
    a letter. Equal counts go to the first language by name."""
    if not text or not f.languages or not LETTER.search(text):
        return "und", 0.0
    codes = gram_codes(text)
    s = _slots_of(codes)
    mask = f.slots[:, s[0]] & f.slots[:, s[1]] & f.slots[:, s[2]]
    n = len(codes)
    hits = np.array([float(((mask[i // MASK] >> np.uint64(i % MASK)) & np.uint64(1)).sum()) for i in range(len(f.languages))])
    true = np.maximum(hits - n * f.false_rate, 0.0) / (1.0 - f.false_rate + 1e-12)
    best = int(true.argmax())
    return f.languages[best], float(true[best] / true.sum()) if true.sum() > 0 else 0.0


def identify(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` in [0, 1] of every whole text. The
    filters have a fixed size for every 64 languages and go to every executor."""
    d = keyed(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            found = [classify(shared.value, t) for t in texts(batch)]
            yield {key: batch.column(key), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    return map_batches(d, run, schema_of(d, key, "lang_pred string, score double"))


def language_report(docs: DataFrame) -> DataFrame:
    """Learned on documents whose crc32(doc_id) mod 4 is not 2, applied to all."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    filters = learn(docs.filter(~held).select("text", "lang"))
    return identify(docs, filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")


