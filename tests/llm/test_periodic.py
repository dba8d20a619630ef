"""Periodic runs against a search over all periods and starts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from beatloom.llm import periodic


def brute(words):
    """Every (start, length, period) by the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            smallest = next(p for p in range(1, q + 1) if all(part[x] == part[x + p] for x in range(length - p)))
            if length >= max(6, 4 * q) and smallest == q:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(re.findall("[^\x20\x09-\x0d]+", text or ""), doc_id)
    runs = brute(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(listed), sha(kept), len(words))


def periodic_text(rng, n):
    words = []
    while len(words) < n:
        root = [rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 5, 6, 7, 17, 19, 40, 60)))]
        words += (root * rng.randint(1, 7))[: rng.randint(1, 7 * len(root))]
    return words[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_the_definition(seed):
    rng = random.Random(seed)
    words = periodic_text(rng, rng.choice((0, 5, 6, 30, 200, 500)))
    ids = np.array([ord(w) for w in words], dtype=np.int64)
    assert periodic.runs_of(ids) == brute(words)


def test_report_equals_brute_force(spark, make, clash):
    rng = random.Random(7)
    texts = [" ".join(periodic_text(rng, rng.randint(0, 300))) for _ in range(60)]
    texts += [None, "", " \n", "x", "a " * 5000, "é 日本 🎉 " * 9, "a\x00b " * 8, "a b a b " * 6, texts[0], texts[0]]
    d = make(texts)
    got = sorted(map(tuple, periodic.run_report(clash(d)).collect()))
    assert got == [expected(i, t) for i, t in enumerate(texts)]


def test_keys_and_empty_tables(spark, make):
    s = "doc_id long, text string"
    rows = [(None, "b " * 9), (1, "b " * 9), (1, "b " * 9), (1, "b c " * 9)]
    got = sorted(map(tuple, periodic.find_runs(spark.createDataFrame(rows, s)).select("doc_id", "n_runs", "period", "collapsed").collect()), key=str)
    assert got == [(1, 1, 1, "b"), (1, 1, 1, "b"), (1, 1, 2, "b c"), (None, 1, 1, "b")]
    assert periodic.run_report(spark.createDataFrame([(None, "b " * 9)], s)).first().n_runs == 1
    assert periodic.run_report(make([])).collect() == []


def test_pairs_are_linear_in_the_words():
    for words in (np.zeros(30_000, dtype=np.int64), np.tile(np.arange(7), 5000)):
        assert len(periodic.seeds(words)[0]) <= len(words)


def test_given_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, periodic.run_report(d).collect()))
    short = {r.doc_id: r.text for r in d.collect() if len(r.text or "") < 6000}
    assert len(got) == d.count() and len(short) > 150
    assert [g for g in got if g[0] in short] == sorted(expected(i, t) for i, t in short.items())
