"""Near duplicates and repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from beatloom.llm import near_dup, suffix


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(texts, k, percent=80):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed=4):
    """Unrelated texts, chains of edits near the limit, one big family, copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(3, 120))) for _ in range(60)]
    base = rng.choices(words, k=100)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(100)] = rng.choice(words)
        texts.append(" ".join(w))
    step = rng.choices(words, k=80)
    for _ in range(12):
        step = list(step)
        for _ in range(4):
            step[rng.randrange(80)] = rng.choice(words)
        texts.append(" ".join(step))
    texts += [texts[3]] * 30 + [None, "", " \n", "one", "ONE", "one two", "One\ttwo", "x" * 9000, "the common line " * 2000]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k,block,long", [(2, 1024, 2048), (5, 1024, 12), (2, 7, 3)])
def test_classes_equal_brute_force(make, clash, monkeypatch, k, block, long):
    monkeypatch.setattr(near_dup, "BLOCK_DOCUMENTS", block)
    monkeypatch.setattr(near_dup, "LONG_LIST", long)
    monkeypatch.setattr(near_dup, "SMALL_LIST", min(8, long))
    texts = corpus()
    want, sizes = classes(texts, k)
    got = sorted(near_dup.near_duplicates(clash(make(texts)), k=k).collect())
    assert [r.doc_id for r in got] == list(range(len(texts)))
    assert [r.component_id for r in got] == want
    assert [r.n_shingles for r in got] == sizes
    assert [r.kept for r in got] == [c == i for i, c in enumerate(want)]


def test_one_of_each_class_stays(make):
    texts = corpus(8)
    want, _ = classes(texts, 5)
    d = make(texts)
    kept = near_dup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_empty_table(make):
    d = make(["a"]).limit(0)
    assert near_dup.near_duplicates(d).count() == 0
    assert suffix.remove_repeats(d).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.id: r.comp for r in near_dup.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[90], got[95], got[100]} == {90}


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [512, 1])
def test_removed_bytes_equal_brute_force(make, clash, monkeypatch, hot):
    monkeypatch.setattr(suffix, "SORTED", hot)
    monkeypatch.setattr(suffix, "CHUNK", 3000)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdé \n", k=n))
    passage, other = text(90), text(140)
    texts = [text(rng.randint(0, 300)) for _ in range(20)]
    texts += [text(50) + passage[rng.randint(0, 9) :] + text(50) for _ in range(15)]
    texts += [text(20) + other + text(20) + other for _ in range(4)]
    texts += [texts[2], texts[2], "z" * 700, None, "", passage[:39], passage[:40], "ab" * 300]
    got = sorted(suffix.remove_repeats(clash(make(texts)), length=40, gram=8).collect())
    assert [tuple(r)[1:5] for r in got] == repeats(texts, 40)
    assert [r.has_repeats for r in got] == [r.n_removed > 0 for r in got]


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(7)
    for _ in range(200):
        alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(256))])
        t = bytes(rng.choices(alphabet, k=rng.randint(1, 60)))
        assert suffix.suffix_order(t, np.arange(len(t)), 100).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_anchors_cover_every_window_and_see_only_it():
    rng = random.Random(8)
    for _ in range(50):
        t = bytes(rng.choices(b"ab", k=rng.randint(20, 90)))
        d = np.frombuffer(t, np.uint8)
        h, first, last = suffix.anchors(d, 20, 3)
        g = suffix.gram_hashes(d, 3)
        got = [(p, int(x)) for x, a, b in zip(h, first, last) for p in range(a, b + 1)]
        assert got == [(p, int(g[p : p + 18].min())) for p in range(len(t) - 19)]


def test_equal_windows_hold_no_lists(spark):
    """One passage under many contexts is counted by Spark, not listed in a task."""
    rows = [(1, c, i, i, 7) for c in range(3000) for i in range(3)] + [(1, c, 3, -c, 8) for c in range(3000)]
    got = suffix.equal_windows(spark.createDataFrame(rows, "hash long, ctx long, i int, w1 long, w2 long"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "SortMergeJoin" in plan and "MapInArrow" not in plan
    found = got.collect()
    assert len(found) == 3000
    assert all(sorted((r.a, r.b) for r in x.runs) == [(0, 1), (1, 2), (2, 3)] for x in found)


@pytest.mark.parametrize("hot", [512, 2])
def test_repeated_and_null_keys_are_rows_of_their_own(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "SORTED", hot)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("abc", k=n))
    one = text(60)
    rows = [(1, one + text(30)), (1, text(20) + one), (1, text(90)), (None, one + text(10)), (None, one + text(10)), (None, None)]
    rows += [rows[0], rows[3]] + [(k, one[k:] + text(50)) for k in range(12)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, gram=8).collect()
    want = [(k, *r) for (k, _), r in zip(rows, repeats([t for _, t in rows], 40))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_common_prefixes():
    rng = random.Random(10)
    t = np.array(rng.choices([1, 2], k=400), dtype=np.uint8)
    order = np.array(rng.sample(range(300), 200) + [5, 5])
    got = suffix.common_prefixes(t, order, 100)
    for a, b, n in zip(order, order[1:], got):
        differ = np.flatnonzero(t[a : a + 100] != t[b : b + 100])
        assert n == (differ[0] if len(differ) else 100)


def test_ties_of_a_group_of_near_copies_grow_with_its_size(spark):
    """Every list of a group has the same few hubs; the families are those of all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 64)
    rows = []
    for i in range(300):
        short = np.where(rng.random(64) < 0.1, rng.integers(0, 256, 64), base).astype(np.uint8)
        rows.append((i, int((short == base).sum()), short))
    # a list for each of 30 coordinates, with the members that have the common value
    posts = [(c, i, w, s.tobytes()) for c in range(30) for i, w, s in rows if s[c] == base[c]]
    got = near_dup._ties(spark.createDataFrame(posts, "cv long, id long, weight long, short binary"), 36).distinct().collect()
    assert {x for r in got for x in r} == set(range(300))
    assert len(got) < 5 * 300

    def joined(pairs, n):
        root = list(range(n))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return [min(j for j in range(n) if root[j] == r) for r in root]

    short = rng.integers(0, 2, (40, 8)).astype(np.uint8)  # ten lists of four
    a, b = near_dup.list_ties(np.full(10, 4), short, 5)
    every = [(i, j) for k in range(0, 40, 4) for i in range(k, k + 4) for j in range(i + 1, k + 4) if (short[i] == short[j]).sum() >= 5]
    assert joined(zip(a.tolist(), b.tolist()), 40) == joined(every, 40)
    assert len(a) == 40 - len(set(joined(every, 40)))
