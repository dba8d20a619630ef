"""Quality rules, decontamination, language identification, pseudo-likelihood."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from beatloom.llm import decontam, language, pseudo_likelihood, quality
from beatloom.llm.queries import ORACLES, QUERIES

SF = os.environ.get("LLM_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert sorted(tuple(r) for r in df.select(*cols).collect()) == want


def measures(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + j for i in at for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(make, clash):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "a b c a b c", "a a a a", "x\ny\nx\n\nx", "é # | <z>", "w " * 20000, " lead", "\x0b\x0c\x1c\x85 x"]
    texts += [" ".join(rng.choices("abcd", k=rng.randint(1, 60))) + "\n" * rng.randint(0, 2) for _ in range(40)]
    got = sorted(quality.measure(clash(make(texts)).drop("n_words")).collect())
    assert [tuple(r)[1:6] for r in got] == [measures(t) for t in texts]


def test_host_verdicts(make):
    rng = random.Random(5)
    clean = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60))
    some = " ".join(["#"] * 4)  # within the limit, beyond the strict one
    rows = [(clean(), "good") for _ in range(40)] + [(f"{clean()} {some}", "good")]
    rows += [("too short", "bad") for _ in range(40)] + [(f"{clean()} {some}", "bad"), (clean(), "bad"), (None, None), (clean(), None)]
    got = {r.doc_id: r for r in quality.judge(make(rows)).collect()}
    assert all(got[i].kept for i in range(41))  # forgiven on a good host
    assert not any(got[i].kept for i in range(41, 81))
    assert not got[81].kept and got[82].kept  # the same text on a bad host; a clean one stays
    assert not got[83].kept and got[84].kept
    assert got[81].host_rate > 0.5 > got[0].host_rate
    d = make(rows)
    assert quality.keep_good(d).columns == d.columns
    assert quality.judge(d.limit(0)).count() == 0


def brute_match(texts, items, width=10):
    fold = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for t in texts:
        w, hit, found = fold(t), set(), set()
        for i, b in items:
            b = fold(b)
            for p in range(max(1, len(b) - width + 1)) if b else ():
                x = b[p : p + width]
                for s in range(len(w) - len(x) + 1):
                    if w[s : s + len(x)] == x:
                        hit |= set(range(s, s + len(x)))
                        found.add(str(i))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_phrases_equal_brute_force(spark, make, clash, block, monkeypatch):
    rng = random.Random(9)
    words = ["the", "a", "é", *[f"w{i}" for i in range(30)]]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(12)] + [(12, None), (13, "--"), (14, "the the the the"), (15, "Short-Item")]
    texts = [None, "", "--", "the " * 50, "x SHORT item y"]
    for _ in range(30):
        t = rng.choices(words, k=rng.randint(5, 60))
        b = (rng.choice(items[:12])[1] or "").split()
        at = rng.randrange(len(t))
        texts.append(", ".join(t[:at] + b[rng.randint(0, 8) :] + t[at:]).upper().replace("É", "é"))
    table = spark.createDataFrame(items, "item_id long, text string")
    d = decontam.match_benchmark
    monkeypatch.setattr(decontam, "match_benchmark", lambda x, y: d(x, y, block_bytes=block))
    got = sorted(decontam.contamination_report(clash(make(texts)), table).collect())
    assert [tuple(r)[1:] for r in got] == brute_match(texts, items)


def test_near_matches_and_empty_tables(spark, make):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    shuffled = " ".join(reversed(item.split()))
    far = " ".join(f"{w} " + "fill " * 60 for w in item.split())
    got = {r.doc_id: r for r in decontam.match_benchmark(make([item, shuffled, far]), table).collect()}
    assert (got[0].items, got[0].near_items) == (["1"], []) and got[0].runs[0].asDict() == {"start": 0, "end": 10}
    assert (got[1].items, got[1].near_items) == ([], ["1"]) and got[2].near_items == []
    assert decontam.contamination_report(make(["x"]), table.limit(0)).first().n_hit == 0
    assert decontam.contamination_report(make(["x"]).limit(0), table).count() == 0
    d = make([item, "other"])
    assert decontam.drop_contaminated(d, table).columns == d.columns
    assert [r.doc_id for r in decontam.drop_contaminated(d, table).collect()] == [1]


def test_language_held_out_accuracy(spark):
    got = language.language_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and len(held) > 20
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0.0 <= r.score <= 1.0 for r in got)


def test_language_odd_rows(spark, make, odd, clash):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "de"), ("x", None)], "text string, lang string")
    f = language.learn(train)
    assert f.languages == ["de", "en"]
    got = {r.doc_id: r for r in language.identify(clash(odd), f).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 7)] == ["und"] * 4 and got[4].lang_pred != ""
    assert language.identify(odd.limit(0), f).count() == 0
    none = language.learn(train.limit(0))
    assert none.languages == [] and language.classify(none, "text") == ("und", 0.0)


def test_filters_hold_what_was_put_in():
    codes = np.arange(0, 1 << 20, 4099, dtype=np.uint32)
    slots = language._slots_of(codes)
    assert len(slots) == language.HASHES and all(s.min() >= 0 and s.max() < language.SLOTS for s in slots)


def test_network_learns_both_sides(make, monkeypatch):
    """A word that its two neighbours decide together is scored above its share."""
    rng = random.Random(2)
    follow = {(a, b): "pqrs"[(2 * i + j) % 4] for i, a in enumerate("ab") for j, b in enumerate("cd")}

    def text(n, broken=False):
        out = []
        for _ in range(n):
            a, b = rng.choice("ab"), rng.choice("cd")
            out += [a, rng.choice("pqrs") if broken else follow[a, b], b]
        return " ".join(out)

    d = make([text(200) for _ in range(60)])
    monkeypatch.setattr(pseudo_likelihood, "BATCH", 256)
    words = pseudo_likelihood.learn_words(d, "doc_id", "text")
    net = pseudo_likelihood.train(d.coalesce(1), words, "doc_id", "text")
    probe = make([text(300), text(300, broken=True)])
    good, bad = (r.mean_log_likelihood for r in sorted(pseudo_likelihood.score(probe, words, net).collect()))
    assert good > bad + 0.2
    share = np.exp(words.log_share) * 1.0
    assert math.isclose(share[: len(words.number)].sum() > 0, True)


def test_likelihood_odd_rows(odd, clash):
    got = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(clash(odd)).collect()}
    assert len(got) == odd.count()
    assert got[0].n_words == 0 and got[0].log_likelihood == 0.0 and got[0].mean_log_likelihood is None
    assert got[6].n_words == 3000 and got[6].log_likelihood < 0
    assert pseudo_likelihood.pseudo_likelihood(odd.limit(0)).count() == 0


def test_every_rare_word_has_its_own_probability(make, monkeypatch):
    """Words with one ending differ by count and context; groups grow with them."""
    monkeypatch.setattr(pseudo_likelihood, "VOCABULARY", 6)
    monkeypatch.setattr(pseudo_likelihood, "GROUP", 40)
    rng = random.Random(4)
    head = "a b c d e f".split()
    rare = [f"w{i}ing" for i in range(400)]
    lines = []
    for i, w in enumerate(rare):
        lines += [f"{rng.choice('cd')} {w} {rng.choice('ef')}"] * (1 + i % 5)
    lines += ["a leftking b", "d rightking c"] * 30 + [" ".join(head * 20)] * 20
    rng.shuffle(lines)
    d = make([" ".join(lines[i : i + 20]) for i in range(0, len(lines), 20)] * 4)
    words = pseudo_likelihood.learn_words(d, "doc_id", "text")
    assert words.groups.max() > 5 and words.tail.count() == len(rare) + 2
    net = pseudo_likelihood.train(d.coalesce(1), words, "doc_id", "text")
    probe = make(["c w0ing e", "c w4ing e", "a leftking b", "a rightking b", "c zzzing e"])
    p = [r.log_likelihood for r in sorted(pseudo_likelihood.score(probe, words, net).collect())]
    assert len(set(p)) == 5 and all(x < 0 for x in p)
    assert p[2] > p[3]  # the context decides between words of one count
    assert {words.rare_token(w.encode()) for w in rare} <= {r.token for r in net.trees.collect()}
    digest = {r.digest for r in words.tail.collect()}
    assert set(words.digests(" ".join(rare).encode()).tolist()) <= digest


def test_distinct_words_are_numbered_at_once(make, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "VOCABULARY", 3)
    monkeypatch.setattr(pseudo_likelihood, "GROUP", 2)
    texts = ["the a of the", "", " \t\x0b The  \x1cx y\x85z é É ", "a", "\n", *(f"w{i % 90}ing the a of" for i in range(200))]
    words = pseudo_likelihood.learn_words(make(texts), "doc_id", "text")
    assert words.groups.max() > 5
    data = [t.encode() for t in texts]
    n, around, word, digests = words.read(pa.array(texts), digests=True)
    want = [[words.number.get(w, -1) if w in words.number else words.rare_token(w) for w in t.lower().split()] for t in data]
    assert n.tolist() == [len(t) for t in want] and word.tolist() == sum(want, [])
    assert digests.tolist() == sum((words.digests(t).tolist() for t in data), [])
    edge = [words.edge] * pseudo_likelihood.SIDE
    assert np.stack(around, axis=1).tolist() == [[(edge + t + edge)[i + 2 + o] for o in (-2, -1, 1, 2)] for t in want for i in range(len(t))]
    got = {bytes(r.word): r.n for r in pseudo_likelihood.count_words(make(texts), "doc_id", "text").collect()}
    assert got == Counter(w for t in data for w in t.lower().split())


def test_one_deal_learns_and_scores_the_trees(make, monkeypatch):
    """The contexts are routed once, also those that a task holds in a file."""
    monkeypatch.setattr(pseudo_likelihood, "VOCABULARY", 4)
    monkeypatch.setattr(pseudo_likelihood, "_SPOOL", 200)
    rng = random.Random(6)
    d = make([" ".join(rng.choices(["a", "b", "c", "d"], k=5) + rng.choices([f"w{i}" for i in range(40)], k=5)) for _ in range(60)] + [None]).coalesce(1)
    routed, route = [], pseudo_likelihood.route
    monkeypatch.setattr(pseudo_likelihood, "route", lambda *a: routed.append(a) or route(*a))
    words = pseudo_likelihood.learn_words(d, "doc_id", "text")
    net = pseudo_likelihood.train(d, words, "doc_id", "text")
    apart = {r.doc_id: r for r in pseudo_likelihood.score(d, words, net).collect()}
    assert len(routed) == 2
    once = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(d).collect()}
    assert len(routed) == 3 and len(once) == 61
    for i, r in once.items():
        assert r.n_words == apart[i].n_words and math.isclose(r.log_likelihood, apart[i].log_likelihood, rel_tol=1e-4)


def test_near_match_of_a_window_with_an_absent_term(spark, make):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.match_benchmark(make([item.replace("epsilon", "changed"), "alpha beta"]), table)
    assert [(r.items, r.near_items) for r in sorted(got.collect())] == [([], ["1"]), ([], [])]


def test_repeats_of_hashes_with_common_upper_bits(spark):
    d = spark.createDataFrame([([16, 17, 16],), ([-4, -3, -4, -3, 9],), ([1, 2, 3],), ([],)], "g array<bigint>")
    assert [r[0] for r in d.select(quality.repeat_positions("g")).collect()] == [[0, 2], [0, 1, 2, 3], [], []]


def test_more_languages_than_bits_of_a_mask(spark):
    names = [f"l{i:02}" for i in range(70)]
    own = {n: " ".join("".join(random.Random(f"{n}{j}").choices("abcdefghijklmnopqrstuvwxyz", k=8)) for j in range(30)) for n in names}
    f = language.learn(spark.createDataFrame([(own[n], n) for n in names], "text string, lang string"))
    assert f.languages == names and f.slots.shape == (2, language.SLOTS)
    assert [language.classify(f, own[n])[0] for n in names] == names


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_rows_of_one_item_are_one_item(spark, make, monkeypatch, block):
    passage = " ".join(f"w{i}" for i in range(12))
    table = spark.createDataFrame([("a", passage), ("a", passage), ("b", passage), (None, "only this passage has no name at all today here")], "item_id string, text string")
    d = decontam.match_benchmark
    monkeypatch.setattr(decontam, "match_benchmark", lambda x, y: d(x, y, block_bytes=block))
    got = sorted(decontam.contamination_report(make([passage, "so only this passage has no name at all today here"]), table).collect())
    assert [(r.n_hit, r.n_items, r.contaminated) for r in got] == [(12, 2, True), (10, 0, True)]


def test_a_distrusted_host_changes_verdicts(make):
    """The same borderline text stays on a common host and goes on a bad one."""
    plain = " ".join(f"word{i}" for i in range(60))
    border = plain + " # # # #"  # 6 % of symbols: within the limit, above the strict one
    rows = [("short", "bad")] * 30 + [(plain, "bad")] * 10 + [(border, "bad")]
    for h in range(8):
        rows += [(plain, f"h{h}")] * 40 + [("short", f"h{h}")] * 2 + [(border, f"h{h}")]
    got = sorted(quality.judge(make(rows)).collect())
    told = {(s, r.host_distrusted, r.kept) for r, (t, s) in zip(got, rows) if t == border}
    assert told == {("bad", True, False)} | {(f"h{h}", False, True) for h in range(8)}
    assert all(r.kept for r, (t, _) in zip(got, rows) if t == plain)
