"""Token counts, sampled segmentations and decoding against the library."""

import math
from collections import Counter

import pytest

from beatloom.llm import segmentation as seg
from beatloom.llm import token_counts as tc
from beatloom.llm.queries import piece_model

TEXTS = [
    "", " ", "  a  b ", "plain words here", "▁▁a ▁", "日本 é🎉\n\tx", "<s> not special </s>", "zz" * 3000, "a b " * 2000, "\x00 x",
]


def test_counts_equal_the_library(make):
    d = make([None, *TEXTS, TEXTS[3]])
    got = {r.doc_id: r for r in tc.count_tokens(d, piece_model(), limit=100).collect()}
    enc = tc.counts_of(piece_model()).encoder
    for i, t in enumerate([None, *TEXTS, TEXTS[3]]):
        n = len(enc.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100), t


def test_forgetting_merges_changes_nothing(monkeypatch):
    monkeypatch.setattr(tc, "KEPT", 0)
    c = tc.PreTokenCounts(piece_model())
    assert c.counts(TEXTS) == [len(c.encoder.encode(t)) for t in TEXTS]


def test_whole_tokens_are_proved_by_the_library():
    c = tc.counts_of(piece_model())
    for s in list(c.whole)[::997]:
        assert len(c.encoder.encode(s)) == 1


def test_empty_table_and_clashing_columns(make, clash):
    d = make(["some text"])
    assert tc.count_tokens(d.limit(0), piece_model()).count() == 0
    assert tc.count_tokens(clash(d), piece_model()).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert seg.sample_segmentations(d.limit(0), piece_model()).count() == 0
    assert seg.sample_segmentations(clash(d), piece_model()).count() == 2


def paths(p, word):
    """All segmentations of one pre-token with their probabilities."""
    lat, out = seg.build_lattice(p, [word]), {}

    def go(s, ids, lp):
        if lat.first[s + 1] == lat.first[s]:
            out[tuple(ids)] = math.exp(lp)
        for e in range(lat.first[s], lat.first[s + 1]):
            go(int(lat.to[e]), [*ids, int(lat.piece[e])], lp + lat.logc[e])

    go(int(lat.start[0]), [], 0.0)
    return out


@pytest.mark.parametrize("word", ["▁then", "▁héé", "▁日x", "▁▁a"])
def test_lattice_is_a_distribution_over_all_segmentations(word):
    p = seg.pieces_of(piece_model(), 1.0)
    o = paths(p, word)
    assert math.isclose(sum(o.values()), 1.0, rel_tol=1e-9)
    assert all(seg.decode_bytes(p, list(ids)).decode() == word.replace("▁", " ", 1).replace("▁", " ")[1:] for ids in o)
    # weights are unigram products
    total = {ids: math.exp(sum(p.logp[i] for i in ids)) for ids in o}
    z = sum(total.values())
    assert all(math.isclose(o[i], total[i] / z, rel_tol=1e-9) for i in o)


def test_samples_are_drawn_without_replacement():
    p = seg.pieces_of(piece_model(), 1.0)
    o, n = paths(p, "▁then"), 3000
    first, second = Counter(), Counter()
    for r in range(n):
        s = seg.sample_block(p, ["then"], [seg.row_seed(r, 1)], 2)[0]
        a, b = (tuple(x.ids.tolist()) for x in s)
        assert a != b and s[0].perturbed > s[1].perturbed
        assert all(math.isclose(math.exp(x.log_prob), o[tuple(x.ids.tolist())], rel_tol=1e-9) for x in s)
        first[a] += 1
        second[b] += 1
    for t in sorted(o, key=o.get)[-3:]:
        again = sum(o[f] * o[t] / (1 - o[f]) for f in o if f != t)
        assert abs(first[t] / n - o[t]) < 0.04
        assert abs(second[t] / n - again) < 0.04


def test_inclusion_weights_are_unbiased():
    """The importance estimate of a sum over all segmentations: E[sum p/q f] = 1."""
    p = seg.pieces_of(piece_model(), 1.0)
    total = 0.0
    for r in range(2000):
        s = seg.sample_block(p, ["thens"], [seg.row_seed(r, 9)], 3)[0]
        total += sum(math.exp(x.log_prob - x.log_inclusion) for x in s)
    assert abs(total / 2000 - 1.0) < 0.05


def test_few_segmentations_give_all_of_them():
    p = seg.pieces_of(piece_model(), 1.0)
    s = seg.sample_block(p, ["a"], [3], 5)[0]
    assert sorted(tuple(x.ids.tolist()) for x in s) == sorted(paths(p, "▁a"))
    assert all(x.log_inclusion == 0.0 for x in s)


def test_round_trip_and_row_key_seeds(make, odd):
    texts = [*TEXTS, *TEXTS]
    d = make(texts)
    s = seg.sample_segmentations(d, piece_model(), k=3)
    got = seg.decode(s, piece_model()).collect()
    assert {r.doc_id for r in got} == set(range(len(texts)))
    for r in got:
        assert r.text == texts[r.doc_id].replace("▁", " ")
    key = lambda r: (r.doc_id, r.sample, tuple(r.ids), r.perturbed)
    again = seg.sample_segmentations(d.repartition(5), piece_model(), k=3).collect()
    assert sorted(map(key, again)) == sorted(key(r) for r in got)
    counts = Counter(r.doc_id for r in got)
    assert all(len({tuple(r.ids) for r in got if r.doc_id == i}) == counts[i] for i in counts)
    for r in seg.decode(seg.sample_segmentations(odd, piece_model()), piece_model()).collect():
        assert r.text is not None


def test_every_sample_is_decoded_and_compared(odd):
    assert all(r.round_trip for r in seg.sample_segmentations(odd, piece_model()).collect())
