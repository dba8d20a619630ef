"""Conversation repair against a search over all edits and a grammar automaton."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import groupby

import pytest

from beatloom.llm import dialogue

GRAMMAR = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\v\f\r")
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(turns, bad):
    """Best-first search over (turn, state); letters of the audit break ties."""
    step = {("B", "s"): "S", ("B", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    queue, closed = [(0, "", 0, "B", ())], set()
    while queue:
        cost, audit, i, state, rows = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(turns) and state in "BA":
            return cost, audit, rows
        for c, name in (("u", "user"), ("a", "assistant")):
            if (state, c) in step:
                heapq.heappush(queue, (cost + 2, audit + "I", i, step[state, c], (*rows, (name, ""))))
        if i < len(turns):
            _, role, text = turns[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, rows))
            if bad[i] in (0, 3):
                extra = bad[i] == 3
                if (state, role[:1]) in step:
                    heapq.heappush(queue, (cost + extra, audit + "K", i + 1, step[state, role[:1]], (*rows, (role, text))))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (state, c) in step:
                        heapq.heappush(queue, (cost + extra + 2, audit + "R", i + 1, step[state, c], (*rows, (name, text))))


def expected(rows):
    out = []
    for conv, turns in damaged(rows).items():
        bad = faults(turns)
        cost, audit, kept = cheapest(turns, bad)
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in kept))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, bad.count(1), bad.count(2), bad.count(3), illegal, cost, audit, sha, len(turns)))
    return sorted(out, key=str)


def exhaustive(turns, bad):
    """Every edit string with at most two insertions in a row."""
    best = None

    def go(i, cost, audit, initials, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(turns) and GRAMMAR.fullmatch(initials):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for c in "ua":
                go(i, cost + 2, audit + "I", initials + c, inserted + 1)
        if i < len(turns):
            go(i + 1, cost + 3, audit + "D", initials, 0)
            if bad[i] in (0, 3):
                go(i + 1, cost + (bad[i] == 3), audit + "K", initials + turns[i][1][:1], 0)
                for c in "ua":
                    go(i + 1, cost + 2 + (bad[i] == 3), audit + "R", initials + c, 0)

    go(0, 0, "", "", 0)
    return best


ROLES = ["user", "assistant", "system", "tool", "User", "u"]
TEXTS = ["Hi.", "Yes!", "no", "", " ", "\t", "Why? ", "é.", "x" * 3000 + ".", None]


def random_rows(rng, conv, n):
    turns = [rng.choice([i, i, i, i + 1, None]) for i in range(n)]
    return [(conv, t, rng.choice(ROLES[:3] if rng.random() < 0.9 else [*ROLES, None]), rng.choice(TEXTS)) for t in turns]


@pytest.mark.parametrize("seed", range(30))
def test_alignment_equals_search_over_all_edits(seed):
    rng = random.Random(seed)
    turns = [(i, rng.choice(["user", "assistant", "system", "tool"]), "x") for i in range(rng.randint(0, 5))]
    bad = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in turns]
    c = dialogue.Conversation()
    for (t, r, x), f in zip(turns, bad):
        c.add(t, r, x, f)
    cost, audit = exhaustive(turns, bad)
    assert c.report()[6:8] == (cost, audit) == cheapest(turns, bad)[:2]


@pytest.mark.parametrize("block", [1, 2, 3, 7])
def test_blocks_change_nothing(monkeypatch, block):
    rng = random.Random(block)
    for _ in range(60):
        turns = [(i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice("xyz")) for i in range(rng.randint(0, 25))]
        bad = [rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in turns]
        out = []
        for size in (block, 1000):
            monkeypatch.setattr(dialogue, "BLOCK_TURNS", size)
            c = dialogue.Conversation()
            for (t, r, x), f in zip(turns, bad):
                c.add(t, r, x, f)
            out.append(c.report())
        assert out[0] == out[1]
        assert out[0][6:8] == cheapest(turns, bad)[:2]


S = "conv_id long, turn long, role string, text string"


def report(spark, rows, clash=False):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, S)
    if clash:
        d = d.withColumns({c: F.lit("x") for c in ("_conv", "_kind", "present", "audit", "cost", "_copy", "place")})
    return sorted(map(tuple, dialogue.repair_report(d).collect()), key=str)


def test_report_equals_search(spark):
    rng = random.Random(3)
    rows = [r for conv in range(150) for r in random_rows(rng, conv, rng.randint(1, 9))]
    rows += random_rows(rng, None, 7) + random_rows(rng, -5, 200)
    rows += rows[:20]  # repeated rows
    rng.shuffle(rows)
    assert report(spark, rows) == report(spark, rows, clash=True) == expected(rows)


def test_odd_tables(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert report(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing, 0)]
    assert report(spark, []) == []
    rows = [(None, None, None, None)] * 3
    assert report(spark, rows) == expected(rows)


def test_repaired_turns_have_the_digest(spark):
    rng = random.Random(11)
    rows = [r for conv in [*range(60), None] for r in random_rows(rng, conv, rng.randint(1, 12))]
    d = dialogue.damage(spark.createDataFrame(rows, S))
    rep = dialogue.repair(d, present="present")
    kept = dialogue.repaired_turns(d, rep, present="present").filter("place IS NOT NULL").collect()
    kept.sort(key=lambda r: (str(r.conv_id), r.place))
    text = {k: "\n".join(f"{r.role}:{r.text}" for r in g) for k, g in groupby(kept, lambda r: r.conv_id)}
    for r in rep.collect():
        assert hashlib.sha256(text.get(r.conv_id, "").encode()).hexdigest() == r.repaired_sha256


def test_given_conversations(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = sorted(map(tuple, dialogue.repair_report(d).collect()), key=str)
    assert got == expected(list(map(tuple, d.collect())))
