"""Secret scan: all rules in one deterministic automaton, one pass over the bytes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.llm.automaton import Automaton, compile_rules, longest
from beatloom.llm.text import blobs, keyed, map_batches, schema_of


class Rule(NamedTuple):
    """``head``, then a run of ``lead`` or more ``body`` characters.

    Matches whose run is shorter than ``min_body`` are found, consume their text
    and are dropped.
    """

    kind: str
    head: str
    body: str
    min_body: int = 1
    ignore_case: bool = False
    lead: int = 1


# The three contract rules, then widely published key formats.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 8, True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32, lead=32),
)
MORE_RULES = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[0-9A-Za-z_-]", 35),
    Rule("stripe", "(sk|rk)_(live|test)_", "[0-9A-Za-z]", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 10),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY", "-", 5),
)
RULES = BASE_RULES + MORE_RULES


class _Compiled(NamedTuple):
    scan: Automaton
    back: list[Automaton]
    ahead: list[Automaton]
    heads: list[Automaton | None]


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> _Compiled:
    whole = [(f"{r.head}{r.body}{{{r.lead},}}", r.ignore_case) for r in rules]
    # the scan has to see where a match becomes one, not how far it runs
    first = [(f"{r.head}{r.body}{{{r.lead}}}", r.ignore_case) for r in rules]
    return _Compiled(
        compile_rules(first),
        [compile_rules([w], anchored=True, reverse=True) for w in whole],
        [compile_rules([w], anchored=True) for w in whole],
        [compile_rules([(r.head, r.ignore_case)], anchored=True) if r.head else None for r in rules],
    )


def scan(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, rule) in bytes: per rule leftmost, longest, non-overlapping.

    The combined automaton reads every byte once and accepts where a match has
    its shortest form. There the rule's own automata look back for the leftmost
    start and ahead for the end, so they read only bytes of matches.
    """
    c = _compiled(rules)
    table, hot, accepts = c.scan.table, c.scan.hot, c.scan.accepts
    done = [0] * len(rules)
    found: list[tuple[int, int, int]] = []
    n, state = len(data), c.scan.start
    it = iter(data)
    for b in it:
        state = table[state + b]
        if state >= hot:
            end = n - it.__length_hint__()
            for r in accepts[state]:
                if end > done[r] and (start := longest(c.back[r], data, end, done[r], -1)) >= 0:
                    end_r = done[r] = longest(c.ahead[r], data, start, n)
                    head = c.heads[r]
                    body = end_r - (start if head is None else longest(head, data, start, end_r))
                    if body >= rules[r].min_body:
                        found.append((start, end_r, r))
    found.sort(key=lambda m: (m[0], m[2]))
    return found


def _in_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if data.isascii():
        return found
    place, at, points = {}, 0, 0
    for p in sorted({p for s, e, _ in found for p in (s, e)}):
        points += len(data[at:p].decode())
        place[p] = points
        at = p
    return [(place[s], place[e], r) for s, e, r in found]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``key`` and ``spans``: array of (kind, start, end) by start, then rule order.

    Positions are code points, end exclusive. Null and empty texts have no spans;
    repeated keys stay separate rows; every row of the input appears once.
    """
    rules = tuple(rules)
    kinds = [r.kind for r in rules]
    d = keyed(docs, key, text)
    schema = schema_of(d, key, "spans array<struct<kind:string,start:int,end:int>>")

    def run(batches):
        for batch in batches:
            spans = []
            for data in blobs(batch):
                found = scan(data, rules)
                spans.append([(kinds[r], s, e) for s, e, r in _in_code_points(data, found)] if found else [])
            yield {key: batch.column(key), "spans": [[dict(zip(("kind", "start", "end"), x)) for x in s] for s in spans]}

    return map_batches(d, run, schema)


def redact(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with every secret replaced by ``[kind]``; overlapping spans
    become one. Rows, other columns and null texts stay as they are."""
    rules = tuple(rules)

    def clean(data: bytes | None) -> str | None:
        if data is None:
            return None
        out, at = [], 0
        for s, e, r in scan(data, rules):
            if s >= at:
                out += [data[at:s], b"[%s]" % rules[r].kind.encode()]
            at = max(at, e)
        return b"".join([*out, data[at:]]).decode()

    def run(batches):
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            yield cols | {text: [clean(x) for x in blobs(batch, text)]}

    return map_batches(docs, run, docs.schema)


def span_list(spans: Column | str, *kinds: str) -> Column:
    """``kind:start:end`` joined by commas, for the named kinds or all."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def n_of(spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame) -> DataFrame:
    """Digest per document: counts and checksum of the base kinds, all spans."""
    base = [r.kind for r in BASE_RULES]
    d = find_secrets(docs)
    return d.select("doc_id", *[n_of("spans", k).alias(f"n_{k}") for k in base], F.sha2(span_list("spans", *base), 256).alias("base_sha256"), span_list("spans").alias("spans"))
