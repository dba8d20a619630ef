"""Personal data by weak supervision.

Patterns propose spans. Four labelers vote on each: the format check, a gazetteer,
the words around and the characters at the ends. Expectation-maximisation over the
counted vote patterns of the whole corpus estimates how reliable every labeler is
for every kind; its posteriors train the final span classifier, a logistic model
over kinds and votes. Base kinds that pass their check are always reported.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.secrets import n_of, span_list
from beatloom.llm.text import keyed, map_batches, schema_of, texts
from beatloom.session import materialise

# Kinds in order of report, the first four by contract.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "spoken_email", "local_phone", "national_id", "iban")
LABELERS = ("format", "gazetteer", "context", "edges")

# The contract's patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# every match of the three above lies in one such run
_RUN = re.compile(r"[+0-9](?:[-+\x20().0-9]*[0-9])?")
# further kinds
_SPOKEN = re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]+(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]+)+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")

# Gazetteers.
_TLDS = frozenset("com org net edu gov info biz io eu de fr es it uk us ca at ch be nl pl pt ru cn jp in br mx au".split())
_DIAL = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91", "351", "353", "358")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "60", "62", "64", "65", "35")
_IBAN_LANDS = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split())
_HINTS = {
    "email": "mail e-mail contact write correo courriel kontakt".split(),
    "ip": "ip address server host adresse dirección".split(),
    "card": "card visa credit mastercard carte tarjeta karte".split(),
    "phone": "phone call tel mobile fax teléfono téléphone telefon".split(),
    "national_id": "ssn social security".split(),
    "iban": "iban account bank konto compte cuenta".split(),
}
_HINTS |= {"spoken_email": _HINTS["email"], "local_phone": _HINTS["phone"]}
_AGAINST = "version isbn order invoice sku total number page section serial".split()
_WORD = re.compile(r"[^\W\d_][\w-]*")
_AROUND = 40  # characters of context on either side


class Span(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool
    votes: int  # base-3 digits, one per labeler: 0 against, 1 none, 2 for


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in s.split("."))
    if kind == "card":
        d = _only_digits(s)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_only_digits(s)) <= 15
    if kind == "national_id":
        return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    if kind == "local_phone":
        d = _only_digits(s)
        return d[0] not in "01" and d[3] not in "01"
    if kind == "iban":
        moved = s[4:] + s[:4]
        return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    return True


def _listed(kind: str, s: str) -> int:
    """Gazetteer: 1 for, -1 against, 0 nothing to say."""
    if kind == "email":
        return 1 if s.rpartition(".")[2].lower() in _TLDS else -1
    if kind == "spoken_email":
        return 1 if re.split(r"[^A-Za-z0-9-]+", s)[-1].lower() in _TLDS else -1
    if kind == "ip":
        p = s.split(".")
        return -1 if p[0] in ("0", "127", "255") or all(len(x) == 1 for x in p) else 1
    if kind == "card":
        return 1 if s.startswith(_ISSUERS) else -1
    if kind == "phone":
        return 1 if s[1:].startswith(_DIAL) else -1
    if kind == "iban":
        return 1 if s[:2] in _IBAN_LANDS else -1
    return 0


def _votes(text: str, kind: str, start: int, end: int, valid: bool) -> int:
    s = text[start:end]
    words = {w.lower() for w in _WORD.findall(text, max(0, start - _AROUND), start)} | {w.lower() for w in _WORD.findall(text, end, end + _AROUND)}
    hint = 1 if not words.isdisjoint(_HINTS[kind]) else -1 if not words.isdisjoint(_AGAINST) else 0
    before, after = text[start - 1 : start], text[end : end + 1]
    edges = -1 if before.isalnum() or after.isalnum() or before in ("#", "=", "/") and before else 1
    code = 0
    for v in (1 if valid else -1, _listed(kind, s), hint, edges):
        code = code * 3 + v + 1
    return code


def candidates(text: str) -> list[Span]:
    """All proposed spans by kind, then start; leftmost and non-overlapping within
    a kind. Base spans are those of base kinds that pass the format check."""
    found: list[tuple[int, int, int, bool]] = []

    def add(kind: str, start: int, end: int) -> None:
        found.append((KINDS.index(kind), start, end, _valid(kind, text[start:end])))

    done, i = 0, text.find("@")
    while i >= 0:
        a = i
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < i and (m := _DOMAIN.match(text, i + 1)):
            add("email", a, m.end())
            done = m.end()
        i = text.find("@", i + 1)
    for r in _RUN.finditer(text):
        a, b = r.span()
        if b - a >= 7:
            for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
                for m in pattern.finditer(text, a, b):
                    add(kind, *m.span())
            for kind, pattern in (("local_phone", _LOCAL_PHONE), ("national_id", _NATIONAL_ID)):
                for m in pattern.finditer(text, max(a - 1, 0), min(b + 1, len(text))):
                    add(kind, *m.span())
        if a >= 2 and "A" <= text[a - 1] <= "Z" and (m := _IBAN.match(text, a - 2)):
            add("iban", *m.span())
    if "dot" in text:
        for m in _SPOKEN.finditer(text):
            add("spoken_email", *m.span())
    # further kinds do not repeat what a base span covers
    base = [(s, e) for k, s, e, ok in found if ok and k < len(BASE_KINDS)]
    found = sorted(f for f in found if f[0] < len(BASE_KINDS) or not any(f[1] < e and s < f[2] for s, e in base))
    return [Span(k, s, e, ok and k < len(BASE_KINDS), _votes(text, KINDS[k], s, e, ok)) for k, s, e, ok in found]


def propose(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans``: kind, start, end (code points), base, votes."""
    d = keyed(docs, key, text)

    def run(batches):
        for batch in batches:
            rows = [[s._asdict() | {"kind": KINDS[s.kind]} for s in candidates(t)] for t in texts(batch)]
            yield {key: batch.column(key), "spans": rows}

    return map_batches(d, run, schema_of(d, key, "spans array<struct<kind:string,start:int,end:int,base:boolean,votes:int>>"))


def _digits(votes: np.ndarray) -> np.ndarray:
    n = len(LABELERS)
    return np.stack([(votes // 3 ** (n - 1 - i)) % 3 for i in range(n)], axis=1)


def reliabilities(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted vote patterns: posterior of each pattern, and per kind and
    labeler the probabilities of the three votes given false and true spans.

    Every estimate starts from, and is smoothed towards, a labeler that is right
    four times out of five; a kind that never occurs keeps that prior.
    """
    v = _digits(votes)
    prior = np.tile(np.array([[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]]), (len(KINDS), len(LABELERS), 1, 1)) * 10.0
    table = prior / prior.sum(axis=-1, keepdims=True)
    share = np.full(len(KINDS), 0.5)
    post = np.full(len(n), 0.5)
    for _ in range(steps):
        like = np.stack([np.log(table[kind[:, None], np.arange(len(LABELERS)), c, v]).sum(axis=1) for c in (0, 1)], axis=1)
        like += np.log(np.stack([1 - share[kind], share[kind]], axis=1))
        post = 1.0 / (1.0 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        counts = prior.copy()
        for c, w in ((0, n * (1 - post)), (1, n * post)):
            for i in range(len(LABELERS)):
                np.add.at(counts, (kind, i, c, v[:, i]), w)
        table = counts / counts.sum(axis=-1, keepdims=True)
        hits, all_ = np.zeros(len(KINDS)), np.zeros(len(KINDS))
        np.add.at(hits, kind, n * post)
        np.add.at(all_, kind, n)
        share = (hits + 1.0) / (all_ + 2.0)
    return post, table


def fit_classifier(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, post: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights of a logistic model over one-hot kinds and votes, weighted by how
    often a pattern stands in the corpus; returns the probability of each of the
    possible (kind, votes) patterns."""
    n_votes = 3 ** len(LABELERS)

    def features(k: np.ndarray, v: np.ndarray) -> np.ndarray:
        d = _digits(v)
        return np.concatenate([np.eye(len(KINDS))[k], *[np.eye(3)[d[:, i]] for i in range(d.shape[1])]], axis=1)

    x, w = features(kind, votes), np.zeros(len(KINDS) + 3 * len(LABELERS))
    weight = n / max(1, n.sum())
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-x @ w))
        w -= 4.0 * (x.T @ (weight * (p - post)) + 1e-4 * w)
    k, v = np.divmod(np.arange(len(KINDS) * n_votes), n_votes)
    return 1.0 / (1.0 + np.exp(-features(k, v) @ w))


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``key`` and ``spans`` (kind, start, end, base) by kind, then start.

    Base spans are complete; of the other proposals those stay to which the
    classifier gives a probability of ``least`` or more. Null and empty texts have
    none; without any proposal nothing is trained. Equal keys stay separate rows.
    """
    d = materialise(propose(docs, key, text))
    # at most kinds x 3^labelers rows
    seen = d.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    accepted = []
    if seen:
        kind, votes, n = (np.array(c) for c in zip(*((KINDS.index(r[0]), r[1], float(r[2])) for r in seen)))
        post, _ = reliabilities(kind, votes, n)
        p = fit_classifier(kind, votes, n, post)
        accepted = [int(c) for c in kind * 3 ** len(LABELERS) + votes if p[c] >= least and KINDS[c // 3 ** len(LABELERS)] not in BASE_KINDS]
    code = lambda s: F.array_position(F.lit(list(KINDS)), s["kind"]).cast("int") * 3 ** len(LABELERS) - 3 ** len(LABELERS) + s["votes"]
    kept = F.filter("spans", lambda s: s["base"] | code(s).isin(accepted))
    return d.select(key, F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("spans"))


def pii_report(docs: DataFrame) -> DataFrame:
    d = find_pii(docs).withColumn("base", F.filter("spans", lambda s: s["base"]))
    return d.select("doc_id", *[n_of("base", k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))
