import hashlib
import random
import re

from beatloom.llm import automaton, pii, secrets

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BRUTE = [(ASSIGN, lambda m: len(m[1]) >= 8), (re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), (re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
BITS = [b"password", b"token", b"secret", b"api_key", b"apikey", b"PASSWD", b"=", b":", b" ", b'"', b"'", b"AKIA", b"ABCDEFGHIJKL", b"0123456789abcdef", b"x", b"\n", b"abc", b"==", b"-", b"\xc3\xa9"]


def brute(data):
    return sorted((m.start(), i, m.end()) for i, (rx, ok) in enumerate(BRUTE) for m in rx.finditer(data) if ok(m))


def test_automaton_equals_backtracking_search():
    rng = random.Random(1)
    for _ in range(4000):
        x = b"".join(rng.choices(BITS, k=rng.randint(1, 14)))
        assert brute(x) == [(s, r, e) for s, e, r in secrets.scan(x) if r < 3], x


def test_minimal_automaton():
    a = automaton.compile_rules([("ab|cb", False)], anchored=True)
    assert len(a.table) // 256 == 4  # start, middle, end, dead
    assert automaton.longest(a, b"xab", 1, 3) == 3 and automaton.longest(a, b"ax", 0, 2) == -1


def test_more_rules_and_code_points(make):
    t = "é ghp_" + "a1B2" * 9 + " é -----BEGIN RSA PRIVATE KEY----- AKIA" + "Z" * 12
    r = secrets.find_secrets(make([t])).first()
    assert [(s.kind, t[s.start : s.end][:5]) for s in r.spans] == [("github", "ghp_a"), ("private_key", "-----"), ("access", "AKIAZ")]


def test_report_redaction_and_odd_rows(make, odd, clash):
    texts = ["password = hunter2hunter2 é token:abc", None, "", "a" * 40, "a" * 40]
    got = {r.doc_id: r for r in secrets.secret_report(clash(make(texts))).collect()}
    assert [got[i].n_assign for i in range(5)] == [1, 0, 0, 0, 0] and got[3].n_hex == got[4].n_hex == 1
    assert got[3].base_sha256 == hashlib.sha256(b"hex:0:40").hexdigest() and got[1].spans == ""
    out = {r.doc_id: r.text for r in secrets.redact(clash(make(texts))).collect()}
    assert out[0] == "[assign] é token:abc" and out[1] is None and out[3] == "[hex]"
    assert secrets.secret_report(odd).count() == odd.count() and secrets.find_secrets(odd.limit(0)).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
KINDS = (("email", EMAIL), ("ip", pii._IP), ("card", pii._CARD), ("phone", pii._PHONE))
PARTS = ["a@b.c", "@", "x.y", ".", "1", "25", "256", "+", "+1 ", " (", "555", ")", "-", "4111111111111111", " ", "\n", "4111 1111 1111 1111", "1.2.3.4", "é", "9", "ab"]


def test_base_kinds_equal_backtracking_search():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choices(PARTS, k=rng.randint(1, 10)))
        want = [(k, m.start(), m.end()) for k, rx in KINDS for m in rx.finditer(t) if pii._valid(k, m[0])]
        assert want == [(pii.KINDS[s.kind], s.start, s.end) for s in pii.candidates(t) if s.base], t


def test_em_finds_the_reliable_labelers():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    right = [0.95, 0.9, 0.55, 0.8]
    code = np.zeros(4000, dtype=int)
    for q in right:
        vote = np.where(rng.random(4000) < q, truth, ~truth)
        code = code * 3 + np.where(vote, 2, 0)
    u, n = np.unique(code, return_counts=True)
    post, table = pii.reliabilities(np.zeros(len(u), dtype=int), u, n.astype(float))
    agree = ((post > 0.5)[np.searchsorted(u, code)] == truth).mean()
    assert agree > 0.93
    learned = [table[0, i, 1, 2] for i in range(4)]
    assert learned[0] > learned[3] > learned[2]
    p = pii.fit_classifier(np.zeros(len(u), dtype=int), u, n.astype(float), post)
    assert ((p[u] > 0.5) == (post > 0.5)).mean() > 0.8


def test_pii_report(make, odd, clash):
    texts = ["call phone (212) 555-0199 now", "mail bob [at] example [dot] com", "x@y.com; 1.2.3.4; 4111111111111111; +1 212 555 0199", None, "é x@y.com"]
    got = {r.doc_id: r for r in pii.pii_report(clash(make(texts))).collect()}
    assert [got[2][f"n_{k}"] for k in pii.BASE_KINDS] == [1, 1, 1, 1]
    assert got[2].base_sha256 == hashlib.sha256(b"email:0:7,ip:9:16,card:18:34,phone:36:51").hexdigest()
    assert "local_phone:11:25" in got[0].spans and got[1].spans.startswith("spoken_email:5:")
    assert got[3].spans == "" and got[4].spans == "email:2:9"
    assert pii.pii_report(odd).count() == odd.count() and pii.pii_report(odd.limit(0)).count() == 0


def test_parts_of_thousands_of_digits(make):
    """No number is read before it is known to be short."""
    texts = ["0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 5000, "9" * 5000 + ".1.1.1", "4" * 5000]
    got = sorted(pii.pii_report(make(texts)).collect())
    assert [r.n_ip for r in got] == [1, 1, 0, 0] and [r.n_card for r in got] == [0] * 4
