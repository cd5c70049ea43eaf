"""Trigram queries and secret scans against plain Python."""

import hashlib
import re
from itertools import product

import pytest

from peakfield.llm import secrets as S
from peakfield.llm.secrets import SECRETS, redact_secrets, secrets_digest
from peakfield.llm.trigrams import query

from .conftest import frame, prose, rows

BASE = (
    ("assign", re.compile(S.ASSIGN[4:], re.A | re.I), lambda m: len(m[1]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)
MORE = ["ghp_" + "a1B2" * 10, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-123456789012-abc", "AIza" + "x_Y" * 12, "sk_live_abcdefghij12", "Bearer " + "t0ken." * 5, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh12"]


def cases():
    texts = ['Password: "hunter22" x', "token:token:abcdefgh", "API_KEY==abcdef apikey = 'zzz' secret=ab.cd/ef+", "é\U0001f600 AKIA" + "B7" * 8 + " AKIAABC", "deadbeef" * 3 + " " + "deadbeef" * 2, "paſsword=longenough PASSWD=K123456", "AKIAAKIA" + "Z" * 30, "token=abcdef," * 200, "\ufdd0 token=\ufdd0 secret=abcdef\ufdd0"]
    made = ["".join(p) for p in product(("token", "Secret", "passwd"), ("", '"'), ("", "  "), (":", "="), ("", " '"), ("abc", "abc-def_/", "AKIA" + "Q" * 16))]
    return [*rows(), *enumerate([*texts, *MORE, " \n".join(made), *(prose(i, 20) + " " + m for i, m in enumerate(made))], 1000)]


def plain(t):
    out = []
    for n, (kind, p, ok) in enumerate(BASE):
        out += [(m.start(), n, m.end(), kind) for m in p.finditer(t or "") if ok(m)]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


@pytest.mark.parametrize("limit", [S.BROADCAST_BYTES, 0])
def test_secrets(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BROADCAST_BYTES", limit)
    got = secrets_digest(frame(spark, cases())).collect()
    want = []
    for i, t in cases():
        p = plain(t)
        want.append((i, *(sum(x.startswith(k) for x in p) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(p).encode()).hexdigest()))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(key(tuple(r)[:5]) for r in got) == sorted(map(key, want))
    spans = {r.doc_id: r.spans for r in got}
    at = {t: i for i, t in cases()}
    for m, kind in zip(MORE, ("git_token", "private_key", "chat_token", "cloud_key", "pay_key", "bearer", "web_token")):
        assert f"{kind}:0:{len(m)}" in spans[at[m]]
    assert all(set(plain(t)) <= set((spans[i] or "").split(",")) for i, t in cases() if i is not None)


def test_queries():
    q = query(S.ASSIGN)
    assert frozenset({"tok", "oke", "ken"}) in q and frozenset({"api", "pik", "ike", "key"}) in q and frozenset({"api", "pi_", "i_k", "_ke", "key"}) in q
    assert query("[0-9a-f]{24,}") is None and query("a?b*cd") is None
    assert query("abc(def|xyz)+q") == frozenset({frozenset({"abc", "def"}), frozenset({"abc", "xyz"})})
    for r in SECRETS:
        clauses = query(r.pattern)
        for m in [*MORE, 'passwd = "abcdef"', "AKIA" + "1" * 16]:
            if clauses and re.search(r.pattern, m):
                assert any(all(g in m.lower() for g in c) for c in clauses), (r.kind, m)


def test_redaction(spark):
    docs = frame(spark, [(1, "é token=abcdefgh rest"), (2, "clean"), (3, None), (4, "AKIA" + "A" * 16)])
    out = redact_secrets(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("é [SECRET] rest", 15), 2: ("clean", 5), 3: (None, 0), 4: ("[SECRET]", 8)}


def test_empty(empty):
    assert secrets_digest(empty).count() == redact_secrets(empty).count() == 0
