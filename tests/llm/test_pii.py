"""PII spans against plain Python, and what contexts discover."""

import hashlib
import re

from peakfield.llm.pii import pii_digest

from .conftest import frame, prose, rows


def luhn(ds):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(ds)))) % 10 == 0


def count(s):
    return len(re.sub("[^0-9]", "", s))


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= count(s) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= count(s) <= 15),
)
TEXTS = [
    "a@b.c%d@e.f_x@y.z é\U0001f600 me.you+tag@do-main.co.uk, x@y",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 .1.2.3.4. 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 12 34  56 378282246310005 6011000990139424 5",
    "+1 (555) 123-4567 +44 20 7946 0958. +12345 ++1 555 123 4567 8 +1 555 123 4567 8901 2",
    "+1-555-123-4567+1-555-123-4567 call 4111 1111 1111 1111+1 5551234567 ",
    "ſKİ" * 5 + "x@y.zz 10.0.0.1",
    "\ufdd0 x@y.zz\ufdd0 10.0.0.1 \ufdd0",
]


def plain(t):
    out = [(m.start(), n, m.end(), kind) for n, (kind, p, ok) in enumerate(KINDS) for m in re.finditer(p, t or "") if ok(m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_forms(spark):
    short = rows()
    cases = [*short, *enumerate(TEXTS, 1000), (1100, " ".join(TEXTS)), (1101, "7" * 20000), (1102, "1.2.3.4 " * 300)]
    want = []
    for i, t in cases:
        p = plain(t)
        want.append((i, *(sum(x.startswith(k + ":") for x in p) for k, _, _ in KINDS), hashlib.sha256(",".join(p).encode()).hexdigest()))
    got = pii_digest(frame(spark, cases)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(key(tuple(r)[:6]) for r in got) == sorted(map(key, want))


def test_contexts(spark):
    known = [(i, prose(i, 20) + f" reach me at +1 555 010 {1000 + i} " + prose(i + 1, 9)) for i in range(12)]
    known += [(20 + i, prose(i, 20) + f" reach me at user{i}@mail.org then " + prose(i + 1, 9)) for i in range(12)]
    new = (50, "please reach me at 555-01-2345, thanks")
    clean = [(60 + i, prose(i, 20) + f" in the year {1900 + i} and " + prose(i, 9)) for i in range(8)]
    common = [(100 + i, f"{prose(i, 9)} of the the the of +1 555 010 {2000 + i} " + prose(i, 9)) for i in range(12)] + [(130, "a number of 7086638319846192 here")]
    got = {r.doc_id: r.spans for r in pii_digest(frame(spark, [*known, new, *clean, *common])).collect()}
    assert got[130] == ""
    assert got[50] == "context:19:31"
    assert all(got[60 + i] == "" for i in range(8))


def test_contexts_of_discovered_identifiers(spark):
    known = [(i, prose(i, 20) + f" write to me via user{i}@mail.org then " + prose(i + 1, 9)) for i in range(40)]
    first = [(100 + i, prose(i, 20) + f" write to me via EMP-{10000 + i} then " + prose(i + 1, 9)) for i in range(8)]
    second = [(200 + i, prose(i, 20) + f" employee badge EMP-{10000 + i} then " + prose(i + 1, 9)) for i in range(8)]
    common = [(300 + i, prose(i, 20) + f" about EMP-{10000 + i} then " + prose(i + 1, 9)) for i in range(8)] + [(320 + i, "about nothing then") for i in range(20)]
    docs = [*known, *first, *second, *common, (400, "an employee badge EMP-77777 here"), (401, "about EMP-88888 here")]
    got = {r.doc_id: r.spans for r in pii_digest(frame(spark, docs)).collect()}
    assert all(got[i].startswith("context:") for i, _ in [*first, *second])
    assert got[400] == "context:18:27" and got[401] == ""


def test_empty(empty):
    assert pii_digest(empty).count() == 0
