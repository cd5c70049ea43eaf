"""Language-model scores against plain Python and a trie of dictionaries."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from peakfield.llm import lm
from peakfield.llm.lm import ORDER, OTHER, SYMBOLS, AdaptivePPM, Trie, adaptive_bits, alphabet, byte_counts, score_digest, trie_blocks

from .conftest import frame, prose, rows


def test_trie(spark):
    r = random.Random(5)
    counts = {"".join(r.choice("abcdeXY é") for _ in range(r.randrange(30))): r.randrange(1, 4) for _ in range(300)}
    texts = spark.createDataFrame([(t,) for t, c in counts.items() for _ in range(c)], "text string").repartition(3)
    code = alphabet(byte_counts(texts))
    assert byte_counts(texts) == Counter(b for t, c in counts.items() for b in t.encode().lower() * c)
    trie = Trie(code, [(x.level, x.block, bytes(x.packed)) for x in trie_blocks(texts, code).collect()])
    model = AdaptivePPM(ORDER, SYMBOLS)
    coded = lambda w: [*(int(code[b]) for b in w), 0]
    before = lambda s, i: tuple([0] * ORDER + s[:i])[-ORDER:]
    for w, c in counts.items():
        s = coded(w.encode().lower())
        for i, x in enumerate(s):
            model.learn(before(s, i), x, c)
    some = [*(w.encode().lower() for w in list(counts)[:60]), b"zzz", b"abzab", b"", b"q" * 50, b"a\0b"]
    for w, got in zip(some, trie.log10(some)):
        s = coded(w)
        want = sum(math.log10(model.probabilities(before(s, i))[x]) + (x == OTHER) * trie.other for i, x in enumerate(s))
        assert math.isclose(got, want, rel_tol=0.02), (w, got, want)
    assert np.allclose(trie.three.sum(1), 1, atol=1e-4)


@pytest.mark.parametrize("parts", [1, 5])
def test_contexts_are_never_shared(spark, parts):
    r = random.Random(6)  # far more contexts of four and five than 2**18 rows
    data = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(2000)) for _ in range(400)]
    texts = spark.createDataFrame([(t,) for t in data], "text string").repartition(3)
    code = alphabet(byte_counts(texts))
    trie = Trie(code, [(x.level, x.block, bytes(x.packed)) for x in trie_blocks(texts, code, parts).collect()])
    seen = Counter(d[i : i + 6] for d in data for i in range(len(d) - 5))
    total = Counter(d[i : i + 5] for d in data for i in range(len(d) - 4))
    for c in [data[0][i : i + 6] for i in range(300)]:  # what a context has seen costs its own counts alone
        leaf = 0
        for b in c.encode():
            leaf = leaf << lm.BITS | int(code[b])
        assert math.isclose(trie.probabilities(np.array([leaf]))[0], (seen[c] - 0.5) / total[c[:5]], rel_tol=1e-5)


def test_every_byte_is_modelled(spark):
    r = random.Random(9)
    common = ["".join(map(chr, r.sample(range(33, 123), 80))) + "éüñ" for _ in range(60)]
    rare = "Привет мир как дела "
    texts = spark.createDataFrame([(t,) for t in [*common, rare]], "text string")
    trie = Trie(code := alphabet(byte_counts(texts)), [(x.level, x.block, bytes(x.packed)) for x in trie_blocks(texts, code).collect()])
    data = rare.encode().lower()
    assert len(set(code.tolist())) == 256 and 0 not in code
    known, shuffled = trie.log10([data, bytes(r.sample(data, len(data)))])
    assert known > 0.5 * shuffled and -known / math.log10(2) < 3 * len(data)  # bits a byte


def test_stored_parts_score_as_held_ones(spark, monkeypatch):
    docs = [(i, prose(i, 40)) for i in range(40)]
    want = {r.doc_id: r.score for r in score_digest(frame(spark, docs)).collect()}
    monkeypatch.setattr(lm, "PART_BYTES", 1000)
    got = {r.doc_id: r.score for r in score_digest(frame(spark, docs)).collect()}
    texts = spark.createDataFrame([(t,) for i, t in docs if not lm.is_held_out(i)], "text string")
    trie = Trie(code := alphabet(byte_counts(texts)), [(x.level, x.block, bytes(x.packed)) for x in trie_blocks(texts, code).collect()])
    held = dict(zip(want, trie.log10([dict(docs)[i].encode().lower() for i in want])))
    assert want == pytest.approx(got) and want == pytest.approx(held)


@pytest.mark.parametrize("limit", [lm.TOKEN_TABLE_BYTES, -1])
def test_base(spark, monkeypatch, limit):
    monkeypatch.setattr(lm, "TOKEN_TABLE_BYTES", limit)
    docs = [(i, t.upper() if t and i and i % 2 else t) for i, t in rows()] + [(200 + i, prose(i % 5, 50)) for i in range(20)]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    split = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in docs]
    c = Counter(w for i, ws in split if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in split)
    got = score_digest(frame(spark, docs)).collect()
    assert Counter((*tuple(r)[:5], round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_many_tokens_are_not_shuffled(spark, monkeypatch):
    """Beyond the broadcast, counts come from several files, and no text meets them in a join."""
    docs = [(i, prose(i % 30, 60)) for i in range(200)]
    want = sorted(tuple(r) for r in score_digest(frame(spark, docs)).collect())
    monkeypatch.setattr(lm, "TOKEN_TABLE_BYTES", -1)
    monkeypatch.setattr(lm, "FILE_TOKENS", 20, raising=False)
    got = score_digest(frame(spark, docs))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert sorted(tuple(r) for r in got.collect()) == want


def test_held_out_code_length(spark):
    docs = [(i, prose(i, 120)) for i in range(150)]
    size = {i: len(t.encode()) + 1 for i, t in docs}
    got = [r for r in score_digest(frame(spark, docs)).collect() if r.held_out]
    assert len(got) > 10
    assert all(-r.score / math.log10(2) < 2.2 * size[r.doc_id] for r in got)  # bits a byte


def test_adaptive():
    assert adaptive_bits("") == 0 and adaptive_bits("a") == 8
    assert adaptive_bits("abcd" * 50) < 0.2 * adaptive_bits(prose(3, 40)[:200])


def test_empty(empty):
    assert score_digest(empty).count() == 0
