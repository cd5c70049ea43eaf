"""Quality rules, exact deduplication, packing and BPE against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from peakfield.llm import exact_dedup as exact
from peakfield.llm.bpe import bpe_decode, bpe_digest, bpe_encode
from peakfield.llm.exact_dedup import exact_dedup, exact_dedup_digest
from peakfield.llm.packing import Packer, pack, step_groups
from peakfield.llm.quality import RULES, measured_order, quality_digest, quality_rules

from .conftest import frame, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return tuple((x is None, x) for x in row)


def test_quality_counts(corpus):
    def plain(t):
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n, inside = Counter(grams), set()
        for i, g in enumerate(grams):
            if n[g] > 1:
                inside.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)

    got = quality_digest(corpus).collect()
    assert sorted((key((r.doc_id, *r[1:7])) for r in got)) == sorted(key((i, *plain(t))) for i, t in rows())
    assert not any(r.kept for r in got if r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(1, 20)) <= kept | {0} and 41 not in kept


def test_quality_rules_reject_junk(spark):
    good = " ".join(f"word{i}s and more" for i in range(40))
    junk = [" ".join(f"ab{i}{'*' * 3}" for i in range(60)), " ".join(f"A{'B' * (i % 7)}C{i}!!" for i in range(60)), "\n".join(["same line here"] * 4 + [f"line {i}" for i in range(3)]), " ".join(str(i * 7919) for i in range(60))]
    docs = frame(spark, [(0, good), *enumerate(junk, 1)])
    out = quality_rules(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [0]
    assert {r.name for r in measured_order(docs)} == {r.name for r in RULES}


@pytest.mark.parametrize("limit", [exact.BROADCAST_BYTES, 0])
def test_exact_dedup(corpus, monkeypatch, limit):
    monkeypatch.setattr(exact, "BROADCAST_BYTES", limit)
    same = defaultdict(list)
    for i, t in rows():
        same[t or ""].append(i)
    want = []
    for t, ids in same.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            want.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    got = exact_dedup_digest(corpus).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    out = exact_dedup(corpus)
    assert out.columns == corpus.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted(same)


def test_bpe(corpus):
    tk = Tokenizer.from_file(PATH)
    want = {}
    for i, t in rows():
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.setdefault((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()), []).append(i)
    got = bpe_digest(corpus, PATH).collect()
    assert len(got) == len(rows()) and {tuple(r) for r in got} == set(want)
    back = bpe_decode(bpe_encode(corpus, PATH), PATH).collect()
    assert sorted(key((r.doc_id, r.text)) for r in back) == sorted(key((i, t or "")) for i, t in rows())


def test_packing(corpus):
    tk = Tokenizer.from_file(PATH)
    want = Counter((i, tuple([*tk.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows())
    got = pack(corpus, PATH, with_ids=True).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32
        sequences[r.sequence_id].append(r)
        docs[r.doc_id, r.doc_tokens].append(r)
    padded = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded == 0
    for (i, n), rs in docs.items():
        same = [k for k in want if k[0] == i and len(k[1]) == n]
        assert sum(r.length for r in rs) == n * sum(want[k] for k in same)
        if len(same) == 1 and want[same[0]] == 1:
            assert tuple(x for r in sorted(rs, key=lambda r: r.start) for x in r.ids) == same[0][1]
    assert sum(len(k[1]) * n for k, n in want.items()) == sum(r.length for r in got)


def test_packer_cuts_only_what_it_must():
    p = Packer(16)
    assert [s for n, size in enumerate((40, 9, 3, 4)) for s in p.add(n, size)] == [[(0, 0, 16)], [(0, 16, 16)]]
    assert list(p.windows()) == [[(1, 0, 9), (3, 0, 4), (2, 0, 3)]]
    assert list(p.rest()) == [[(0, 32, 8)]]
    costs = [9, 1, 8, 2, 7, 3, 6, 4]
    groups = step_groups(costs, 4)
    assert sum(c for c, g in zip(costs, groups) if g == 0) == 20


def test_empty(empty):
    assert quality_digest(empty).count() == exact_dedup_digest(empty).count() == bpe_digest(empty, PATH).count() == pack(empty, PATH).count() == 0
    assert exact_dedup(empty).count() == quality_rules(empty).count() == 0
