"""Near-duplicate groups against all pairs in plain Python."""

import random
import sys
from collections import Counter

import numpy as np
import pytest

from peakfield.llm import near_dedup as N
from peakfield.llm.near_dedup import band_rows, components, near_components, near_dedup, superminhash

from .conftest import frame, prose, rows


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k, percent):
    sets = [shingles(t, k) for _, t in docs]
    group = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and group[i] != group[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, _), g in zip(docs, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return Counter((i, len(s), least.get(g)) if s else (i, 0, i) for (i, _), s, g in zip(docs, sets, group))


def families():
    r, out, n = random.Random(3), [], 1000
    for f in range(12):
        base = prose(f, 60 + 20 * f).split()
        for c in range(14):
            w = list(base)
            for _ in range(r.randrange(0, 9)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], ["new" + str(r.random())], [w[at], "x"]])
            out.append((n, " ".join(w)))
            n += 1
    chain = prose(99, 100).split()
    for c in range(12):  # each like the next, the ends unlike
        out.append((n + 20 - c, " ".join([*chain[4 * c :], *(f"y{i}" for i in range(4 * c))])))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_groups(spark, k, percent):
    docs = [*rows(), *families()]
    got = near_components(frame(spark, docs), k=k, threshold=percent / 100).collect()
    assert Counter(tuple(x)[:3] for x in got) == brute(docs, k, percent)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got if x.doc_id is not None)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    docs = families()[:60]
    got = near_components(frame(spark, docs), k=3, threshold=0.85).collect()
    assert Counter(tuple(x)[:3] for x in got) == brute(docs, 3, 85)


def test_few_files(spark, monkeypatch):
    """What is left of many partitions of sets and links is written to few files."""
    cut, files = N.cut, {}

    def counted(df):
        out = cut(df)
        files.setdefault(sys._getframe(1).f_code.co_name, []).append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(N, "cut", counted)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 2)], "a long, b long").repartition(12)
    assert components(pairs).count() >= 100 and max(files["components"]) <= 2
    docs = families()[:60]
    got = near_components(frame(spark, docs).repartition(12), k=3, threshold=0.85).collect()
    assert Counter(tuple(x)[:3] for x in got) == brute(docs, 3, 85) and max(files["confirmed"]) <= 2


def test_near_dedup_keeps_columns(spark):
    docs = frame(spark, [*families()[:28], (1, "alone " * 3)])
    out = near_dedup(docs, k=3, threshold=0.85)
    want = {i for i, _, c in brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85) if i == c}
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want


def test_near_dedup_tells_rows_by_id_and_text(spark):
    a, b, c, d, e = (prose(700 + i, 90) for i in range(5))
    docs = [(1, a), (None, a + " more"), (None, b), (None, None), (None, ""), (None, c), (None, c + " more"), (2, d), (2, a + " tail"), (None, e), (None, e), (3, b + " x"), (3, prose(710, 40))]
    got = Counter((r.doc_id, r.text) for r in near_dedup(frame(spark, docs).repartition(3), k=5, threshold=0.8).collect())
    assert got.pop((None, c), 0) + got.pop((None, c + " more"), 0) == 1
    assert got == Counter([(1, a), (None, None), (None, ""), (2, d), (None, e), (3, b + " x"), (3, prose(710, 40))])


def test_signature():
    r = np.random.default_rng(1)
    x = np.sort(r.integers(0, 1 << 63, 900).astype(np.uint64))
    a, b = superminhash([x[:800], x[100:]])
    assert abs((a == b).mean() - 700 / 900) < 0.12
    parts = superminhash([x[:300], x[300:800]])
    assert (np.minimum(*parts) == a).all()
    assert len(set(superminhash([x[:1]])[0].tolist())) == N.SLOTS
    assert band_rows(0.85) == 6 and band_rows(0.8) == 5
    one, many = N.ELEMENTS, superminhash([np.sort(r.integers(0, 1 << 63, 3 * N.ELEMENTS).astype(np.uint64))])
    assert one and (many != N.EMPTY).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(300) if i % 50] + [(1000, 1000 + i) for i in range(1, 200)] + [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root if find(x) != x} | {x: x for x in got if find(x) == x}


def test_empty(empty):
    assert near_components(empty).count() == near_dedup(empty).count() == 0
