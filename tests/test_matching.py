"""Comparisons of graphs and labelings on small known cases and by brute force."""

from itertools import permutations

import numpy as np
import pytest

from peakfield.operators import matching as M
from tests.test_operators import graph


def test_cluster_scores(spark):
    same = M.cluster_scores(spark.createDataFrame([(1, 5), (1, 5), (2, 6), (2, 6)], "a int, b int")).first()
    assert same.ari == pytest.approx(1) and same.nmi == pytest.approx(1) and same.mi == pytest.approx(np.log(2))
    cross = M.cluster_scores(spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6)], "a int, b int")).first()
    assert cross.ari == pytest.approx(-0.5) and cross.mi == pytest.approx(0)


def test_ranking_scores(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)]
    wins = [1.0 if p > n else 0.5 if p == n else 0.0 for p, a in rows if a for n, b in rows if not b]
    got = M.ranking_scores(spark.createDataFrame(rows, "score double, label int")).first()
    assert got.roc_auc == pytest.approx(np.mean(wins)) and got.average_precision == pytest.approx(0.5 + 0.5 * 2 / 4)
    assert M.spearman(spark.createDataFrame([(1, 9), (2, 7), (3, 7)], "x int, y int"), "x", "y") == pytest.approx(-0.8660254)


def test_communities(spark):
    clique = lambda o: [(o + i, o + j, 1) for i in range(5) for j in range(i + 1, 5)]
    nodes, edges = graph(spark, [0] * 10, [*clique(0), *clique(5), (0, 5, 0.1)])
    found = M.communities(nodes, edges)
    labels = {r.node: r.community for r in found.collect()}
    assert len({labels[i] for i in range(5)}) == 1 and len({labels[i] for i in range(5, 10)}) == 1 and labels[0] != labels[9]
    assert M.modularity(found, edges) > 0.4


def test_dense():
    r = np.random.default_rng(3)
    c = r.random((4, 5)).round(2)
    best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))
    assert sum(c[i, j] for i, j in M.assignment(c)) == pytest.approx(best) == pytest.approx(sum(c.T[i, j] for i, j in M.assignment(c.T)))
    square = c[:, :4]
    best = min(sum(square[i, p[i]] for i in range(4)) for p in permutations(range(4))) / 4
    assert M.transport(square, np.full(4, 0.25), np.full(4, 0.25)) == pytest.approx(best)
    x = r.normal(size=(12, 2))
    d = np.linalg.norm(x[:, None] - x, axis=2)
    y = M.landmark_mds(d, 2)
    assert np.allclose(np.linalg.norm(y[:, None] - y, axis=2), d, atol=1e-6)
    i, j = np.triu_indices(12, 1)
    z = M.smacof(np.c_[i, j], d[i, j], np.ones(len(i)), y + r.normal(size=y.shape) * 0.01, 500, 1e-12)
    assert np.allclose(np.linalg.norm(z[:, None] - z, axis=2), d, atol=1e-3)
    w = (d < 1).astype(float) - np.eye(12)
    s = M.isorank(w, w, np.c_[x, np.eye(12)], np.c_[x, np.eye(12)], alpha=0.1)
    assert s.shape == (12, 12) and (s.argmax(1) == np.arange(12)).mean() > 0.5
    merges = M.average_linkage(np.array([[0, 1, 4], [1, 0, 6], [4, 6, 0]], float))
    assert merges == [(0, 1, 1.0, 2), (2, 3, 5.0, 3)] or merges == [(0, 1, 1.0, 2), (3, 2, 5.0, 3)]
    hard = np.eye(4)[[0, 1, 3]]
    assert M.gapped_soft_score(hard, np.eye(4)[[0, 2, 2]], np.eye(3)) == pytest.approx(1 + 0 - 2)
