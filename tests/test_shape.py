"""Reshaped graphs and the façade's ways to build a landscape, on small graphs."""

import pytest

from peakfield.operators import diffusion as D
from peakfield.operators import matching as M
from peakfield.operators import shape as S
from peakfield.operators.edges import hamming_edges
from peakfield.operators.layers import entropy_modifier
from peakfield.plans.landscape import Landscape


def edges(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, weight double")


def test_trees(spark):
    chain = edges(spark, [(i, i + 1, 1.0) for i in range(10)] + [(5, 20, 2.0), (20, 21, 2.0), (3, 30, 1.0)])
    kept = spark.createDataFrame([(0,), (10,), (21,)], "node long")
    assert {r.node for r in S.leaves(chain).collect()} == {0, 10, 21, 30}
    tree = S.spanning_tree_of(chain, kept)
    assert {(r.u, r.v) for r in tree.collect()} == {(i, i + 1) for i in range(10)} | {(5, 20), (20, 21)}
    short = {(r.u, r.v): r.weight for r in S.suppress_degree_two(tree, kept).collect()}
    assert short == {(0, 5): 5.0, (5, 10): 5.0, (5, 21): 4.0}


def test_louvain(spark):
    clique = lambda lo: [(i, j, 1.0) for i in range(lo, lo + 5) for j in range(i + 1, lo + 5)]
    e = edges(spark, clique(0) + clique(10) + clique(20) + [(4, 10, 1.0), (14, 20, 1.0)])
    nodes = spark.createDataFrame([(i,) for lo in (0, 10, 20) for i in range(lo, lo + 5)] + [(99,)], "node long")
    got = {r.node: r.community for r in S.louvain(nodes, e).collect()}
    assert got == {i: lo for lo in (0, 10, 20) for i in range(lo, lo + 5)} | {99: 99}
    assert M.modularity(S.louvain(nodes, e), e) > 0.5


def test_equal_sequences_meet_as_one(spark):
    rows = [(1, list("AC")), (2, list("AC")), (3, list("AG")), (4, list("TG")), (5, list("AG"))]
    got = {(r.u, r.v) for r in hamming_edges(spark.createDataFrame(rows, "node long, symbols array<string>")).collect()}
    assert got == {(1, 3), (1, 5), (2, 3), (2, 5), (3, 4), (4, 5)}


def test_limit_kernel_has_a_budget(spark):
    nodes, e = spark.createDataFrame([(i,) for i in range(6)], "node long"), edges(spark, [(i, i + 1, 1.0) for i in range(5)])
    assert D.kernel(nodes, e, None).count() == 15
    with pytest.raises(MemoryError):
        D.kernel(nodes, e, None, max_entries=35)


def test_facade(spark):
    pairs = spark.createDataFrame([(2, 1, 3.0), (1, 2, 1.0), (2, 3, 2.0), (3, 3, 9.0)], "u long, v long, w double")
    notes = spark.createDataFrame([(1, "AC", "x", 1.5), (2, "AG", "y", 2.5), (3, "TG", None, 0.5)], "node long, sequence string, kind string, score double")
    made = Landscape.from_graph_annotated(pairs, notes, weight="w")
    assert {(r.u, r.v, r.weight) for r in made.edges.collect()} == {(1, 2, 3.0), (2, 3, 2.0)}
    made.annotation_to_layer("nodes", "score", "score", numeric=True).annotation_to_layer("nodes", "kind", "kind")
    assert made.active == "score" and {r.value for r in made.layer("kind").collect()} == {"x", "y", "__missing__"}
    assert {(r.u, r.v): r.mutations for r in made.mutations().collect()} == {(1, 2): ["C2G"], (2, 3): ["A1T"]}
    assert made.sequence_of(3) == ["T", "G"] and made.communities().annotation("communities").count() == 3
    with pytest.raises(ValueError):
        made.attach_annotation("nodes", notes)
    with pytest.raises(KeyError):
        made.detach_annotation("nodes").annotation("nodes")
    with pytest.raises(ValueError):
        Landscape.from_graph(pairs, notes.where("node < 3").select("node"))
    with pytest.raises(ValueError):
        made.add("outside", spark.createDataFrame([(7, 1.0)], "node long, value double"))
    p = spark.createDataFrame([(i, [0.5, 0.5]) for i in (1, 2, 3)], "node long, value array<double>")
    assert {round(r.value, 4) for r in made.add("p", p).modify(entropy_modifier(2.0), "p").layer("modified").collect()} == {1.0}
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "node long, vector array<double>")
    near = Landscape.build(v.select("node"), graph="diffusion", vectors=v, k=2)
    assert near.edges.count() >= 4 and near.set_domain("vectors").embedding_facts().first().width == 2
    aligned = spark.createDataFrame([("a", list("AC")), ("b", list("AG"))], "name string, symbols array<string>")
    assert Landscape.from_alignment(aligned).edges.count() == 1
