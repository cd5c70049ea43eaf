"""Known answers on small graphs, contracts that raise, and round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfield.functions import layers as LF
from peakfield.functions import sequences as SF
from peakfield.operators import diffusion as D
from peakfield.operators import edges as E
from peakfield.operators import epistasis as P
from peakfield.operators import generators as N
from peakfield.operators import graph as G
from peakfield.operators import layers as A
from peakfield.operators import phylo
from peakfield.operators import spectral as S
from peakfield.operators import stats as T
from peakfield.operators import walks as W
from peakfield.plans.landscape import Landscape
from peakfield.sources import files as IO


def graph(spark, values, edges):
    nodes = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "node long, value double")
    return nodes, spark.createDataFrame([(u, v, float(w)) for u, v, w in edges], "u long, v long, weight double")


def path4(spark):
    return graph(spark, [0, 1, 2, 4], [(0, 1, 1), (1, 2, 1), (2, 3, 1)])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_optima_keep_plateaus_and_isolated_nodes(spark):
    nodes, edges = graph(spark, [1, 1, 0, 5], [(0, 1, 1), (1, 2, 1)])
    assert {r.node for r in G.local_optima(nodes, edges).collect()} == {0, 1, 3}


def test_energies(spark):
    nodes, edges = path4(spark)
    total = G.dirichlet(nodes, edges).first()
    assert (total.global_dirichlet_energy, total.total_dirichlet_energy) == (6.0, 1.5)
    assert {r.node: r.energy for r in G.dirichlet_local(nodes, edges).collect()} == {0: 0.5, 1: 1.0, 2: 2.5, 3: 2.0}


def test_resistance_and_components(spark):
    nodes, edges = graph(spark, [0] * 5, [(0, 1, 1), (1, 2, 0.5), (3, 4, 0)])
    got = {(r.u, r.v): round(r.resistance, 9) for r in S.resistance(nodes.select("node"), edges).collect()}
    assert got == {(0, 1): 1.0, (1, 2): 2.0, (0, 2): 3.0}
    assert {r.node: r.component for r in G.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_kernel_of_three_states(spark):
    nodes, edges = graph(spark, [0] * 3, [(0, 1, 1), (1, 2, 1)])
    limit = {(r.u, r.v): r.weight for r in D.kernel(nodes, edges, None).collect()}
    assert limit[0, 1] == pytest.approx(np.sqrt(1 / 8)) and limit[0, 2] == pytest.approx(0.25)
    one_ = {(r.u, r.v): r.weight for r in D.kernel(nodes, edges, 1).collect()}
    assert one_ == {(0, 1): pytest.approx(0.5 / np.sqrt(2)), (1, 2): pytest.approx(0.5 / np.sqrt(2))}
    with pytest.raises(MemoryError):
        D.power(D.lazy_transition(nodes, edges)[0], 3, max_products=1)
    with pytest.raises(ValueError, match="whole"):
        D.kernel(nodes, edges, 1.5)


def test_autocorrelation_of_a_path(spark):
    nodes, edges = path4(spark)
    w = np.diag([1.0] * 3, 1)
    w += w.T
    d, x = w.sum(1), np.array([0.0, 1, 2, 4])
    pi = d / d.sum()
    c = x - pi @ x
    want, step = [], np.eye(4)
    for _ in range(4):
        want.append((pi * c) @ step @ c / ((pi * c) @ c))
        step = step @ (w / d[:, None])
    got = [r.autocorrelation for r in W.autocorrelation(nodes, edges, 3).orderBy("lag").collect()]
    assert got == pytest.approx(want)
    with pytest.raises(ValueError, match="constant"):
        W.autocorrelation(nodes.withColumn("value", F.lit(1.0)), edges, 1)


def test_walks(spark):
    nodes, edges = path4(spark)
    assert {r.node: r.optimum for r in W.basins(nodes, edges).collect()} == dict.fromkeys(range(4), 3)
    access = W.path_accessibility(nodes, edges).first()
    assert (access.accessible_pairs, access.total_pairs, access.accessibility) == (1, 1, 1.0)
    starts = spark.createDataFrame([(7, 0)], "walk long, node long")
    assert [r.node for r in W.simulate(nodes, edges, starts, 4, greedy=True).orderBy("step").collect()] == [0, 1, 2, 3, 3]
    free = W.simulate(nodes, edges, starts, 20, seed=1).orderBy("step").collect()
    assert all(abs(a.node - b.node) == 1 for a, b in zip(free, free[1:]))
    basin = {r.node: r.probability for r in W.stochastic_basin(nodes, edges, 3, n=8, steps=10, beta=50.0).collect()}
    assert basin[3] == 1.0 and set(basin) == {0, 1, 2, 3}
    acf = {r.lag: r.autocorrelation for r in W.sampled_autocorrelation(nodes, edges, 2, walks=60, steps=40).collect()}
    assert acf[0] == pytest.approx(1) and abs(acf[1]) < 1
    two = nodes.select("node", F.when(F.col("node") < 2, "a").otherwise("b").alias("category"))
    assert {(r.a, r.b) for r in W.crossing_times(two, edges, walks=10, steps=20).collect()} == {("a", "b"), ("b", "a")}


def test_hamming_builders_agree_and_skip_equal_rows(spark):
    rng = np.random.default_rng(0)
    codes = sorted(set(rng.integers(0, 64, 30).tolist())) + [5, 5]
    rows = spark.createDataFrame([(i, int(c), list(f"{c:06b}")) for i, c in enumerate(codes)], "node long, code long, symbols array<string>")
    want = {(i, j) for j, b in enumerate(codes) for i, a in enumerate(codes[:j]) if (a ^ b).bit_count() == 1}
    assert {(r.u, r.v) for r in E.hamming_edges_binary(rows, 6).collect()} == want == {(r.u, r.v) for r in E.hamming_edges(rows).collect()}
    with pytest.raises(ValueError, match="unequal"):
        E.hamming_edges(rows.union(spark.createDataFrame([(99, 0, ["0"])], rows.schema)))


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_ROWS", 16)
    x = np.random.default_rng(1).normal(size=(60, 4)).round(3)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "node long, vector array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i], kind="stable")[:3]}
    for ties in ("all", "min_index"):
        assert {(r.node, r.other) for r in E.nearest(v, 3, ties=ties).collect()} == want
    for bad in ({"k": True}, {"k": 0}, {"k": 2, "ties": "none"}):
        with pytest.raises(ValueError, match="k:|ties"):
            E.nearest(v, **bad)


def test_planted_epistasis(spark):
    rows = [(i, [int(b) for b in f"{i:03b}"], 2.0 - 1.5 * (1 - 2 * (i >> 2 & 1)) + 0.5 * (1 - 2 * (i >> 1 & 1)) * (1 - 2 * (i & 1))) for i in range(8)]
    nodes = spark.createDataFrame(rows, "code long, bits array<int>, value double")
    got = {r.sites: round(r.coefficient, 9) for r in P.walsh(nodes, 3).collect()}
    assert {k: v for k, v in got.items() if v} == {"intercept": 2.0, "0": -1.5, "1,2": 0.5}
    fit = {r.term: (round(r.coefficient, 9), round(r.r2, 9)) for r in P.regression(nodes, 3, 2).collect()}
    assert fit["pos0"] == (-1.5, 1.0) and fit["pos1*pos2"] == (0.5, 1.0)
    assert {r.term: r.coefficient for r in P.regression(nodes, 3, 1, l1=2.0).collect()}["pos0"] == 0
    with pytest.raises(ValueError, match="rank"):
        P.regression(nodes.where("code < 2"), 3, 2)
    assert N.nk(spark, 4, 1, seed=1).count() == 16 and abs(N.nk(spark, 5, 0, seed=1).agg(F.avg("value")).first()[0]) < 1e-9


def test_statistics(spark):
    assert T.t_p_value(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert T.normal_p_value(1.959963985) == pytest.approx(0.05, abs=1e-8)
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "name string, p_value double")
    assert {r.name: r.p_adjusted and round(r.p_adjusted, 9) for r in T.adjusted(p, "holm").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06, "d": None}
    assert {r.name: r.p_adjusted and round(r.p_adjusted, 9) for r in T.adjusted(p, "bh").collect()} == {"a": 0.03, "b": 0.04, "c": 0.04, "d": None}
    assert T.shapiro_w(np.arange(10)) == pytest.approx(0.9702, abs=2e-3)
    with pytest.raises(ValueError, match="missing"):
        T.finite(spark.createDataFrame([("a", float("nan"))], "group string, value double"))


def test_sequence_functions(spark):
    lit = lambda xs: F.array(*map(F.lit, xs))
    assert one(spark, SF.hamming(lit("abc"), lit("abd"))) == 1
    assert one(spark, SF.one_hot(lit("a-"), ["A", "-"])) == [[1, 0], [0, 1]]
    assert one(spark, SF.codes(lit(["C", "."]), ["A", "C", "gap"])) == [1, 2]
    assert one(spark, SF.from_codes(SF.codes(lit("CA"), "AC"), "AC")) == ["C", "A"]
    assert one(spark, SF.from_one_hot(SF.one_hot(lit("CA"), "AC"), "AC")) == ["C", "A"]
    assert one(spark, SF.mutate(lit("abc"), {1: "z"})) == ["a", "z", "c"]
    assert one(spark, SF.bits(F.lit(5), 4)) == [0, 1, 0, 1] and one(spark, SF.from_bits(SF.bits(F.lit(5), 4))) == 5
    assert one(spark, SF.gapped_text(lit(["a", "gap", "."]))) == "A--"
    assert one(spark, SF.entropy(lit([0.5, 0.5, 0.0]), 2)) == pytest.approx(1)
    assert one(spark, SF.without_gaps(F.array(lit([0.25, 0.25, 0.5])))) == [[0.5, 0.5]]
    with pytest.raises(Exception, match="alphabet"):
        one(spark, SF.codes(lit("x"), "ab"))
    assert np.isnan(one(spark, LF.mean(lit([1.0, float("nan")])))) and one(spark, LF.rank(F.lit("b"), ["a", "b"])) == 1
    assert one(spark, LF.trimmed(lit([1.0, float("nan"), 2.0, float("nan")])))[-1] == 2.0
    assert one(spark, LF.likeliest(lit([0.2, 0.4, 0.4]))) == 1
    assert one(spark, LF.from_logits(lit([0.0, 0.0]))) == [0.5, 0.5]
    with pytest.raises(Exception, match="mass"):
        one(spark, LF.from_counts(lit([0.0, 0.0])))


def test_attach_policies(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "node long, seq string")
    values = spark.createDataFrame([("x", 1.0, 1), ("x", 3.0, 0)], "seq string, value double, ord int")
    with pytest.raises(ValueError, match="several"):
        A.attach(rows, values, "seq")
    with pytest.raises(ValueError, match="without"):
        A.attach(rows, values, "seq", duplicates="first")
    got = {r.node: r.value for r in A.attach(rows, values, "seq", duplicates="first", allow_missing=True).collect()}
    assert got == {1: 3.0, 2: None}
    with pytest.raises(KeyError):
        A.query(rows, {"nope": 1})


def test_edge_meanings(spark):
    _, edges = path4(spark)
    told = G.declare(edges, conductance="weight")
    assert G.resolve(told, "conductance") == "weight"
    for bad in (edges, G.declare(edges.withColumn("weight", F.lit(-1.0)), conductance="weight")):
        with pytest.raises(ValueError, match="weight|column"):
            G.resolve(bad, "conductance")


def test_trees():
    tree = phylo.parse_newick("((a:1,b:2)ab:0.5,(c:1,d:1):0.5)r;")
    assert ("ab", "b", 2.0) in tree and ("r", "ab", 0.5) in tree and len(tree) == 6
    names, d = list("abcd"), np.array([[0, 3, 4, 4], [3, 0, 5, 5], [4, 5, 0, 2], [4, 5, 2, 0]], float)
    joined = phylo.neighbour_joining(names, d)
    assert phylo.robinson_foulds(tree, joined, set(names))[0] == 0
    other = phylo.parse_newick("((a,c),(b,d));")
    assert phylo.robinson_foulds(tree, other, set(names)) == (2, 1.0)
    q = phylo.rate_matrix(np.ones((2, 2)), np.array([0.5, 0.5]))
    assert phylo.transition(q, 1.0)[0, 1] == pytest.approx((1 - np.exp(-2)) / 2)
    post = phylo.ancestral([("r", "a", 0.1), ("r", "b", 0.1)], {"a": np.array([[1.0, 0]]), "b": np.array([[1.0, 0]])}, q)
    assert post["r"][0, 0] > 0.95


def test_files(spark, tmp_path):
    csv = tmp_path / "in.csv"
    csv.write_text("sequence,fit,r1,r2,kind,p=A,p=B\n000,1.5,1,,x,0.2,0.8\n010,2.5,1,3,y,0.5,0.5\n")
    got = IO.read_csv(spark, str(csv), numeric=("fit",), categorical=("kind",), replicate_prefixes={"reps": "r"}, probabilities={"p": {"p=A": "A", "p=B": "B"}}).orderBy("sequence").collect()
    assert (got[0].sequence, got[0].fit, got[0].reps, got[0].p, got[1].reps) == ("000", [1.5], [1.0], [0.2, 0.8], [1.0, 3.0])
    with pytest.raises(ValueError, match="columns"):
        IO.read_csv(spark, str(csv), numeric=("nope",))
    fasta = tmp_path / "x.fasta"
    fasta.write_text(">one first\nAC-\nDE\n>two\nACxDE\n")
    rows = IO.read_fasta(spark, str(fasta))
    assert {r.name: r.sequence for r in rows.collect()} == {"one": "AC-DE", "two": "ACxDE"}
    assert {r.sequence for r in IO.drop_gap_columns(IO.sanitize(rows)).collect()} == {"ACDE"}
    nodes, edges = path4(spark)
    IO.write_xgmml(nodes.withColumn("name", F.lit("a<b")), edges, str(tmp_path / "g.xgmml"))
    assert 'value="a&lt;b"' in (tmp_path / "g.xgmml").read_text()


def test_landscape_and_bundle(spark, tmp_path):
    seq = spark.createDataFrame([(i, list(f"{i:03b}")) for i in range(8)], "node long, symbols array<string>")
    values = spark.createDataFrame([(i, float(i)) for i in range(8)], "node long, value double")
    land = Landscape.build(seq).attach("fit", values)
    land.annotations["notes"] = seq.select("node", F.lit("x").alias("kind"))
    assert land.edges.count() == 12 and land.query("notes", {"kind": "x"})[1].count() == 12
    assert land.parts().select("component").distinct().count() == 1
    path = str(tmp_path / "bundle")
    land.save(path)
    back = Landscape.load(spark, path)
    assert back.active == "fit" and back.signal().count() == 8 and back.edges.count() == 12
    with pytest.raises(FileExistsError):
        land.save(path)
    IO.export_archive(path, str(tmp_path / "a.zip"))
    IO.export_archive(path, str(tmp_path / "b.zip"))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    assert len(IO.load_archive(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"))[0]) == 4
    victim = next((tmp_path / "bundle" / "edges").glob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    with pytest.raises(ValueError, match="changed"):
        Landscape.load(spark, path)


def test_streaming_windows(spark, tmp_path):
    from peakfield.streaming.events import sessions, windowed

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("w")) == key(windowed(src))
    assert sessions(src).agg(F.sum("n")).first()[0] == src.count()


def test_entry_without_llm(spark, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "llm_queries", None)
    assert not [k for k in e.queries() if k.startswith("op")] and e.entry(spark).count() == 1


def test_tree_landscape(spark):
    from peakfield.operators.tree_graphs import pairwise_distances, tree_landscape

    rows = [("a", "AAAAAAAA"), ("b", "AAAAAAAC"), ("c", "CCCCCCAA"), ("d", "CCCCCCA-")]
    alignment = spark.createDataFrame([(n, list(s)) for n, s in rows], "name string, symbols array<string>")
    d = {(r.u, r.v): r.distance for r in pairwise_distances(alignment).collect()}
    assert d[("a", "b")] == 1 / 8 and d[("c", "d")] == 0 and d[("a", "d")] == 6 / 7
    nodes, edges = tree_landscape(alignment, phylo.rate_matrix(np.ones((2, 2)), np.array([0.5, 0.5])), "AC")
    assert nodes.count() == edges.count() + 1 == 6
    assert {r.role for r in nodes.collect()} == {"extant", "ancestral"} and edges.agg(F.min("branch_length")).first()[0] >= 0
