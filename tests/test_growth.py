"""Groups that grow with the input: no list, hash table or sketch of one may grow with it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakfield.functions import layers as LF
from peakfield.operators import shape as S
from peakfield.operators import stats as T
from peakfield.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_of_a_long_list(spark):
    n = 100_000  # quadratic: 10 billion steps
    x = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("double")).alias("x"))
    assert x.select(LF.spread(F.col("x"))).first()[0] == pytest.approx(np.sqrt((n * n - 1) / 12))
    assert np.isnan(x.select(LF.spread(F.array(F.lit(1.0), F.lit(float("nan"))))).first()[0])


def test_replicates_are_not_listed(spark):
    assert "collect_list" not in plan_of(QUERIES["replicate_spread"](spark, DATA))


def test_no_sketch_for_every_part(spark):
    plan = plan_of(QUERIES["approximate_counts"](spark, DATA))
    assert not any("approx" in line and "l_partkey" in line.split("functions")[0] for line in plan.splitlines() if "Aggregate" in line)
    assert "partial_median" not in plan and "partial_percentile(" not in plan


def test_medians_are_exact(spark):
    rng = np.random.default_rng(3)
    sets = {"odd": rng.normal(size=5001), "even": rng.normal(size=5000), "ties": rng.integers(0, 3, 3000).astype(float), "one": [4.0], "two": [1.0, 2.0], "same": [7.0] * 999}
    sets["nans"] = [*rng.normal(size=70).tolist(), *[float("nan")] * 30]
    rows = [(g, float(x)) for g, xs in sets.items() for x in xs] + [("one", None), (None, 3.0)]
    samples = spark.createDataFrame(rows, "group string, value double")
    want = dict(map(tuple, samples.groupBy("group").agg(F.median("value")).collect()))
    assert dict(map(tuple, T.medians(samples).collect())) == pytest.approx(want, rel=1e-15)


def test_permutations_are_those_of_a_full_sort(spark):
    rng = np.random.default_rng(4)
    data = [("a" if i % 3 else "b", float(x)) for i, x in enumerate(rng.normal(size=600))] + [("c", 1e9), ("a", None)]
    samples = spark.createDataFrame(data, "group string, value double").coalesce(1)
    got = T.permutation_test(samples, "a", "b", n=50, seed=2)
    two = samples.where("group in ('a', 'b')").withColumn("row", F.monotonically_increasing_id())
    drawn = two.select("row", "value", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("i")).withColumn("h", F.xxhash64("row", "i", F.lit(2))).toPandas()
    x = two.toPandas()
    of = lambda g: x.value[x.group == g].mean()
    na, observed, extreme = (x.group == "a").sum(), of("a") - of("b"), 0
    for _, p in drawn.sort_values(["i", "h", "row"]).groupby("i"):
        extreme += abs(p.value[:na].mean() - p.value[na:].mean()) >= abs(observed)
    row = got.first()
    assert row.extreme_count == extreme > 0 and row.observed == pytest.approx(observed)


def test_sorts_of_edges_are_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 100)
    rng = np.random.default_rng(6)
    pairs = {(0, v) for v in range(1, 400)} | {(int(min(p)), int(max(p))) for p in rng.integers(0, 400, (900, 2)) if p[0] != p[1]}
    rows = [(u, v, float(rng.integers(0, 6)), f"{u}-{v}") for u, v in sorted(pairs)]
    got = S.at_most_k_edges(spark.createDataFrame(rows, "u long, v long, weight double, tag string"), 3)
    near = {}
    for u, v, w, tag in rows:
        near.setdefault(u, []).append((-w, v, tag))
        near.setdefault(v, []).append((-w, u, tag))
    kept = [tag for x in near.values() for _, _, tag in sorted(x)[:3]]
    assert sorted(r.tag for r in got.collect()) == sorted(t for t in set(kept) if kept.count(t) == 2)
    # As many partitions as rows ask for, whatever adaptive execution would join.
    tasks = -(-2 * len(rows) // 100)
    assert plan_of(got).count(f", {tasks}), REPARTITION_BY_NUM") == 4  # in the first plan and in the last
