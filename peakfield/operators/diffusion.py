"""Diffusion kernels over an edge table, with budgets checked before each product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import nearest
from .graph import both_ways, components, cut
from .matching import gapped_soft_score

MAX_ENTRIES, MAX_PRODUCTS = 50_000_000, 1_000_000_000


def rbf_edges(vectors: DataFrame, k: int) -> DataFrame:
    """(u, v, weight): exp(-gamma d^2) over the union of nearest neighbours, where gamma is
    1 / (2 median(distance to the k-th neighbour)^2)."""
    near = cut(nearest(vectors, k))
    kth = near.groupBy("node").agg(F.max("distance").alias("d")).agg(F.median("d")).first()[0]
    gamma = 1 / (2 * kth * kth) if kth else 1.0
    pairs = near.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), "distance")
    return pairs.groupBy("u", "v").agg(F.min("distance").alias("distance")).select("u", "v", F.exp(-gamma * F.col("distance") * F.col("distance")).alias("weight"))


def lazy_transition(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(i, j, p) of P = (I + D^-1 W) / 2 and (node, pi); an isolated node gets a loop of weight 1."""
    both = both_ways(edges.select("u", "v", "weight"))
    alone = nodes.select("node").join(both.select(F.col("u").alias("node")), "node", "left_anti").select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(1.0).alias("weight"))
    w = cut(both.union(alone))
    d = w.groupBy("u").agg(F.sum("weight").alias("d"))
    step = w.join(d, "u").select(F.col("u").alias("i"), F.col("v").alias("j"), (F.col("weight") / F.col("d") / 2).alias("p"))
    stay = nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.5).alias("p"))
    pi = d.crossJoin(d.agg(F.sum("d").alias("all"))).select(F.col("u").alias("node"), (F.col("d") / F.col("all")).alias("pi"))
    return cut(step.union(stay).groupBy("i", "j").agg(F.sum("p").alias("p"))), cut(pi)


def power(step: DataFrame, t: int, *, max_entries: int = MAX_ENTRIES, max_products: int = MAX_PRODUCTS) -> DataFrame:
    """(i, j, p) of P^t. What a product will cost is counted first; beyond the budget it raises."""
    now, spent = step, 0
    out = step.groupBy(F.col("i").alias("j")).agg(F.count("*").alias("n"))
    for _ in range(t - 1):
        spent += now.join(out, "j").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if spent > max_products:
            raise MemoryError(f"the power needs {spent} products or more; the budget is {max_products}")
        now = cut(now.join(step.select(F.col("i").alias("j"), F.col("j").alias("to"), F.col("p").alias("q")), "j").groupBy("i", F.col("to").alias("j")).agg(F.sum(F.col("p") * F.col("q")).alias("p")))
        if (n := now.count()) > max_entries:
            raise MemoryError(f"the power has {n} entries; the budget is {max_entries}")
    return now


def kernel(nodes: DataFrame, edges: DataFrame, t: float | None, *, threshold: float = 0.0, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """(u, v, weight): entries of Pi^.5 P^t Pi^-.5 above the threshold, u < v; t None, 0 or infinite:
    the limit sqrt(pi_u pi_v) over the mass of their component."""
    step, pi = lazy_transition(nodes, edges)
    if t is None or t == 0 or math.isinf(t):
        label = cut(components(nodes, edges))
        n = label.groupBy("component").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
        if n > max_entries:
            raise MemoryError(f"the limit has {n} entries; the budget is {max_entries}")
        held = label.join(pi, "node").withColumn("mass", F.sum("pi").over(Window.partitionBy("component")))
        a, b = (held.select(F.col("node").alias(n), F.col("pi").alias(f"p{n}"), "component", *(["mass"] * (n == "u"))) for n in ("u", "v"))
        found = a.join(b, "component").where("u < v").select("u", "v", (F.sqrt(F.col("pu") * F.col("pv")) / F.col("mass")).alias("weight"))
    else:
        if t != int(t) or t < 1:
            raise ValueError("t: a whole number of 1 or more")
        p = power(step, int(t), max_entries=max_entries).where("i < j")
        found = p.join(pi.select(F.col("node").alias("i"), F.col("pi").alias("pu")), "i").join(pi.select(F.col("node").alias("j"), F.col("pi").alias("pv")), "j").select(F.col("i").alias("u"), F.col("j").alias("v"), (F.col("p") * F.sqrt(F.col("pu") / F.col("pv"))).alias("weight"))
    return found.where(F.col("weight") > threshold)


def aligned_scores(pairs: DataFrame, rows: DataFrame, scores: np.ndarray, gap: float = -2.0) -> DataFrame:
    """(u, v, score): the soft score of aligned rows(node, posterior), whose last entries are gaps,
    over the places that both are expected to hold."""
    ends = pairs.select("u", "v").join(rows.select(F.col("node").alias("u"), F.col("posterior").alias("p")), "u").join(rows.select(F.col("node").alias("v"), F.col("posterior").alias("q")), "v")
    kind = ends.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.array(p), np.array(q)
                size = float((1 - p[:, -1] * q[:, -1]).sum())
                out.append(gapped_soft_score(p, q, scores, gap) / max(size, 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["u", "v", "score"])

    return ends.select("u", "v", "p", "q").mapInArrow(run, f"u {kind}, v {kind}, score double")


def score_affinity(scored: DataFrame, tau: float) -> DataFrame:
    """(u, v, weight): exp((score - the greatest score) / tau), never below the least normal float."""
    if not 0 < tau < math.inf:
        raise ValueError("tau: finite and above 0")
    top = scored.agg(F.max("score")).first()[0]
    return scored.select("u", "v", F.exp(F.greatest((F.col("score") - F.lit(top)) / tau, F.lit(math.log(2.2250738585072014e-308)))).alias("weight"))


def evolutionary_kernel(vectors: DataFrame, rows: DataFrame, scores: np.ndarray, *, k: int, tau: float, t: float | None, threshold: float = 0.0) -> DataFrame:
    """The diffusion kernel over nearest neighbours, whose edges weigh by their alignment score."""
    near = nearest(vectors, k).select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    edges = cut(score_affinity(cut(aligned_scores(near, rows, scores)), tau))
    return kernel(vectors.select("node"), edges, t, threshold=threshold)
