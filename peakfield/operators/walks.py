"""Walks on a landscape: autocorrelation, ascent, basins, accessible paths and crossing times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import both_ways, cut, with_values


def stationary(edges: DataFrame) -> DataFrame:
    """(node, pi): degree by weight over the sum of all."""
    strength = both_ways(edges.select("u", "v", "weight")).groupBy(F.col("u").alias("node")).agg(F.sum("weight").alias("s"))
    return strength.crossJoin(strength.agg(F.sum("s").alias("all"))).select("node", (F.col("s") / F.col("all")).alias("pi"))


def autocorrelation(nodes: DataFrame, edges: DataFrame, lags: int) -> DataFrame:
    """(lag, autocorrelation) of the non-lazy walk in equilibrium, exactly: each lag is one join of
    the walk's steps with the signal."""
    pi = stationary(edges)
    held = nodes.select("node", F.col("value").cast("double").alias("value")).join(pi, "node")
    mean = held.agg(F.sum(F.col("pi") * F.col("value")).alias("mean"))
    signal = cut(held.crossJoin(mean).select("node", "pi", (F.col("value") - F.col("mean")).alias("x")))
    both = both_ways(edges.select("u", "v", "weight"))
    step = cut(both.join(both.groupBy("u").agg(F.sum("weight").alias("s")), "u").select("u", "v", (F.col("weight") / F.col("s")).alias("p")))
    var, top = signal.agg(F.sum(F.col("pi") * F.col("x") * F.col("x")), F.max(F.abs("x"))).first()
    if not var or top <= 1e-12 * max(1.0, abs(mean.first()[0])):
        raise ValueError("a constant signal has no autocorrelation")
    now, out = signal.select("node", F.col("x").alias("y")), [(0, 1.0)]
    for lag in range(1, lags + 1):
        now = cut(step.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.sum(F.col("p") * F.col("y")).alias("y")))
        out.append((lag, now.join(signal, "node").agg(F.sum(F.col("pi") * F.col("x") * F.col("y"))).first()[0] / var))
    return nodes.sparkSession.createDataFrame(out, "lag int, autocorrelation double")


def ascent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, next): the best neighbour (of equals the first), or the node itself at an optimum."""
    e = with_values(both_ways(edges.select("u", "v")), nodes)
    best = e.where("fv > fu").groupBy("u").agg(F.max_by("v", F.struct("fv", -F.col("v"))).alias("next"))
    return nodes.select("node").join(best.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("next", "node").alias("next"))


def basins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, optimum) of steepest ascent, by pointer jumping: paths of n steps take log2 n joins."""
    now = cut(ascent(nodes, edges))
    while True:
        new = cut(now.join(now.select(F.col("node").alias("next"), F.col("next").alias("after")), "next").select("node", F.col("after").alias("next")))
        if not new.join(now.withColumnRenamed("next", "was"), "node").where("next != was").head(1):
            return new.withColumnRenamed("next", "optimum")
        now = new


def accessible_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, paths, shortest, longest, steps): strictly increasing paths from each start,
    counted along the graph of increasing edges and never listed."""
    up = with_values(edges.select("u", "v"), nodes)
    up = cut(up.where("fv > fu").select("u", "v").union(up.where("fu > fv").select("v", "u")))
    front = cut(starts.select(F.col("node").alias("start"), "node", F.lit(1).cast("decimal(38,0)").alias("paths")))
    known, step = front.withColumn("step", F.lit(0)), 0
    while front.head(1):
        step += 1
        front = cut(front.join(up, front["node"] == up["u"]).groupBy("start", F.col("v").alias("node")).agg(F.sum("paths").cast("decimal(38,0)").alias("paths")))
        known = cut(known.union(front.withColumn("step", F.lit(step))))
    return known.groupBy("start", "node").agg(F.sum("paths").alias("paths"), F.min("step").alias("shortest"), F.max("step").alias("longest"), F.sum(F.col("paths") * F.col("step")).alias("steps"))


def path_accessibility(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: minima, maxima, the pairs of them that an increasing path joins, and their share."""
    e = with_values(edges.select("u", "v"), nodes)
    has_less = e.where("fv < fu").select(F.col("u").alias("node")).union(e.where("fu < fv").select("v"))
    has_more = e.where("fv > fu").select(F.col("u").alias("node")).union(e.where("fu > fv").select("v"))
    low, high = cut(nodes.select("node").join(has_less, "node", "left_anti")), cut(nodes.select("node").join(has_more, "node", "left_anti"))
    ends = accessible_paths(nodes, edges, low).join(high, "node", "left_semi").where("start != node")
    one = ends.agg(F.count("*").alias("accessible_pairs")).crossJoin(low.agg(F.count("*").alias("minima_count"))).crossJoin(high.agg(F.count("*").alias("maxima_count")))
    same = low.join(high, "node", "left_semi").agg(F.count("*").alias("both"))
    total = F.col("minima_count") * F.col("maxima_count") - F.col("both")
    return one.crossJoin(same).select("minima_count", "maxima_count", "accessible_pairs", total.alias("total_pairs"), F.when(total > 0, F.col("accessible_pairs") / total).otherwise(0.0).alias("accessibility"))


def simulate(nodes: DataFrame, edges: DataFrame, starts: DataFrame, steps: int, *, seed: int = 0, beta: float | None = None, greedy: bool = False) -> DataFrame:
    """(walk, step, node, value): walks from starts(walk, node). Each step is one join with the
    neighbours: uniform by weight; with ``beta`` a move down is taken with exp(beta * change); with
    ``greedy`` only the best neighbour, while it is better. Draws hash the seed, walk and step, so a
    lost task repeats them."""
    value = nodes.select("node", F.col("value").cast("double").alias("value"))
    e = with_values(both_ways(edges.select("u", "v", "weight")), nodes).withColumnRenamed("fv", "gain").drop("fu")
    e = cut(e)

    def draw(step: int, salt: int, *more: str):
        return (F.pmod(F.xxhash64("walk", F.lit(step), F.lit(seed), F.lit(salt), *map(F.col, more)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    now = cut(starts.select("walk", "node").join(value, "node").select("walk", "node", "value"))
    known = now.withColumn("step", F.lit(0))
    for step in range(1, steps + 1):
        near = now.join(e, now["node"] == e["u"])
        if greedy:
            picked = near.where("gain > value").groupBy("walk").agg(F.max_by(F.struct(F.col("v").alias("node"), F.col("gain").alias("value")), F.struct("gain", -F.col("v"))).alias("to"))
        else:  # the least exponential clock of rate weight rings at a neighbour chosen by weight
            picked = near.groupBy("walk").agg(F.min_by(F.struct(F.col("v").alias("node"), F.col("gain").alias("value")), -F.log(draw(step, 1, "v")) / F.col("weight")).alias("to"))
        moved = now.join(picked, "walk", "left")
        take = F.col("to").isNotNull()
        if beta is not None:
            take = take & ((F.col("to.value") >= F.col("value")) | (draw(step, 2) < F.exp(beta * (F.col("to.value") - F.col("value")))))
        now = cut(moved.select("walk", F.when(take, F.col("to.node")).otherwise(F.col("node")).alias("node"), F.when(take, F.col("to.value")).otherwise(F.col("value")).alias("value")))
        known = cut(known.union(now.withColumn("step", F.lit(step))))
    return known.select("walk", "step", "node", "value")


def stochastic_basin(nodes: DataFrame, edges: DataFrame, optimum: object, *, n: int = 100, steps: int = 100, beta: float = 1.0, threshold: float = 0.5, seed: int = 0) -> DataFrame:
    """(node, probability, in_basin): the share of Metropolis walks from each node that meet the
    optimum."""
    starts = nodes.select("node", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).select(F.xxhash64("node", "i").alias("walk"), "node")
    first = starts.withColumnRenamed("node", "from")
    met = simulate(nodes, edges, starts, steps, seed=seed, beta=beta).groupBy("walk").agg(F.max((F.col("node") == F.lit(optimum)).cast("int")).alias("hit"))
    return met.join(first, "walk").groupBy(F.col("from").alias("node")).agg(F.avg("hit").alias("probability")).withColumn("in_basin", F.col("probability") >= threshold)


def sampled_autocorrelation(nodes: DataFrame, edges: DataFrame, lags: int, *, walks: int = 100, steps: int = 100, seed: int = 0) -> DataFrame:
    """(lag, autocorrelation, pairs) pooled over random walks that start in equilibrium."""
    pi = stationary(edges)
    start = pi.select("node", F.floor(F.col("pi") * walks).cast("int").alias("m"), F.pmod(F.col("pi") * walks, F.lit(1.0)).alias("part"))
    extra = (F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col("part")).cast("int")
    starts = start.select("node", F.explode(F.sequence(F.lit(0), F.col("m") + extra)).alias("i")).where("i > 0").select(F.xxhash64("node", "i").alias("walk"), "node")
    path = cut(simulate(nodes, edges, starts, steps, seed=seed))
    mean, var = path.agg(F.avg("value"), F.var_pop("value")).first()
    if not var:
        raise ValueError("a constant signal has no autocorrelation")
    x = path.select("walk", "step", (F.col("value") - mean).alias("x"))
    later = x.select("walk", F.col("step").alias("later"), F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag")).withColumn("step", F.col("later") - F.col("lag"))
    return x.join(later, ["walk", "step"]).groupBy("lag").agg((F.avg(F.col("x") * F.col("y")) / var).alias("autocorrelation"), F.count("*").alias("pairs"))


def crossing_times(nodes: DataFrame, edges: DataFrame, *, walks: int = 100, steps: int = 100, seed: int = 0) -> DataFrame:
    """(a, b, mean, std, hits): steps from nodes(node, category) of category a until category b."""
    flat = nodes.select("node", F.lit(0.0).alias("value"))
    pick = nodes.select("category", "node", F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("i"))
    starts = pick.groupBy("category", "i").agg(F.min_by("node", F.xxhash64("node", "i", F.lit(seed))).alias("node")).select(F.xxhash64("category", "i").alias("walk"), F.col("category").alias("a"), "node")
    path = simulate(flat, edges, starts.select("walk", "node"), steps, seed=seed).join(nodes.select("node", F.col("category").alias("b")), "node").join(starts.select("walk", "a"), "walk")
    first = path.where("a != b").groupBy("walk", "a", "b").agg(F.min("step").alias("t"))
    return first.groupBy("a", "b").agg(F.avg("t").alias("mean_crossing_time"), F.stddev_samp("t").alias("std_crossing_time"), F.count("*").alias("hit_count"))


def correlation_length(acf: pd.DataFrame | np.ndarray) -> float:
    """The length of the exponential that the first lag alone implies."""
    r = float(np.asarray(acf)[1])
    return -1 / np.log(r) if 0 < r < 1 else float("nan")
