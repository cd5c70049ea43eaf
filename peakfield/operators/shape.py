"""Operators that reshape graphs and layers: leaves, chains, edge mutations, communities, pivots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways, cut, undirected
from .spectral import by_component


#: Rows that a task sorts, about, and pieces of a node's edges that are sorted apart.
TASK_ROWS, PIECES = 1 << 19, 16


def total_weight(edges: DataFrame, column: str = "weight") -> DataFrame:
    """One row: the sum of a column over all edges (0 without any), and their number."""
    return edges.agg(F.coalesce(F.sum(F.col(column).cast("double")), F.lit(0.0)).alias("total"), F.count("*").alias("n_edges"))


def leaves(edges: DataFrame) -> DataFrame:
    """(node): the nodes with one neighbour."""
    return both_ways(edges.select("u", "v")).distinct().groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")


def spanning_tree_of(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The part of a tree that joins ``kept`` (node): other leaves fall off, round by round."""
    edges = cut(edges)
    while True:
        loose = cut(leaves(edges).join(kept.select("node"), "node", "left_anti"))
        if not loose.head(1):
            return edges
        edges = edges.join(loose.select(F.col("node").alias("u")), "u", "left_anti").join(loose.select(F.col("node").alias("v")), "v", "left_anti")
        edges = cut(edges.select("u", "v", *(c for c in edges.columns if c not in ("u", "v"))))


def suppress_degree_two(edges: DataFrame, kept: DataFrame, column: str = "weight") -> DataFrame:
    """(u, v, column): a tree without its nodes of two neighbours but for ``kept`` (node); the lengths
    along a chain add up. Each round takes out the nodes whose hash is the least among neighbours of
    two neighbours, so that a chain shrinks by a share of its length."""
    edges = cut(edges.select("u", "v", F.col(column).cast("double").alias(column)))
    while True:
        both = both_ways(edges)
        two = both.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n")).where("n = 2").select("node").join(kept.select("node"), "node", "left_anti")
        two = cut(two.withColumn("h", F.xxhash64("node")))
        if not two.head(1):
            return edges
        beside = both.join(two.withColumnRenamed("node", "u"), "u").join(two.select(F.col("node").alias("v"), F.col("h").alias("g")), "v")
        lesser = beside.where(F.struct("h", "u") > F.struct("g", "v")).select(F.col("u").alias("node")).distinct()
        out = cut(two.join(lesser, "node", "left_anti").select("node"))
        joined = both.join(out.withColumnRenamed("node", "u"), "u").groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum(column).alias(column))
        rest = edges.join(out.select(F.col("node").alias("u")), "u", "left_anti").join(out.select(F.col("node").alias("v")), "v", "left_anti")
        edges = cut(rest.select("u", "v", column).union(joined.select(F.col("a").alias("u"), F.col("b").alias("v"), column)))


def edge_mutations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, n_mutations, mutations): what changes along each edge from u to v, as from, place
    (from 1) and to; nodes(node, symbols) of one length."""
    ends = edges.select("u", "v").join(nodes.select(F.col("node").alias("u"), F.col("symbols").alias("p")), "u").join(nodes.select(F.col("node").alias("v"), F.col("symbols").alias("q")), "v")
    return told_mutations(ends, F.col("p"), F.col("q")).select("u", "v", F.size("mutations").alias("n_mutations"), "mutations")


def told_mutations(rows: DataFrame, p: Column, q: Column) -> DataFrame:
    """rows with mutations: what changes from one column's symbols to the other's."""
    told = F.zip_with(p, q, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    placed = F.transform(told, lambda s, i: F.when(s["a"] != s["b"], F.concat(s["a"], (i + 1).cast("string"), s["b"])))
    changed = F.when(F.size(p) == F.size(q), F.filter(placed, lambda x: x.isNotNull())).otherwise(F.raise_error(F.lit("sequences of unequal length")))
    return rows.withColumn("mutations", changed)


def at_most_k_edges(edges: DataFrame, k: int) -> DataFrame:
    """Edges that are among the first ``k`` of both their ends, by falling weight, then by the other
    end. Ranks need sorts, of about TASK_ROWS in a task: first within PIECES of each node's edges, so
    that a node of very many is not sorted in one task, then of what these leave. Edges are counted
    first, as adaptive execution would join small partitions into few large ones."""
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(2 * edges.count() / TASK_ROWS))
    order = [F.desc("weight"), "v"]
    both = both_ways(edges).withColumn("piece", F.pmod(F.xxhash64("v"), F.lit(PIECES))).repartition(tasks, "u", "piece")
    near = both.withColumn("r", F.row_number().over(Window.partitionBy("u", "piece").orderBy(*order))).where(F.col("r") <= k)
    near = near.drop("r", "piece").repartition(tasks, "u")
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(*order))).where(F.col("r") <= k)
    rest = [c for c in edges.columns if c not in ("u", "v")]
    pairs = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *rest)
    return pairs.groupBy("u", "v").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in rest)).where("n = 2").select(*edges.columns)


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community): communities by moves that raise modularity, then of whole communities, until
    none does; each connected component by itself. A community is named by its least node."""

    def moves(w: np.ndarray) -> np.ndarray:
        label, degree = np.arange(len(w)), w.sum(1)
        mass, total = degree.copy(), max(degree.sum(), 1e-300)
        for _ in range(100):
            moved = False
            for i in range(len(w)):
                mass[label[i]] -= degree[i]
                to = np.bincount(label, weights=w[i] * (np.arange(len(w)) != i), minlength=len(w))
                gain = to - resolution * degree[i] * mass / total
                best = int(gain.argmax())
                if gain[best] > gain[label[i]] + 1e-12:
                    label[i], moved = best, True
                mass[label[i]] += degree[i]
            if not moved:
                break
        return np.unique(label, return_inverse=True)[1]

    def solve(w: np.ndarray, n: pd.DataFrame) -> pd.DataFrame:
        label = np.arange(len(n))
        while True:
            new = moves(w)
            if new.max(initial=-1) + 1 == len(w):
                break
            label, member = new[label], np.eye(new.max() + 1)[new]
            w = member.T @ w @ member
        names = n["node"].to_numpy()
        least = {c: names[label == c].min() for c in np.unique(label)}
        return pd.DataFrame({"node": names, "community": [least[c] for c in label]})

    kind = nodes.schema["node"].dataType.simpleString()
    return by_component(nodes.select("node"), edges, solve, f"node {kind}, community {kind}")


def wide(layers: dict[str, DataFrame]) -> DataFrame:
    """(node, a column for each layer): the layers' values side by side; null where one has none."""
    rows = [df.select("node", F.lit(name).alias("layer"), "value") for name, df in layers.items()]
    long_ = rows[0]
    for more in rows[1:]:
        long_ = long_.unionByName(more)
    return long_.groupBy("node").pivot("layer", list(layers)).agg(F.first("value"))


def long(table: DataFrame, names: list[str]) -> DataFrame:
    """(node, layer, value): the columns ``names`` below each other, without nulls."""
    return table.unpivot(["node"], names, "layer", "value").where("value is not null")


def graph_table(edges: DataFrame) -> DataFrame:
    """(source, target, weight): every edge in both directions, with nodes numbered from 0 by their
    order, as tensor libraries read it; numbers run on from one range of nodes to the next."""
    names = both_ways(edges.select("u", "v")).select(F.col("u").alias("node")).distinct()
    sorted_ = cut(names.repartitionByRange("node").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = sorted_.groupBy("part").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1
    number = cut(sorted_.join(F.broadcast(parts), "part").select("node", (F.col("first") + within).alias("place")))
    both = both_ways(edges.select("u", "v", "weight"))
    ends = both.join(number.select(F.col("node").alias("u"), F.col("place").alias("source")), "u").join(number.select(F.col("node").alias("v"), F.col("place").alias("target")), "v")
    return ends.select("source", "target", "weight")


def edges_of(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """Edges (u, v, weight, distance, ...) from any table of pairs: each once, self pairs gone; of
    repeated pairs the greatest weight counts, 1 where none is given."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    one = undirected(pairs.select("u", "v", w.alias("w")), F.max("w").alias("weight"))
    return one.withColumn("distance", F.when(F.col("weight") > 0, 1 / F.col("weight")))
