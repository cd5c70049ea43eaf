"""Landscapes from alignments: pairwise distances, a joined tree, ancestral states, and its graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phylo import MAX_TIPS, ancestral, neighbour_joining


def pairwise_distances(alignment: DataFrame, gap: str = "-") -> DataFrame:
    """(u, v, distance): the share of differing places among those without a gap in either, by
    counting equal and shared places over (place, symbol) instead of comparing rows."""
    cells = alignment.select("name", F.posexplode("symbols").alias("p", "s")).where(F.col("s") != gap)
    there = cells.groupBy("p").agg(F.collect_list(F.struct("name", "s")).alias("at"))  # bounded by MAX_TIPS
    pairs = there.select(F.explode("at").alias("x"), "at").select("x", F.explode("at").alias("y")).where("x.name < y.name")
    return pairs.groupBy(F.col("x.name").alias("u"), F.col("y.name").alias("v")).agg(F.avg((F.col("x.s") != F.col("y.s")).cast("double")).alias("distance"))


def tree_of(alignment: DataFrame) -> list[tuple[str, str, float]]:
    """The neighbour-joining tree of an alignment of at most MAX_TIPS rows."""
    names = [r["name"] for r in alignment.select("name").orderBy("name").limit(MAX_TIPS + 1).collect()]
    if len(names) > MAX_TIPS:
        raise MemoryError(f"more than {MAX_TIPS} tips")
    place, d = {n: i for i, n in enumerate(names)}, np.ones((len(names), len(names)))
    np.fill_diagonal(d, 0)
    for r in pairwise_distances(alignment).toLocalIterator():
        d[place[r["u"]], place[r["v"]]] = d[place[r["v"]], place[r["u"]]] = r["distance"]
    return neighbour_joining(names, d)


def tree_landscape(alignment: DataFrame, q: np.ndarray, alphabet: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes(node, role, symbols, posterior) of tips and ancestors, and edges(u, v,
    branch_length) of the joined tree."""
    spark, tree = alignment.sparkSession, tree_of(alignment)
    rows = {r["name"]: list(r["symbols"]) for r in alignment.select("name", "symbols").collect()}  # at most MAX_TIPS
    at = {c: i for i, c in enumerate(alphabet)}
    tips = {n: np.array([np.eye(len(alphabet))[at[c]] if c in at else np.ones(len(alphabet)) for c in s]) for n, s in rows.items()}
    found = {n: p / p.sum(1, keepdims=True) for n, p in tips.items()} | ancestral(tree, tips, q)
    made = [(n, "extant" if n in rows else "ancestral", [alphabet[i] for i in p.argmax(1)], p.tolist()) for n, p in found.items()]
    nodes = spark.createDataFrame(made, "node string, role string, symbols array<string>, posterior array<array<double>>")
    edges = spark.createDataFrame(pd.DataFrame([(min(p, c), max(p, c), max(t, 0.0)) for p, c, t in tree], columns=["u", "v", "branch_length"]))
    return nodes, edges
