"""Synthetic landscapes. NumPy draws the few random numbers on the driver; rows are made by Spark."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import from_bits


def sequences(spark: SparkSession, length: int, alphabet: Sequence[object]) -> DataFrame:
    """(node, symbols): all sequences, the first place slowest, by the digits of a range."""
    n, letters = len(alphabet), F.array(*(F.lit(str(a)) for a in alphabet))
    if not length:
        return spark.range(0).select(F.col("id").alias("node"), F.array().cast("array<string>").alias("symbols"))
    digits = [F.get(letters, F.pmod(F.floor(F.col("id") / F.lit(n ** (length - 1 - p))), F.lit(n)).cast("int")) for p in range(length)]
    return spark.range(n**length).select(F.col("id").alias("node"), F.array(*digits).alias("symbols"))


def nk(spark: SparkSession, n: int, k: int | None = None, *, alphabet: Sequence[object] = (0, 1), seed: int | None = None, neighbours: np.ndarray | None = None) -> DataFrame:
    """(node, symbols, value): the NK model. Site i takes a number from a table by its own symbol and
    those of its k neighbours; the value is the mean over sites. Tables are centred."""
    rng, a = np.random.default_rng(seed), len(alphabet)
    if neighbours is None:
        if k is None or not 0 <= k < n:
            raise ValueError("k: from 0 to below n")
        near = [sorted(rng.choice([j for j in range(n) if j != i], k, replace=False).tolist()) for i in range(n)]
    else:
        m = np.asarray(neighbours)
        if m.shape != (n, n) or not np.isin(m, (0, 1)).all() or (m != m.T).any() or m.diagonal().any():
            raise ValueError("neighbours: a symmetric 0/1 matrix with an empty diagonal")
        near = [np.flatnonzero(r).tolist() for r in m]
    tables, total = [], F.lit(0.0)
    for i, others in enumerate(near):
        table = rng.random(a ** (len(others) + 1))
        tables.append((table - table.mean()).tolist())
    rows = sequences(spark, n, alphabet)
    draws = spark.createDataFrame([(tables,)], "tables array<array<double>>")  # one row
    code = lambda p: F.pmod(F.floor(F.col("node") / F.lit(a ** (n - 1 - p))), F.lit(a))
    for i, others in enumerate(near):
        key = F.lit(0).cast("long")
        for p in (i, *others):
            key = key * a + code(p)
        total = total + F.get(F.get("tables", F.lit(i)), key.cast("int"))
    return rows.crossJoin(F.broadcast(draws)).select("node", "symbols", (total / n).alias("value"))


def rough_mount_fuji(spark: SparkSession, n: int, slope: float, sigma: float, *, seed: int = 0, optimum: int | None = None) -> DataFrame:
    """(node, symbols, value): -slope * distance to the optimum, plus normal noise."""
    top = (1 << n) - 1 if optimum is None else optimum
    rows = sequences(spark, n, (0, 1))
    u = [(F.pmod(F.xxhash64("node", F.lit(seed), F.lit(s)), F.lit(1 << 40)) + 0.5) / float(1 << 40) for s in (1, 2)]
    noise = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * float(np.pi) * u[1])
    return rows.select("node", "symbols", (-slope * F.bit_count(F.col("node").bitwiseXOR(F.lit(top).cast("long"))) + sigma * noise).alias("value"))


def elementary(spark: SparkSession, n: int, j: int) -> DataFrame:
    """(node, symbols, value): the cube's j-th Laplacian eigenvector by ascending eigenvalue, which
    is a Walsh function: the parity of the sites of the j-th mask by size, then by name."""
    mask = sorted(range(1 << n), key=lambda m: (m.bit_count(), m))[j]
    rows = sequences(spark, n, (0, 1))
    sign = 1 - 2 * F.pmod(F.bit_count(F.col("node").bitwiseAND(F.lit(mask).cast("long"))), F.lit(2))
    return rows.select("node", "symbols", (sign / 2 ** (n / 2)).alias("value"))


def code_of(symbols: Column) -> Column:
    return from_bits(F.transform(symbols, lambda s: s.cast("long")))


def subsamples(nodes: DataFrame, edges: DataFrame, n: int, *, nodes_share: float = 0.9, edges_share: float = 0.9, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, node, value) and (sample, u, v, weight): independent draws of nodes and of edges
    between kept nodes, by hashes, so that any task can be repeated."""

    def drawn(share: float, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))

    ids = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample")
    kept = nodes.select("*", ids).where(drawn(nodes_share, "node", "sample"))
    e = edges.select("*", ids).where(drawn(edges_share, "u", "v", "sample"))
    names = kept.select("sample", "node")
    e = e.join(names.withColumnRenamed("node", "u"), ["sample", "u"], "left_semi").join(names.withColumnRenamed("node", "v"), ["sample", "v"], "left_semi")
    return kept, e
