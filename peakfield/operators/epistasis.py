"""Epistasis: Walsh coefficients, empirical Moebius effects and effect-coded regression."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube_check(nodes: DataFrame, length: int) -> DataFrame:
    """One row: whether nodes(code) are all 2**length codes, each once."""
    n = 1 << length
    return nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("code").alias("n_codes")).select("n_nodes", "n_codes", ((F.col("n_nodes") == n) & (F.col("n_codes") == n)).alias("complete"))


def walsh(nodes: DataFrame, length: int, order: int | None = None) -> DataFrame:
    """(mask, sites, degree, coefficient, orthonormal) of nodes(code, value) over the whole cube:
    mean of value times the parity of code and mask, by one butterfly join per bit, so that each of
    ``length`` shuffles carries 2**length rows instead of one join 4**length."""
    now = nodes.select(F.col("code").cast("long").alias("code"), F.col("value").cast("double").alias("x"))
    for p in range(length):
        bit = F.expr(f"shiftright(code, {p}) & 1")
        pair = now.groupBy(F.expr(f"code & ~{1 << p}L").alias("base")).agg(F.sum(F.when(bit == 0, F.col("x"))).alias("a"), F.sum(F.when(bit == 1, F.col("x"))).alias("b"))
        both = F.array(F.struct(F.col("base").alias("code"), (F.col("a") + F.col("b")).alias("x")), F.struct((F.col("base") + (1 << p)).alias("code"), (F.col("a") - F.col("b")).alias("x")))
        now = pair.select(F.inline(both))
    sites = F.array_join(F.filter(F.sequence(F.lit(0), F.lit(length - 1)), lambda s: F.call_function("shiftright", F.col("code"), F.lit(length - 1) - s).bitwiseAND(F.lit(1)) == 1), ",")
    out = now.select(F.col("code").alias("mask"), F.when(F.col("code") == 0, "intercept").otherwise(sites).alias("sites"), F.bit_count("code").cast("int").alias("degree"), (F.col("x") / (1 << length)).alias("coefficient"), (F.col("x") / 2 ** (length / 2)).alias("orthonormal"))
    return out if order is None else out.where(F.col("degree") <= order)


def walsh_by_order(spectrum: DataFrame) -> DataFrame:
    """(degree, power, share of the variance) from ``walsh``."""
    power = spectrum.where("degree > 0").groupBy("degree").agg(F.count("*").alias("n_terms"), F.sum(F.col("coefficient") * F.col("coefficient")).alias("power"))
    whole = power.agg(F.sum("power").alias("whole"))
    return power.crossJoin(whole).select("degree", "n_terms", "power", F.coalesce(F.col("power") / F.nullif("whole", F.lit(0.0)), F.lit(0.0)).alias("share"))


def epistasis_matrix(spectrum: DataFrame) -> DataFrame:
    """(i, j, strength): squared coefficients of order two."""
    s = F.split("sites", ",")
    return spectrum.where("degree = 2").select(s[0].cast("int").alias("i"), s[1].cast("int").alias("j"), (F.col("coefficient") * F.col("coefficient")).alias("strength"))


def moebius(nodes: DataFrame, length: int, order: int) -> DataFrame:
    """(sites, n, effect): empirical marginal effects of nodes(symbols, value) through ``order``:
    the mean over the rows that hold some alleles, less the effects of all smaller sets of them.
    Every set of places is one grouping set of a single pass; the shares of lower orders are taken
    off by joins."""
    if not 1 <= order <= length:
        raise ValueError("order: from 1 to the length")
    labels = F.array(*(F.concat(F.lit(f"{p}:"), F.get("symbols", F.lit(p))) for p in range(length)))
    sets = [c for n in range(order + 1) for c in combinations(range(length), n)]
    chosen = F.array(*(F.array(*(F.get("l", F.lit(p)) for p in c)).cast("array<string>") for c in sets))
    marginal = nodes.select(labels.alias("l"), "value").select(F.explode(chosen).alias("set"), "value").groupBy("set").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    done = marginal.where(F.size("set") == 0).select("set", "n", F.col("mean").alias("effect"))
    for size in range(1, order + 1):
        here = marginal.where(F.size("set") == size)
        subsets = F.filter(F.transform(F.sequence(F.lit(0), F.lit((1 << size) - 2)), lambda m: F.filter("set", lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1)), lambda s: F.size(s) < size)
        lower = here.select("set", F.explode(subsets).alias("part")).join(done.select(F.col("set").alias("part"), "effect"), "part").groupBy("set").agg(F.sum("effect").alias("lower"))
        done = done.union(here.join(lower, "set").select("set", "n", (F.col("mean") - F.col("lower")).alias("effect")))
    return done.select(F.when(F.size("set") == 0, "intercept").otherwise(F.array_join("set", ",")).alias("sites"), F.size("set").alias("degree"), "n", "effect")


def _design(length: int, order: int) -> tuple[list[str], list[Column]]:
    sets = [c for n in range(order + 1) for c in combinations(range(length), n)]
    names = ["intercept" if not c else "*".join(f"pos{p}" for p in c) for c in sets]
    columns = []
    for c in sets:
        x = F.lit(1.0)
        for p in c:
            x = x * (1.0 - 2.0 * F.get("bits", F.lit(p)).cast("double"))
        columns.append(x)
    return names, columns


def regression(nodes: DataFrame, length: int, order: int, *, l1: float = 0.0, l2: float = 0.0) -> DataFrame:
    """(term, coefficient) of nodes(bits, value) on products of z = 1 - 2 * bit, and r2 in each row.
    Spark sums the normal equations, whose size is that of the model; they are solved on the driver:
    least squares, or RSS / (2 n) + l1 |w| + l2 / 2 |w|^2 over all but the intercept."""
    names, columns = _design(length, order)
    k = len(names)
    terms = nodes.select(F.array(*columns).alias("x"), F.col("value").cast("double").alias("y"))
    pairs = [F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i in range(k) for j in range(i, k)]
    found = terms.agg(F.array(*pairs).alias("xx"), F.array(*(F.sum(F.get("x", F.lit(i)) * F.col("y")) for i in range(k))).alias("xy"), F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("yy")).first()
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = found["xx"]
    gram = np.triu(gram) + np.triu(gram, 1).T
    xy, n = np.array(found["xy"]), found["n"]
    w = _solve(gram / n, xy / n, l1, l2)
    rss, total = found["yy"] - 2 * w @ xy + w @ gram @ w, found["yy"] - found["s"] ** 2 / n
    r2 = 1 - rss / total if total > 0 else float("nan")
    return nodes.sparkSession.createDataFrame(pd.DataFrame({"term": names, "coefficient": w, "r2": r2}))


def _solve(gram: np.ndarray, xy: np.ndarray, l1: float, l2: float) -> np.ndarray:
    k = len(xy)
    if not l1:
        if not l2 and np.linalg.matrix_rank(gram) < k:
            raise ValueError("the design has not full rank; ask for a penalty")
        return np.linalg.solve(gram + l2 * np.diag([0.0] + [1.0] * (k - 1)), xy)
    w = np.zeros(k)
    for _ in range(100_000):  # coordinate descent
        old = w.copy()
        for i in range(k):
            r = xy[i] - gram[i] @ w + gram[i, i] * w[i]
            w[i] = r / gram[i, i] if i == 0 else np.sign(r) * max(abs(r) - l1, 0) / (gram[i, i] + l2)
        if np.abs(w - old).max() < 1e-12 * max(1, np.abs(w).max()):
            break
    return w
