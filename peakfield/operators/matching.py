"""Comparison of graphs and labelings: rankings, clusterings, alignment, transport, embedding."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways, cut

#: Nodes that the dense methods take, on the driver or in one task.
DENSE_NODES = 5000


def cluster_scores(labels: DataFrame) -> DataFrame:
    """One row: adjusted Rand index, mutual information and its normal form of labels(a, b)."""
    table = labels.groupBy("a", "b").agg(F.count("*").alias("n"))
    rows, columns = table.groupBy("a").agg(F.sum("n").alias("ra")), table.groupBy("b").agg(F.sum("n").alias("cb"))
    n = labels.count()
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    plogp = lambda c: -F.sum(F.col(c) / n * F.log(F.col(c) / n))
    r, c = rows.agg(pairs("ra").alias("pa"), plogp("ra").alias("ha")), columns.agg(pairs("cb").alias("pb"), plogp("cb").alias("hb"))
    both = table.join(rows, "a").join(columns, "b").agg(pairs("n").alias("pn"), F.sum(F.col("n") / n * F.log(F.col("n") * n / (F.col("ra") * F.col("cb")))).alias("mi"))
    expected, top = F.col("pa") * F.col("pb") / max(1, n * (n - 1) / 2), (F.col("pa") + F.col("pb")) / 2
    one = both.crossJoin(r).crossJoin(c)
    ari = F.when(top == expected, 1.0).otherwise((F.col("pn") - expected) / F.nullif(top - expected, F.lit(0.0)))
    nmi = F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / F.nullif(F.col("ha") + F.col("hb"), F.lit(0.0)))
    return one.select(ari.alias("ari"), "mi", nmi.alias("nmi"))


def ranking_scores(pairs: DataFrame) -> DataFrame:
    """One row: average precision and area under the curve of pairs(score, label 0/1). Ties share a
    threshold; positions come from counts by score, so rows are not sorted in one task."""
    by = pairs.groupBy("score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score"))
    run = by.withColumn("tp", F.sum("pos").over(down)).withColumn("all", F.sum("n").over(down))
    total = pairs.agg(F.sum("label").alias("all_pos"), F.count("*").alias("all_rows"))
    x = run.crossJoin(total)
    neg = F.col("n") - F.col("pos")
    below = F.col("all_pos") - F.col("tp")  # positives that score less
    one = x.groupBy("all_pos", "all_rows").agg(F.sum(F.col("pos") / F.col("all_pos") * F.col("tp") / F.col("all")).alias("average_precision"), F.sum(neg * (F.col("all_pos") - below - F.col("pos") + F.col("pos") / 2)).alias("wins"))
    return one.select("average_precision", (F.col("wins") / (F.col("all_pos") * (F.col("all_rows") - F.col("all_pos")))).alias("roc_auc"))


def precision_at(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of a node's k best of truth(node, other, rank) among those found."""
    hits = truth.where(F.col("rank") <= k).select("node", "other").join(found.where(F.col("rank") <= k).select("node", "other"), ["node", "other"], "left_semi")
    per = truth.select("node").distinct().join(hits.groupBy("node").agg(F.count("*").alias("n")), "node", "left")
    return per.agg(F.avg(F.coalesce("n", F.lit(0)) / k).alias("precision"))


def spearman(rows: DataFrame, a: str, b: str) -> float:
    """Rank correlation, ties at their middle rank; ranks from counts by value."""

    def middle(c: str) -> DataFrame:
        by = rows.groupBy(c).agg(F.count("*").alias("n"))
        w = Window.orderBy(c)
        return by.select(c, (F.sum("n").over(w) - (F.col("n") - 1) / 2).alias(f"rank_{c}"))

    return rows.join(middle(a), a).join(middle(b), b).agg(F.corr(f"rank_{a}", f"rank_{b}")).first()[0]


def distance_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: root mean squared difference of two tables (source, node, length)."""
    both = a.join(b.select("source", "node", F.col("length").alias("other")), ["source", "node"]).where("source < node")
    return both.agg(F.sqrt(F.avg((F.col("length") - F.col("other")) * (F.col("length") - F.col("other")))).alias("rmse"), F.count("*").alias("n_pairs"))


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community) by synchronous label propagation: each round a node takes the label of the
    most weight around it and itself (of equals the least), until few change. A join and two sums a
    round, over any number of nodes."""
    links = cut(both_ways(edges.select("u", "v", "weight")).union(nodes.select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(1e-9).alias("weight"))))
    now = cut(nodes.select("node", F.col("node").alias("community")))
    for i in range(rounds):
        heard = links.join(now.withColumnRenamed("node", "v"), "v").groupBy("u", "community").agg(F.sum("weight").alias("w"))
        best = heard.groupBy(F.col("u").alias("node")).agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("new"))
        # Half of the nodes move at a time: two sides of a bipartite graph would swap labels forever.
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        new = cut(now.join(best, "node").select("node", F.when(turn, F.col("new")).otherwise(F.col("community")).alias("community"), F.when(turn, F.col("new") != F.col("community")).otherwise(False).alias("moved")))
        moved, now = new.where("moved").limit(1).count(), new.drop("moved")
        if not moved and i:
            break
    return now


def modularity(communities_: DataFrame, edges: DataFrame, resolution: float = 1.0) -> float:
    both = both_ways(edges.select("u", "v", "weight"))
    two_m = both.agg(F.sum("weight")).first()[0]
    tagged = both.join(communities_.select(F.col("node").alias("u"), F.col("community").alias("x")), "u").join(communities_.select(F.col("node").alias("v"), F.col("community").alias("y")), "v")
    per = tagged.groupBy("x").agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("d"))
    return per.agg(F.sum(F.col("inside") / two_m - resolution * F.pow(F.col("d") / two_m, F.lit(2)))).first()[0]


def gapped_soft_score(p: np.ndarray, q: np.ndarray, scores: np.ndarray, gap: float = -2.0) -> float:
    """Sum over places of p' S q weighed by both not being gaps, and the gap score where one is."""
    gp, gq = p[:, -1], q[:, -1]
    inner = np.einsum("ia,ab,ib->i", p[:, :-1], scores, q[:, :-1])
    return float((inner * (1 - gp) * (1 - gq)).sum() + gap * (gp * (1 - gq) + gq * (1 - gp)).sum())


def isorank(a: np.ndarray, b: np.ndarray, fa: np.ndarray, fb: np.ndarray, *, alpha: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Similarities of two graphs' nodes: alpha * A' S B + (1 - alpha) * feature cosines."""
    if max(len(a), len(b)) > DENSE_NODES:
        raise MemoryError(f"more than {DENSE_NODES} nodes")

    def walk(w: np.ndarray) -> np.ndarray:
        d = w.sum(1, keepdims=True)
        return np.where(d > 0, w / np.where(d > 0, d, 1), 1 / len(w))

    unit = lambda f: f / (np.linalg.norm(f, axis=1, keepdims=True) + 1e-9)
    pa, pb, start = walk(a), walk(b), unit(fa) @ unit(fb).T
    s = start
    for _ in range(rounds):
        new = alpha * pa.T @ s @ pb + (1 - alpha) * start
        if np.linalg.norm(new - s) < tol:
            return new
        s = new
    return s


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of least total cost (shortest augmenting paths)."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            cur = c[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = cur < least[free]
            least[free[better]], back[free[better]] = cur[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[back[j0]], back[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def transport(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """The least cost of moving mass a to b, exactly: successive shortest paths."""
    a, b, total = np.array(a, float), np.array(b, float), 0.0
    if not math.isclose(a.sum(), b.sum(), rel_tol=1e-9):
        raise ValueError("unequal masses")
    n, m = cost.shape
    flow, left, need = np.zeros((n, m)), a.copy(), b.copy()
    while left.sum() > 1e-12 * a.sum():
        dist, back = np.r_[np.where(left > 1e-15, 0.0, np.inf), np.full(m, np.inf)], np.full(n + m, -1)
        for _ in range(n + m):
            old = dist.copy()
            via = dist[:n, None] + cost
            best = via.argmin(0)
            low = via[best, np.arange(m)] < dist[n:] - 1e-13
            dist[n:][low], back[n:][low] = via[best[low], np.flatnonzero(low)], best[low]
            via = np.where(flow > 1e-15, dist[None, n:] - cost, np.inf)
            best = via.argmin(1)
            low = via[np.arange(n), best] < dist[:n] - 1e-13
            dist[:n][low], back[:n][low] = via[np.flatnonzero(low), best[low]], n + best[low]
            if np.array_equal(old, dist):
                break
        end = n + int(np.where(need > 1e-15, dist[n:], np.inf).argmin())
        path, x = [], end
        while back[x] >= 0:
            path.append((back[x], x))
            x = back[x]
        push = min(left[x], need[end - n], *(flow[q, p - n] for p, q in path if p >= n))
        for p, q in path:
            if p < n:
                flow[p, q - n] += push
            else:
                flow[q, p - n] -= push
        left[x] -= push
        need[end - n] -= push
    return float((flow * cost).sum())


def landmark_mds(d: np.ndarray, dims: int = 2, landmarks: int = 200) -> np.ndarray:
    """Places whose distances resemble ``d``: classical scaling of landmarks, then trilateration."""
    p = np.arange(min(landmarks, len(d)))
    sq = d[np.ix_(p, p)] ** 2
    j = np.eye(len(p)) - 1 / len(p)
    values, vectors = np.linalg.eigh(-0.5 * j @ sq @ j)
    top = np.argsort(values)[::-1][:dims]
    w = np.sqrt(np.maximum(values[top], 1e-12))
    return -0.5 * (d[:, p] ** 2 - sq.mean(0)) @ (vectors[:, top] / w)


def smacof(pairs: np.ndarray, target: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 200, tol: float = 1e-6) -> np.ndarray:
    """Places of least stress over some pairs, by majorisation."""
    x, n = np.array(start, float), len(start)
    i, j = pairs[:, 0], pairs[:, 1]
    v = np.zeros((n, n))
    np.add.at(v, (i, j), -weight)
    np.add.at(v, (j, i), -weight)
    v -= np.diag(v.sum(1))
    inverse, last = np.linalg.pinv(v, rcond=1e-10, hermitian=True), np.inf
    for _ in range(rounds):
        gap = x[i] - x[j]
        d = np.maximum(np.linalg.norm(gap, axis=1), 1e-12)
        stress = float((weight * (d - target) ** 2).sum())
        if last - stress < tol * max(last, 1e-12):
            break
        last, pull = stress, (weight * target / d)[:, None] * gap
        b = np.zeros_like(x)
        np.add.at(b, i, pull)
        np.add.at(b, j, -pull)
        x = inverse @ b
    return x


def average_linkage(d: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(cluster, cluster, height, size) of each merge; a new cluster is numbered after the last."""
    n, d = len(d), np.array(d, float)
    live, size, out = list(range(n)), [1] * n, []
    names = list(range(n))
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        np.fill_diagonal(sub, np.inf)
        a, b = sorted(np.unravel_index(int(sub.argmin()), sub.shape))
        i, j = live[a], live[b]
        out.append((names[i], names[j], float(sub[a, b]), size[i] + size[j]))
        mixed = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = mixed, mixed
        size[i], names[i] = size[i] + size[j], n + len(out) - 1
        live.pop(b)
    return out
