"""Near-duplicate grouping by SuperMinHash signatures.

A document's set holds the distinct k-word shingles of its lower-cased words, as 64-bit hashes.
Each shingle draws a random permutation of the signature's slots and sends its j-th draw, of value
j + r, to its j-th slot: the ranks of one shingle are correlated, which lowers the signature's
variance, and once every slot holds a value below j + 1 no later draw can change it. Bands of slots
give buckets; candidates are confirmed on full sets and linked ones grouped by union-find, first
within a partition and then by star contraction between partitions.

Documents of equal sets are one node. In a bucket all nodes are held to its smallest first; then
only nodes that are still in different groups, whose sizes and distances to that smallest node
leave a link possible, are held to each other. So groups of copies never make all their pairs, and
no link between candidates is lost. The bands are chosen so that a pair at the threshold misses
every bucket with a probability of at most 1e-6.

Defined results: a null or empty text has an empty set, linked with nothing, of which the component
is its own doc_id; a text of fewer than k words has its whole sequence as its one shingle; rows
that repeat a doc_id share its component; null doc_ids are linked but never name a component; an
empty table gives an empty result; other columns are ignored and kept by ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, small_batches, texts

SLOTS, MISS = 192, 1e-6
#: Elements whose permutations are held at once.
ELEMENTS = 1 << 15
#: Ids that may be broadcast to pick the texts of candidates; beyond, they are joined by a shuffle.
BROADCAST_IDS = 4_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbers(dict):
    """Gives each new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_hashes(data: list[str]) -> list[np.ndarray]:
    """The hashes of each text's words, A-Z in lower case, in order."""
    numbers = _Numbers()
    number = numbers.__getitem__
    split = [t.encode().lower().split() for t in data]
    at = [np.fromiter(map(number, ws), np.int64, len(ws)) for ws in split]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
    return [hashes[i] for i in at]


def shingle_sequences(data: list[str], k: int) -> list[np.ndarray]:
    """The hashes of each text's k consecutive words, in order; none of texts with fewer words."""
    words, out, at = word_hashes(data), [], 0
    whole = _shingles(np.concatenate([*words, np.zeros(0, np.uint64)]), k)
    for h in words:
        out.append(whole[at : at + max(0, len(h) - k + 1)])
        at += len(h)
    return out


def shingle_sets(data: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, out, at = word_hashes(data), [], 0
    whole = _shingles(np.concatenate([*words, np.zeros(0, np.uint64)]), k)
    for h in words:
        n = len(h)
        x = np.sort(whole[at : at + n - k + 1] if n >= k else _shingles(h, max(1, n)))
        out.append(x[np.r_[True, x[1:] != x[:-1]]] if n else x)
        at += n
    return out


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(h) - width + 1)
    x = np.full(n, width, np.uint64)
    for i in range(width if n else 0):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return x


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """(sets, slots) signatures: value j << 32 | r of the least draw that each slot received."""
    out = np.full((len(sets), slots), EMPTY, np.uint64)
    lo = 0
    while lo < len(sets):
        hi, size = lo + 1, len(sets[lo])
        while hi < len(sets) and size + len(sets[hi]) <= ELEMENTS:
            size += len(sets[hi])
            hi += 1
        if size <= ELEMENTS:
            out[lo:hi] = _signatures(sets[lo:hi], slots)
        else:  # one long set: the least of its parts
            out[lo] = np.minimum.reduce([_signatures([sets[lo][i : i + ELEMENTS]], slots)[0] for i in range(0, size, ELEMENTS)])
        lo = hi
    return out


def _signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full(len(sets) * slots, EMPTY, np.uint64)
    order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(flat), 1))
    for j in range(slots):
        if not len(flat):
            break
        draw = _mix(flat + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        other = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(flat))
        slot = order[row, other]
        order[row, other] = order[:, j]  # the swap; place j itself is never read again
        np.minimum.at(out, owner * slots + slot, np.uint64(j << 32) | (draw >> np.uint64(32)))
        open_ = (out.reshape(-1, slots) == EMPTY).any(1)
        live = open_[owner]
        if not live.all():
            flat, owner, order = flat[live], owner[live], order[live]
    return out.reshape(-1, slots)


def band_rows(threshold: float, slots: int = SLOTS) -> int:
    """Slots of a band: as many as keep the chance to miss a pair at the threshold under MISS."""
    return max(r for r in range(1, 33) if r == 1 or (1 - threshold**r) ** (slots // r) <= MISS)


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) hashes, those of different bands apart."""
    n = signatures.shape[1] // rows
    parts = signatures[:, : n * rows].reshape(len(signatures), n, rows)
    x = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return x.astype(np.int64)


def _node(s: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(s.tobytes(), len(s))
    return h - (1 << 64) if h >= 1 << 63 else h


def signed(rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """(doc_id, node, n, bands): a document's set by its hash and size, and its band hashes. Columns
    of ``rows`` after the text follow."""
    id_type, width = rows.schema["doc_id"].dataType.simpleString(), band_rows(threshold)
    others = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            found: list = [None] * len(sets)
            some = [i for i, s in enumerate(sets) if len(s)]
            for i, b in zip(some, bands(superminhash([sets[i] for i in some]), width) if some else ()):
                found[i] = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_node(s) for s in sets], pa.int64()), pa.array(n), pa.array(found, pa.list_(pa.int64())), *batch.columns[2:]], ["doc_id", "node", "n", "bands", *others])

    return rows.mapInArrow(run, ", ".join([f"doc_id {id_type}, node long, n long, bands array<long>", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)]))


def _sets_of(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set): the packed sets of the nodes (node, rep) in ``wanted``."""
    ids = wanted.select(F.col("rep").alias("id")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    picked = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "set"])

    return picked.select("text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def confirmed(rows: DataFrame, pairs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(a, b, shared, either): the sizes of intersection and union, from full sets."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets_of(rows, cut(reps.join(ends, "node", "left_semi").select("node", "rep")), k)
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, either = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                either.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(either, pa.int64())], ["a", "b", "shared", "either"])

    # The sets' partitions are many and what they leave is little: brought together, it is a few files.
    return cut(both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, shared long, either long").repartition("a"))


def _local_forest(edges: DataFrame) -> DataFrame:
    """Union-find within each partition: every node it met, with the least node it is joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        out = [(x, root(x)) for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches, by large-star and
    small-star rounds over the forests of the partitions, until no edge changes."""
    now, last = cut(_local_forest(edges.select("a", "b")).repartition("u")), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = cut(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state


def _grouped(rows: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``signed`` of the rows; (node, rep, root) of every node that is not empty; (node, root) of
    those that are linked."""
    small_batches(rows.sparkSession)
    per_mille = round(threshold * 1000)
    every = cut(signed(rows, k, threshold))
    reps = cut(every.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    held = reps.select("node", "n", F.explode("bands").alias("band"))
    tops = held.groupBy("band").agg(F.min(F.struct("node", "n")).alias("top"), F.count("*").alias("c")).where("c > 1").select("band", F.col("top.node").alias("a"), F.col("top.n").alias("n_a"))
    near = lambda x, y: F.lit(1000) * F.least(x, y) >= F.lit(per_mille) * F.greatest(x, y)
    shared = cut(held.join(tops, "band").select("band", "node", "n", "a", "n_a"))
    stars = cut(shared.where((F.col("node") != F.col("a")) & near(F.col("n"), F.col("n_a"))).select("a", F.col("node").alias("b")).distinct())
    linked = F.lit(1000) * F.col("shared") >= F.lit(per_mille) * F.col("either")
    first = confirmed(rows, stars, reps, k)
    links = first.where(linked).select("a", "b")
    roots = components(links)
    # What a bucket's smallest node did not join: pairs across groups that may still be linked.
    far = first.select("a", F.col("b").alias("node"), (1 - F.col("shared") / F.col("either")).alias("far"))
    left = shared.join(roots, "node", "left").join(far, ["a", "node"], "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"), F.when(F.col("node") == F.col("a"), 0.0).otherwise(F.col("far")).alias("far"))
    mixed = left.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo != hi and c > 2").select("band")
    left = cut(left.join(mixed, "band", "left_semi"))
    other = left.select("band", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "root", "far")))
    apart = F.coalesce(F.abs(F.col("far") - F.col("far_b")) <= F.lit(1 - threshold + 1e-9), F.lit(True))
    more = left.join(other, "band").where((F.col("node") < F.col("node_b")) & (F.col("root") != F.col("root_b")) & near(F.col("n"), F.col("n_b")) & apart)
    more = cut(more.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"))
    if more.head(1):
        again = confirmed(rows, more, reps, k).where(linked).select("a", "b")
        if again.head(1):
            roots = components(links.union(again))
    return every, reps.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), roots


def near_components(docs: DataFrame, *, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    every, named, roots = _grouped(texts(docs), k, threshold)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    grouped = named.join(roots.select("root").distinct(), "root", "left_semi").join(least, "root").select("node", "component_id")
    alone = named.join(roots.select("root").distinct(), "root", "left_anti").select("node", F.col("rep").alias("component_id"))
    sets = every.where("n > 0").select("doc_id", "node", "n").join(grouped.union(alone), "node").select("doc_id", "n", "component_id")
    bare = every.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return sets.union(bare).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, *, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: one row of each group. A row is told by its
    doc_id and its text, as ids may be null or repeat; the least stays, null ids last."""
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    every, named, _ = _grouped(texts(docs).withColumn("h", F.xxhash64("text")), k, threshold)
    told = every.where("n > 0").groupBy("node", "doc_id", "h").agg(F.count("*").alias("m"))
    told = cut(told.join(named.select("node", "root"), "node").select("root", "doc_id", "h", "m"))
    least = told.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "h")).alias("stays"), F.sum("m").alias("c")).where("c > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("h") == F.col("stays.h"))
    judged = cut(told.join(least, "root").where(~stays | (F.col("m") > 1)).select(F.col("doc_id").alias("judged_id"), F.col("h").alias("judged_h"), stays.alias("stays")))

    def met(some: DataFrame, how: str) -> DataFrame:
        some = F.broadcast(some) if some.count() <= BROADCAST_IDS else some
        return docs.join(some, docs["doc_id"].eqNullSafe(some["judged_id"]) & (key == some["judged_h"]), how)

    kept = met(judged.drop("stays"), "left_anti")
    repeated = judged.where("stays").drop("stays")  # one of the equal rows
    return kept.union(met(repeated, "left_semi").withColumn("judged_h", key).dropDuplicates(["doc_id", "judged_h"]).drop("judged_h")) if repeated.head(1) else kept
