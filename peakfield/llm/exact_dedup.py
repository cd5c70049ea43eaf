"""Exact deduplication by two passes over a sharded Bloom filter.

Pass 1 reads a 64-bit fingerprint per text and builds, for each range of fingerprints, a filter
of those met twice or more. Pass 2 probes it: a text that cannot be repeated passes straight
through, and only the others shuffle, to be grouped by SHA-256.

Defined results: a null text counts as empty and an empty text equals any other empty one; rows
that repeat a doc_id and a text are one group, of which one row stays; null doc_ids lose against
any other and equal each other; an empty table gives an empty result; other columns are ignored
by the digest and kept as they are by ``exact_dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, texts

#: Texts a shard is made for, filter bits for each, and the filter bytes that may be broadcast
#: (past that, every fingerprint row shuffles instead: exact, but nothing passes straight through).
SHARD_TEXTS = 1 << 20
BITS_PER_TEXT = 16
BROADCAST_BYTES = 256 << 20
#: At most this many groups can hold 1/HOT_GROUPS of all rows; they are joined by broadcast.
HOT_GROUPS = 1000


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = h.view(np.uint64)
    a = (x >> np.uint64(20)) & np.uint64(bits - 1)
    y = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    b = (y >> np.uint64(31)) & np.uint64(bits - 1)
    return a.astype(np.int64), b.astype(np.int64)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    x = h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def repeat_filter(fingerprints: DataFrame, shards: int, bits: int) -> DataFrame:
    """(shard, bits): a Bloom filter of the fingerprints (column h) that may occur twice or more.

    Equal fingerprints of a batch are one entry before the shuffle, so a hot one sends one entry
    a batch and a shard receives about SHARD_TEXTS entries, whatever the copies."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            where = _shard(h, shards)
            order = np.argsort(where, kind="stable")
            h, n, where = h[order], n[order], where[order]
            edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            ends = np.r_[edges[1:], len(where)]
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": where[edges],
                    "seen": [h[i:j].tobytes() for i, j in zip(edges, ends)],
                    "again": [h[i:j][n[i:j] > 1].tobytes() for i, j in zip(edges, ends)],
                }
            )

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seen, again = np.zeros(bits, bool), np.zeros(bits, bool)
        for one, two in zip(pdf["seen"], pdf["again"]):
            a, b = _positions(np.frombuffer(one, np.int64), bits)
            hit = seen[a] & seen[b]
            again[a[hit]] = again[b[hit]] = True
            seen[a] = seen[b] = True
            a, b = _positions(np.frombuffer(two, np.int64), bits)
            again[a] = again[b] = True
        return pd.DataFrame({"shard": [key[0]], "bits": [np.packbits(again, bitorder="little").tobytes()]})

    packed = fingerprints.select("h").mapInArrow(gather, "shard long, seen binary, again binary")
    return packed.groupBy("shard").applyInPandas(build, "shard long, bits binary")


def may_repeat(rows: DataFrame, text: Column) -> Column:
    """A predicate over ``rows``: False only where no other row has the same text."""
    spark, n = rows.sparkSession, rows.count()
    shards = max(1, math.ceil(n / SHARD_TEXTS))
    bits = 1 << max(10, math.ceil(math.log2(max(1, min(n, SHARD_TEXTS)) * BITS_PER_TEXT)))
    if shards * bits // 8 > BROADCAST_BYTES:
        return F.lit(True)
    found = repeat_filter(rows.select(F.xxhash64(text).alias("h")), shards, bits).collect()
    shared = spark.sparkContext.broadcast({r["shard"]: bytes(r["bits"]) for r in found})

    @F.pandas_udf(T.BooleanType())
    def probe(h: pd.Series) -> pd.Series:
        x, out = h.to_numpy(np.int64), np.zeros(len(h), bool)
        where, (a, b) = _shard(x, shards), _positions(x, bits)
        for s in np.unique(where):
            raw = np.frombuffer(shared.value.get(int(s), bytes(bits // 8)), np.uint8)
            m = where == s
            one, two = a[m], b[m]
            out[m] = (raw[one >> 3] >> (one & 7) & 1 & (raw[two >> 3] >> (two & 7))).astype(bool)
        return pd.Series(out)

    return probe(F.xxhash64(text))


def _groups(flagged: DataFrame, n: int) -> DataFrame:
    """(sha, doc_id, copies, keep_id, group_size) of rows (sha, doc_id)."""
    each = cut(flagged.groupBy("sha", "doc_id").agg(F.count("*").alias("copies")))
    tops = each.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    least = max(1000, n // HOT_GROUPS)
    hot, cold = tops.where(F.col("group_size") >= least), tops.where(F.col("group_size") < least)
    return (
        each.join(F.broadcast(hot), "sha")
        .unionByName(each.join(F.broadcast(hot), "sha", "left_anti").join(cold, "sha"))
    )


def exact_dedup_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = texts(docs)
    marked = rows.select("doc_id", F.sha2("text", 256).alias("sha"), may_repeat(rows, F.col("text")).alias("again"))
    groups = _groups(marked.where("again").select("sha", "doc_id"), rows.count())
    copies = groups.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    repeated = copies.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = marked.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(repeated)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept: of equal texts, the largest doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    again, row = may_repeat(docs, text), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    marked = docs.select(row, F.sha2(text, 256).alias("sha"), again.alias("again"))
    groups = _groups(marked.where("again").select("sha", F.col("row.doc_id").alias("doc_id")), docs.count())
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("sha").alias("s"), F.col("doc_id").alias("d"))
    once = marked.where("again").join(stay, (F.col("sha") == F.col("s")) & F.col("row.doc_id").eqNullSafe(F.col("d")), "left_semi")
    once = once.withColumn("id", F.col("row.doc_id")).dropDuplicates(["sha", "id"])
    return marked.where("not again").select("row.*").unionByName(once.select("row.*"))
