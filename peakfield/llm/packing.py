"""Hierarchical packing of documents into context windows of several lengths.

A document's ids fill whole windows first; the rest is routed to a tier by its length (half a
window or more, a quarter, ...). Each window opens with the longest piece waiting and its gap is
filled from the tiers below, longest fitting piece first; what still lacks is cut from a longer
one. What is left of a partition, under one window, goes to shorter windows of powers of two, so
that no sequence needs padding. Windows made together are dealt into step groups of like cost.

Defined results: null text counts as empty and gives the closing id alone; repeated rows are
packed each; an empty table gives an empty result. Partitions are packed apart in bounded memory,
so a lost executor repeats its own partitions only and a hot source changes nothing.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._common import small_batches, texts
from .bpe import PATTERN, coder

#: Texts beyond this many characters are encoded by numpy rounds, which need no deep regex stack.
LONG_CHARS = 200_000
#: Sequences of one training step, dealt so that the steps' attention costs are alike.
STEP_SEQUENCES = 8


@lru_cache(2)
def _encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary file's encoder; its ids stand in merge order, so they serve as ranks."""
    bpe = coder(path)
    tokens = [bpe.pieces[a : a + n].tobytes() for a, n in zip(bpe.piece_at, bpe.piece_len)]
    special = set(bpe.specials.values())
    ranks = {t: i for i, t in enumerate(tokens) if i not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=bpe.specials)


def encode(text: str, path: str) -> np.ndarray:
    if len(text) > LONG_CHARS:
        return coder(path).encode([text])[0].astype("<u4")
    return _encoder(path).encode_to_numpy(text, allowed_special="all").astype("<u4")


class Packer:
    """Packs pieces (owner, start, length) into windows; keeps under one window between calls."""

    def __init__(self, window: int) -> None:
        assert window > 0 and window & (window - 1) == 0, "window: a power of two"
        self.window, self.tiers, self.waiting = window, [[] for _ in range(window.bit_length())], 0

    def _route(self, piece: tuple) -> None:
        insort(self.tiers[piece[2].bit_length() - 1], piece, key=lambda p: p[2])
        self.waiting += piece[2]

    def add(self, owner: object, length: int) -> Iterator[list[tuple]]:
        """The whole windows of a document; its rest waits in a tier."""
        whole = length // self.window * self.window
        for at in range(0, whole, self.window):
            yield [(owner, at, self.window)]
        if length > whole:
            self._route((owner, whole, length - whole))

    def _take(self, gap: int) -> tuple:
        """The longest waiting piece of at most ``gap`` ids, or else the head of a longer one."""
        top = gap.bit_length() - 1
        fits = self.tiers[top]
        lo, hi = 0, len(fits)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if fits[mid][2] <= gap else (lo, mid)
        if lo:
            piece = fits.pop(lo - 1)
        else:
            below = next((t for t in range(top - 1, -1, -1) if self.tiers[t]), None)
            above = next(t for t in range(top, len(self.tiers)) if self.tiers[t]) if below is None else below
            piece = self.tiers[above].pop(-1 if below is not None else 0)
        self.waiting -= piece[2]
        if piece[2] > gap:
            self._route((piece[0], piece[1] + gap, piece[2] - gap))
            piece = (piece[0], piece[1], gap)
        return piece

    def fill(self, length: int) -> list[tuple]:
        """One sequence of exactly ``length`` of the waiting ids."""
        pieces, gap = [], length
        while gap:
            pieces.append(self._take(gap))
            gap -= pieces[-1][2]
        return pieces

    def windows(self) -> Iterator[list[tuple]]:
        while self.waiting >= self.window:
            yield self.fill(self.window)

    def rest(self) -> Iterator[list[tuple]]:
        """Whatever waits, in windows of powers of two: longest first, none padded."""
        while self.waiting:
            yield self.fill(min(self.window, 1 << (self.waiting.bit_length() - 1)))


def step_groups(costs: list[int], size: int = STEP_SEQUENCES) -> list[int]:
    """A group for each sequence: dealt to and fro by falling cost, so that group sums are alike."""
    groups = max(1, -(-len(costs) // size))
    out = [0] * len(costs)
    for k, i in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        turn, at = divmod(k, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


def pack(docs: DataFrame, path: str, *, window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    step_group, and the piece's ids if asked for."""
    small_batches(docs.sparkSession)
    wanted = texts(docs)
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(window), TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}  # documents with ids still waiting: (doc_id, ids, ids left)
        made = groups = 0

        def rows(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal made, groups
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "step_group", "ids")}
            dealt = step_groups([sum(n * n for _, _, n in s) for s in sequences])
            for sequence, group in zip(sequences, dealt):
                offset = 0
                for owner, start, n in sequence:
                    doc_id, ids, left = held[owner]
                    piece = ids[start : start + n]
                    for k, v in zip(out, (doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), base + made, offset, base + groups + group, piece if with_ids else None)):
                        out[k].append(v)
                    offset += n
                    if left == n:
                        del held[owner]
                    else:
                        held[owner] = (doc_id, ids, left - n)
                made += 1
            groups += max(dealt, default=-1) + 1
            arrays = [pa.array(out[k], doc_type if k == "doc_id" else pa.int64()) for k in list(out)[:8]]
            names = list(out)[:8]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in out["ids"]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        owner, doc_type = 0, pa.int64()
        for batch in batches:
            doc_type, sequences = batch.column(0).type, []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text, path), np.uint32(end_id)).astype("<u4")
                held[owner] = (doc_id, ids, len(ids))
                sequences += packer.add(owner, len(ids))
                owner += 1
            sequences += packer.windows()
            if sequences:
                yield rows(sequences)
        if last := list(packer.rest()):
            yield rows(last)

    return wanted.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, step_group long" + ", ids array<int>" * with_ids)
