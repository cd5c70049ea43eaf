"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The symbols are all 256 bytes (A-Z in lower case) and the end of a text. A trie of contexts of up
to five symbols holds the counts of all training texts, each context by itself: it grows with the
corpus, in parts by a context's last two symbols, as sorted files of the shared folder that the
workers map. A context escapes by method D (half the distinct symbols of the total) to the next
shorter one, whose seen symbols are excluded and the rest scaled up. The pretrained code length of
a text is the sum over its bytes and its end.

``adaptive_bits`` is the same model learnt while it reads one text, without training.

Tokens are told apart by 64 bits of their hashes. Their counts are broadcast, or mapped from sorted
files of the shared folder where they are many; no text's words are shuffled to meet them.

Defined results: a null text counts as empty and has the closing token alone; rows that repeat are
scored each and counted each; a null doc_id hashes as empty text; an empty training set leaves the
model uniform; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, shared_dir, small_batches, texts

#: The end of a text and 256 bytes.
SYMBOLS, ORDER, BITS = 257, 5, 9
#: The symbol of bytes outside the alphabet, of which there are none.
OTHER = -1
#: Contexts up to this length are held whole; the longer ones lie in parts by their last symbols.
TOP = 2
#: Bytes of training text that one part of the trie is made for, and leaves that a task holds.
PART_BYTES, TASK_LEAVES = 64 << 20, 1 << 22
#: Bytes of text that are turned into arrays at once.
CHUNK = 1 << 19
DISCOUNT = 0.5
#: Bytes of the token table that may be broadcast; beyond, it lies in files of the shared folder, of
#: about so many tokens each.
TOKEN_TABLE_BYTES, FILE_TOKENS = 96 << 20, 1 << 22


def is_held_out(doc_id: object, mod: int = 7, held: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod == held


def alphabet(counts: dict[int, int] | None = None) -> np.ndarray:
    """Each byte's symbol, from 1, whatever its count. 0 ends a text."""
    return np.arange(1, SYMBOLS, dtype=np.uint16)


def positions(data: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol of the texts and their ends: the text, the five symbols before it as one
    number (zeros before the start), and the symbol."""
    pad, end = bytes(ORDER), b"\0"
    raw = np.frombuffer(b"".join(x for d in data for x in (pad, d, end)), np.uint8)
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + ORDER + 1
    ends = np.cumsum(sizes)
    s = code[raw].astype(np.int64)
    own = np.ones(len(s), bool)
    for k in range(ORDER):
        own[ends - sizes + k] = False
        s[ends - sizes + k] = 0
    s[ends - 1] = 0
    before = np.zeros(len(s), np.int64)
    for k in range(ORDER, 0, -1):
        before[k:] += s[:-k] << (BITS * (k - 1))
    return np.repeat(np.arange(len(data)), sizes - ORDER), before[own], s[own]


def pieces(data: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes, one text at least."""
    lo = size = 0
    for i, d in enumerate(data):
        size += len(d)
        if size >= CHUNK or i == len(data) - 1:
            yield lo, i + 1
            lo, size = i + 1, 0


def cut_to(leaf: np.ndarray, order: int) -> np.ndarray:
    """A leaf (context << BITS | symbol) with the last ``order`` symbols of its context."""
    return leaf & ((1 << BITS * (order + 1)) - 1)


def part_of(leaf: np.ndarray, parts: int) -> np.ndarray:
    """The part of a leaf: by the last TOP symbols of its context, so that a part holds all that
    extends these."""
    last = (cut_to(leaf, TOP) >> BITS).astype(np.uint64)
    return ((last * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def blend(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities (contexts, symbols) from counts and those of the shorter contexts."""
    seen, total = counts > 0, counts.sum(1, keepdims=True)
    escape = np.where(total > 0, DISCOUNT * seen.sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
    rest = np.maximum(1 - np.where(seen, below, 0).sum(1, keepdims=True), 1e-9)
    return np.where(seen, (counts - DISCOUNT) / np.maximum(total, 1), escape * below / rest)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each one's place in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


#: Of a level: leaves and the P of each in its context; contexts, and what each multiplies the P of
#: the shorter one by for symbols that it has not seen.
Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def levels(leaf: np.ndarray, n: np.ndarray, orders: range) -> dict[int, Level]:
    """The levels of ``orders`` from the counts of their longest contexts. What a context has seen
    every shorter one has seen too, so that exclusion needs no more than the level below."""
    out: dict[int, Level] = {}
    for k in range(orders[0] - 1, orders[-1] + 1):
        keys, counts = _summed(cut_to(leaf, k), n) if k >= 0 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        first = np.flatnonzero(np.r_[True, keys[1:] >> BITS != keys[:-1] >> BITS]) if len(keys) else np.zeros(0, np.int64)
        kinds = np.diff(np.r_[first, len(keys)])
        total = np.add.reduceat(counts, first).astype(float) if len(keys) else np.zeros(0)
        p = (counts - DISCOUNT) / np.repeat(total, kinds)
        if k >= orders[0] and len(keys):
            below = last[1][np.searchsorted(last[0], cut_to(keys, k - 1))] if k else np.full(len(keys), 1 / SYMBOLS)
            rest = np.maximum(1 - np.add.reduceat(below, first), 1e-9)
            out[k] = keys, p.astype(np.float32), keys[first] >> BITS, (DISCOUNT * kinds / total / rest).astype(np.float32)
        elif k >= orders[0]:
            out[k] = keys, p.astype(np.float32), keys, p.astype(np.float32)
        last = keys, p
    return out


class Trie:
    """The trained model, as a worker holds it: contexts up to TOP symbols, and the parts of the
    longer ones, from ``blocks`` or mapped from the files of ``folder``."""

    def __init__(self, code: np.ndarray, blocks: list[tuple[int, int, bytes]], folder: str | None = None, parts: int | None = None) -> None:
        top = [_unpack(x) for level, _, x in blocks if level == TOP]
        self.code, self.folder = code, folder
        self.parts = {block: levels(*_unpack(x), range(TOP + 1, ORDER + 1)) for level, block, x in blocks if level == ORDER}
        self.n_parts = parts or 1 + max((block for _, block, _ in blocks), default=0)
        self.top = levels(*_summed(*(np.concatenate([t[i] for t in top]) for i in (0, 1))), range(TOP + 1)) if top else {}
        self.other = 0.0

    def part(self, i: int) -> dict[int, Level]:
        if i not in self.parts:
            names = {k: [f"{self.folder}/{i}-{k}-{j}.npy" for j in range(4)] for k in range(TOP + 1, ORDER + 1)}
            there = self.folder is not None and os.path.exists(f"{self.folder}/{i}-{ORDER}-3.npy")
            self.parts[i] = {k: tuple(np.load(x, mmap_mode="r") for x in files) for k, files in names.items()} if there else {}
        return self.parts[i]

    def log10(self, data: list[bytes]) -> np.ndarray:
        """log10 P of each text and its end."""
        out = np.zeros(len(data))
        for lo, hi in pieces(data):
            text, before, s = positions(data[lo:hi], self.code)
            leaf, again = np.unique(before << BITS | s, return_inverse=True)
            bits = np.log10(np.maximum(self.probabilities(leaf), 1e-30))[again]
            out[lo:hi] = np.bincount(text, bits, hi - lo)
        return out

    def probabilities(self, leaf: np.ndarray) -> np.ndarray:
        """P of each leaf's symbol after its context."""
        out, where = np.empty(len(leaf)), part_of(leaf, self.n_parts)
        order = np.argsort(where, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            if not len(own):
                continue
            part = self.part(int(where[own[0]]))
            p, open_ = np.ones(len(own)), np.arange(len(own))
            for k in range(ORDER, -1, -1):
                level = (self.top if k <= TOP else part).get(k)
                if level is None:
                    continue
                wanted = cut_to(leaf[own[open_]], k)
                at, seen = find(level[0], wanted)
                p[open_[seen]] *= level[1][at[seen]]
                open_, wanted = open_[~seen], wanted[~seen]
                at, seen = find(level[2], wanted >> BITS)
                p[open_[seen]] *= level[3][at[seen]]
            p[open_] /= SYMBOLS
            out[own] = p
        return out

    @property
    def three(self) -> np.ndarray:
        """P of every symbol after each context of three that was seen."""
        seen = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[3][2] for x in map(self.part, range(self.n_parts)) if 3 in x)]))
        # No longer context starts with a symbol beyond the alphabet.
        unseen = np.int64(((1 << BITS) - 1 << BITS) | (1 << BITS) - 1) << BITS * 3
        return self.probabilities(((unseen | seen)[:, None] << BITS | np.arange(SYMBOLS)).reshape(-1)).reshape(-1, SYMBOLS)


class AdaptivePPM:
    """The same escapes and exclusions over raw bytes, learnt from what it has read so far."""

    def __init__(self, order: int = ORDER, size: int = 256) -> None:
        self.order, self.size, self.seen = order, size, defaultdict(lambda: np.zeros(size))

    def probabilities(self, before: tuple) -> np.ndarray:
        p = np.full((1, self.size), 1 / self.size)
        for n in range(min(self.order, len(before)) + 1):
            context = before[len(before) - n :]
            if context in self.seen:
                p = blend(self.seen[context][None], p)
        return p[0]

    def learn(self, before: tuple, symbol: int, times: int = 1) -> None:
        for n in range(min(self.order, len(before)) + 1):
            self.seen[before[len(before) - n :]][symbol] += times


def adaptive_bits(text: str) -> float:
    """Code length in bits of a text under a model that starts empty."""
    model, data, bits = AdaptivePPM(), tuple(text.encode()), 0.0
    for i, s in enumerate(data):
        before = data[max(0, i - model.order) : i]
        bits -= math.log2(max(model.probabilities(before)[s], 1e-30))
        model.learn(before, s)
    return bits


def _hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def _training(rows: DataFrame, mod: int, held: int) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return rows.where(F.crc32(doc.cast("binary")) % mod != held)


def token_counts(training: DataFrame) -> DataFrame:
    """(token, c) over all training texts; the closing token is the empty string."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.encode().lower().split())
            seen[b""] += batch.num_rows
            if len(seen) > 500_000:
                yield flush()
                seen = Counter()
        yield flush()

    return training.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")).where("c > 0")


def byte_counts(training: DataFrame) -> dict[int, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(text.encode().lower(), np.uint8), minlength=256)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])

    rows = training.select("text").mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    return {r["b"]: r["n"] for r in rows}


def _summed(leaf: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct leaves in order and their sums (of ones, if no ``n``)."""
    if n is None:
        leaf = np.sort(leaf)
    else:
        order = np.argsort(leaf, kind="stable")
        leaf, n = leaf[order], n[order]
    first = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else np.zeros(0, np.int64)
    return leaf[first], np.diff(np.r_[first, len(leaf)]) if n is None else np.add.reduceat(n, first) if len(n) else n


def _pack(leaf: np.ndarray, n: np.ndarray) -> bytes:
    return zlib.compress(np.diff(leaf, prepend=0).astype("<i8").tobytes() + n.astype("<i8").tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(packed), "<i8")
    return np.cumsum(raw[: len(raw) // 2]), raw[len(raw) // 2 :]


def trie_blocks(training: DataFrame, code: np.ndarray, parts: int = 1) -> DataFrame:
    """(level, block, packed): the counts of all contexts of ORDER symbols in the training texts, by
    parts, and for each part those of TOP symbols. Shorter contexts' are their sums. A task sums
    what it read before it sends one packed list a part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([a for a, _ in held]), np.concatenate([n for _, n in held]))

        def sent(leaf: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            where = part_of(leaf, parts)
            order = np.argsort(where, kind="stable")
            edges = np.flatnonzero(np.diff(where[order], prepend=-1))
            packed = [_pack(leaf[x], n[x]) for x in np.split(order, edges[1:])] if len(edges) else []
            return pa.RecordBatch.from_arrays([pa.array(where[order][edges]), pa.array(packed, pa.binary())], ["block", "packed"])

        for batch in batches:
            data = [t.encode().lower() for t in batch.column(0).to_pylist()]
            for lo, hi in pieces(data):
                _, before, s = positions(data[lo:hi], code)
                held.append(_summed(before << BITS | s))
                if len(held) >= 16:
                    held = [merged()]
                    if len(held[0][0]) > TASK_LEAVES:
                        yield sent(*held.pop())
        if held:
            yield sent(*merged())

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(x) for batch in batches for x in batch.column("packed").to_pylist()]
        leaf, n = _summed(np.concatenate([a for a, _ in held]), np.concatenate([n for _, n in held]))
        packed = [_pack(*_summed(cut_to(leaf, TOP), n)), _pack(leaf, n)]
        yield pa.RecordBatch.from_arrays([pa.array([TOP, ORDER]), pa.array([key[0].as_py()] * 2), pa.array(packed, pa.binary())], ["level", "block", "packed"])

    counted = training.select("text").mapInArrow(count, "block long, packed binary")
    return counted.groupBy("block").applyInArrow(build, "level long, block long, packed binary")


def store(blocks: DataFrame, folder: str) -> None:
    """Write the levels of each part to files of the shared folder, for the workers to map."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, level in levels(*_unpack(packed), range(TOP + 1, ORDER + 1)).items():
                    for j, x in enumerate(level):
                        name = f"{folder}/{block}-{k}-{j}"
                        with open(mine := f"{name}.{uuid.uuid4().hex}", "wb") as f:
                            np.save(f, x)
                        os.replace(mine, f"{name}.npy")  # a task that runs twice writes the same
            yield batch.select(["block"])

    blocks.where(F.col("level") == ORDER).select("block", "packed").mapInArrow(write, "block long").count()


def _local(folder: str) -> str:
    """The shared folder as a path, which every executor must have mounted."""
    url = urlsplit(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the trie's files need a mounted shared folder, not {folder}")
    return unquote(url.path) if url.scheme else folder


def store_tokens(tokens: DataFrame, folder: str, files: int) -> None:
    """Write the counts of tokens (t, c) to files of the shared folder by their hashes, sorted."""

    def write(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        held = [(batch.column("t").to_numpy(), batch.column("c").to_numpy()) for batch in batches]
        t, c = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(t)
        name = f"{folder}/tokens-{key[0].as_py()}"
        with open(mine := f"{name}.{uuid.uuid4().hex}", "wb") as f:
            np.save(f, np.stack([t[order], c[order]]))
        os.replace(mine, f"{name}.npy")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64())], ["file"])

    tokens.select("t", "c", F.pmod("t", F.lit(files).cast("long")).alias("file")).groupBy("file").applyInArrow(write, "file long").count()


def count_of(table: tuple[np.ndarray, np.ndarray], h: np.ndarray) -> np.ndarray:
    """The counts of token hashes (0: not there) in sorted hashes and their counts."""
    at, seen = find(table[0], h)
    out = np.zeros(len(h), np.int64)
    out[seen] = table[1][at[seen]]
    return out


def stored_count_of(folder: str, files: int, h: np.ndarray) -> np.ndarray:
    """As ``count_of``, from the files that ``store_tokens`` wrote, mapped and not read whole."""
    out, where = np.zeros(len(h), np.int64), h % files
    for i in np.unique(where).tolist():
        if os.path.exists(name := f"{folder}/tokens-{i}.npy"):
            out[where == i] = count_of(np.load(name, mmap_mode="r"), h[where == i])
    return out


_TRIES: dict[str, Trie] = {}


def _trie(name: str, model: Broadcast) -> Trie:
    """The model that was broadcast, unpacked once in each worker."""
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = Trie(*model.value)
    return _TRIES[name]


def score_digest(docs: DataFrame, *, mod: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram log10 with add-one
    smoothing), score (PPM log10 probability of the text and its end)."""
    small_batches(docs.sparkSession, 1000)
    rows = texts(docs)
    training = _training(rows, mod, held)
    tokens = cut(token_counts(training).select(F.xxhash64(F.col("token")).alias("t"), "token", "c"))
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size, name = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], uuid.uuid4().hex
    code = alphabet()
    parts = max(1, math.ceil(size / PART_BYTES))
    blocks, folder = cut(trie_blocks(training, code, parts)), f"{_local(shared_dir(docs.sparkSession))}/trie-{name}"
    store(blocks, folder)
    top = [(r["level"], r["block"], bytes(r["packed"])) for r in blocks.where(F.col("level") == TOP).collect()]
    model = docs.sparkSession.sparkContext.broadcast((code, top, folder, parts))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    small = v * 16 <= TOKEN_TABLE_BYTES
    files = max(1, math.ceil(v / FILE_TOKENS))
    if small:
        table = tokens.select("t", "c").toArrow()
        order = np.argsort(table["t"].to_numpy())
        known = docs.sparkSession.sparkContext.broadcast((table["t"].to_numpy()[order], table["c"].to_numpy()[order]))
    else:
        store_tokens(tokens, folder, files)
    floor = math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(name, model)
        for batch in batches:
            split = [t.encode().lower() for t in batch.column(1).to_pylist()]
            words = [[*data.split(), b""] for data in split]
            distinct = list({w for ws in words for w in ws})
            count, score = [len(ws) for ws in words], trie.log10(split).tolist()
            h = np.fromiter(map(_hash, distinct), np.int64, len(distinct))
            c = count_of(known.value, h) if small else stored_count_of(folder, files, h)
            seen = dict(zip(distinct, (c > 0).tolist()))
            cost = dict(zip(distinct, (np.log10(c + 1) - floor).tolist()))
            got = [sum(map(seen.__getitem__, ws)) for ws in words]
            base = [math.fsum(map(cost.__getitem__, ws)) for ws in words]
            marks = [is_held_out(i, mod, held) for i in batch.column(0).to_pylist()]
            out = (marks, pa.bool_()), (count, pa.int64()), (got, pa.int64()), ([n] * len(words), pa.int64()), (base, pa.float64()), (score, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in out)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
