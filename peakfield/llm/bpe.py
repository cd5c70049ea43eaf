"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round finds each word's pair of the
lowest rank, by binary search over the sorted keys of all mergeable pairs, merges it wherever it
occurs in that word, and looks up again only the pairs that a merge changed. Words repeat, so
each is encoded once a batch and kept in a cache of bounded size.

Defined results: null text counts as empty and gives no ids; the special token's string in a
text becomes its id; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import small_batches, texts

#: Letters and digits that Unicode gained after version 16, which the tokenizers library knows.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7"
    "\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
    "\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EXACT_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{LATER}]]+| ?[\p{{N}}--[{LATER}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{LATER}]]+|\s+(?!\S)|\s+"
#: Distinct words that a worker remembers; the cache is emptied when it holds more.
CACHE_WORDS = 150_000
NEVER = np.int64(1 << 40)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _gather(source: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """source[at[i] : at[i] + n[i]] of every i, end to end."""
    ends = np.cumsum(n)
    return source[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class _Numbered(dict):
    """Gives each new word the next number and notes it in ``fresh``."""

    fresh: list[str]

    def __init__(self) -> None:
        self.fresh = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class NumpyBPE:
    """Encoder and decoder for one vocabulary file in the tokenizers library's format."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.plain = regex.compile(PATTERN).findall
        self.exact = regex.compile(EXACT_PATTERN, regex.V1).findall
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.byte_id = np.zeros(256, np.int64)
        for ch, b in letters.items():
            self.byte_id[b] = vocab[ch]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.specials.items():
            pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.pieces = np.frombuffer(b"".join(pieces), np.uint8)
        digits = [f"{i},".encode() for i in range(self.size)]
        self.digit_len = np.array([len(p) for p in digits], np.int64)
        self.digit_at = np.cumsum(self.digit_len) - self.digit_len
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.clear()

    def clear(self) -> None:
        """Forget all words. ``at``, ``count``: where in ``flat`` a numbered word's ids lie."""
        self.known = _Numbered()
        self.flat = np.array(list(self.specials.values()), np.int32)
        self.count = np.ones(len(self.specials), np.int64)
        self.at = np.arange(len(self.specials))
        for token in self.specials:
            self.known[token]
        self.known.fresh = []

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def merge_words(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the byte strings (one at least, none empty), end to end, and the count of each."""
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        sym = self.byte_id[np.frombuffer(b"".join(encoded), np.uint8)]
        word = np.repeat(np.arange(len(encoded)), sizes)
        rank = np.full(len(sym), NEVER)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NEVER, lengths)
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, rank = sym[live], word[live], rank[live]
                lengths, best = lengths[best < NEVER], best[best < NEVER]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, lengths)
            at = np.flatnonzero(hit)
            follows = np.r_[False, (np.diff(at) == 1) & (word[at[1:]] == word[at[:-1]])]
            if follows.any():  # a run such as aaa: every second pair of it, from the left
                n = np.arange(len(at))
                first = np.maximum.accumulate(np.where(follows, 0, n))
                at = at[(n - first) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            new = moved[at]
            for i in (new, new[new > 0] - 1):
                last = i == len(sym) - 1
                rank[i[last]] = NEVER
                i = i[~last]
                same = word[i] == word[i + 1]
                rank[i[~same]] = NEVER
                i = i[same]
                rank[i] = self._ranks(sym[i], sym[i + 1])
        words, syms = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(words, kind="stable")
        return syms[order].astype(np.int32), np.bincount(words, minlength=len(encoded))

    def find(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or max(text) < LATER[0] else self.exact(text)

    def words(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.specials):
            return self.find(text)
        return [w for part in self.split.split(text) for w in ([part] if part in self.specials else self.find(part))]

    def encode_flat(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids end."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        split = [self.words(t) for t in docs]
        number = self.known.__getitem__
        at = [np.fromiter(map(number, ws), np.int64, len(ws)) for ws in split]
        if self.known.fresh:
            ids, n = self.merge_words([w.encode() for w in self.known.fresh])
            self.at = np.r_[self.at, len(self.flat) + np.cumsum(n) - n]
            self.count = np.r_[self.count, n]
            self.flat = np.r_[self.flat, ids]
            self.known.fresh = []
        words = np.concatenate([*at, np.zeros(0, np.int64)])
        ids = _gather(self.flat, self.at[words], self.count[words])
        total = np.r_[0, np.cumsum(self.count[words])]
        return ids, total[np.cumsum([len(ws) for ws in split], dtype=np.int64)] if split else np.zeros(0, np.int64)

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode_flat(docs)
        return np.split(ids, ends[:-1]) if docs else []

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return _gather(self.digits, self.digit_at[ids], self.digit_len[ids]).tobytes()[:-1]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return _gather(self.pieces, self.piece_at[ids], self.piece_len[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def coder(path: str) -> NumpyBPE:
    return NumpyBPE(path)


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    small_batches(docs.sparkSession)
    wanted = texts(docs)
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return wanted.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each text."""
    small_batches(docs.sparkSession)
    wanted = texts(docs)
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            ids = [x.tolist() for x in bpe.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return wanted.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of (doc_id, ids)."""
    small_batches(encoded.sparkSession)
    wanted = encoded.select("doc_id", "ids")
    id_type = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            out = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return wanted.mapInArrow(run, f"doc_id {id_type}, text string")
