"""Toxicity by lexicon induction.

Terms are words and stems (the first three to eight characters that several words share), as
inflected words are each rare. Labels choose the seeds alone: the terms whose training texts are
marked toxic more surely than chance would have it among all terms tried. A graph joins seeds and
frequent words by positive pointwise mutual information of their presence in the same stretch of
text, counted over all documents. Its communities (languages or subjects, as the words show them,
whatever ``lang`` says) each have their own toxic and clean seeds, and random walks with restart
from either give each term a polarity; so a term of a small community is judged against its own
kind. Seeds that the walk bears out mark stretches, and a last step of the walk goes from these to every
word of the corpus: a word, known to the labels or not, joins the lexicon if it surely stands in
marked stretches more often than not, in differing surroundings.

A document's score is a logistic function, fitted on a bounded sample of the training rows, of how
much likelier its weighted lexicon words are at the rate of toxic than of other training texts.

Words are lower-cased (A-Z) and lose punctuation at their ends. Labels are learnt from once per
distinct text (rows that repeat a doc_id: as often), and a term's evidence is at most the distinct
pairs of words around it, so that a group of copies or near copies counts as one.

Defined results: a null or empty text gets the score of a text without words; a doc_id with several
labels counts as toxic if most of them are; without labels every score is 0; repeated rows are
scored each; very long texts are read whole, in stretches; ties between terms fall to the one that
sorts first; an empty table gives an empty result; columns other than text are not read.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, small_batches, texts

#: Words of a stretch of text, chance to go on walking, and rounds of a walk.
STRETCH, WALK_ON, ROUNDS = 200, 0.85, 60
#: Characters of stems, and the share of a stem that one longer term may make up.
STEMS, BRANCHES = range(3, 9), 0.8
#: Times its share among all training texts that toxic ones must have of a seed's texts; the share
#: of toxic training texts that hold a seed; that of training texts that hold a frequent word.
LIFT, SEED_SHARE, FREQUENT = 2.0, 0.002, 0.04
#: Polarity from which a term belongs to the lexicon, and texts or stretches it must be in.
LEXICON, LEAST_DOCS = 0.72, 3
#: Weighted lexicon words that mark a stretch, the share of its stretches that must be marked for a
#: word to join the lexicon, and the standard errors by which it must be.
MARKED, JOINS, SURE = 2.0, 0.5, 4.0
#: Labelled rows, at most, that the last step is fitted on.
FIT_ROWS = 20_000
#: Labels that may be broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
ENDS = b".,;:!?\"'`()[]{}<>*#$%&|~^_-+=/\\@"
THRESHOLD = 0.3
#: Words whose terms a task keeps at hand.
MEMO = 300_000
#: Bytes of terms, at most, that one regular expression looks for; of many more it is slow.
LOOKED_FOR = 8_000


def is_held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def split(text: str) -> list[bytes]:
    return text.encode().lower().split()


def lowered(texts_: list[str] | pa.Array) -> pa.Array:
    return pc.ascii_lower(texts_ if isinstance(texts_, pa.Array) else pa.array(texts_, pa.string()))


def numbered(low: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts in lower case, as ``split`` finds them: how many each text has, every
    word's number, text by text, and the words by their numbers."""
    parts = pc.ascii_split_whitespace(low)
    each = parts.flatten().dictionary_encode()
    number, words = each.indices.to_numpy(), each.dictionary
    size = parts.value_lengths().to_numpy().astype(np.int64)
    if (gap := words.index("").as_py()) >= 0:  # white space at the ends of texts
        kept = number != gap
        size = np.diff(np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(size)]])
        number = number[kept]
    return size, number, words


def stretch_of(size: np.ndarray) -> tuple[np.ndarray, int]:
    """Which stretch each word stands in, by the words of each text, and how many there are."""
    each = -(-size // STRETCH)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.cumsum(each) - each, size) + place // STRETCH, int(each.sum())


def bare_words(words: pa.Array) -> pa.Array:
    return pc.ascii_trim(words, ENDS.decode())


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled training rows, one for each distinct text."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg((F.avg("toxic") > 0.5).alias("toxic"))
    marks = cut(marks.where(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2))
    small = marks.count() <= BROADCAST_LABELS
    marks = F.broadcast(marks) if small else marks
    rows = texts(docs)
    told = rows.join(marks, rows["doc_id"] == marks["id"])
    one = cut(told.groupBy(F.xxhash64("text").alias("h")).agg(F.min("id").alias("one"), (F.avg(F.col("toxic").cast("int")) > 0.5).alias("marked")))
    return told.join(F.broadcast(one.drop("h")) if small else one.drop("h"), F.col("id") == F.col("one")).select("text", F.col("marked").alias("toxic")).where("text != ''")


def terms(word: bytes) -> tuple[str, ...]:
    """The terms of a word (a stem ends with a hyphen, which no word does), the longest first."""
    bare = word.strip(ENDS).decode(errors="replace")
    return (bare, *[f"{bare[:n]}-" for n in range(min(STEMS[-1], len(bare) - 1), STEMS[0] - 1, -1)]) if len(bare) > 1 else ()


class Among:
    """The terms of a word that are among ``wanted``, the longest first. Stems are few and begin as
    their words do, so that most words are told by three bytes and looked up whole."""

    def __init__(self, wanted: Iterable[str]) -> None:
        self.wanted = frozenset(wanted)
        self.whole = {t.encode(): (t,) for t in self.wanted if not t.endswith("-")}
        self.begins = {t.encode()[:3] for t in self.wanted if t.endswith("-")}

    def values(self, words: pa.Array, find: Known, kind: type, otherwise: float) -> np.ndarray:
        """What ``find`` says of each word; ``otherwise`` of those that surely have no term here."""
        bare, out = bare_words(words).cast(pa.binary()), np.full(len(words), otherwise, kind)
        known = pc.is_in(bare, value_set=pa.array(list(self.whole), pa.binary()))
        maybe = pc.or_(known, pc.is_in(pc.binary_slice(bare, 0, 3), value_set=pa.array(list(self.begins), pa.binary())))
        out[maybe.to_numpy(zero_copy_only=False)] = find.of(words.filter(maybe).cast(pa.binary()).to_pylist(), kind)
        return out

    def __call__(self, word: bytes) -> tuple[str, ...]:
        bare = word.strip(ENDS)
        return tuple([t for t in terms(word) if t in self.wanted]) if bare[:3] in self.begins else self.whole.get(bare, ())


class Known(dict):
    """What ``find`` says of each word, kept at hand for up to MEMO words."""

    def __init__(self, find: Callable[[bytes], object]) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, word: bytes) -> object:
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = self.find(word)
        return found

    def of(self, words: list[bytes], kind: type) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), kind, len(words))


def met_terms(low: pa.Array, toxic: np.ndarray) -> pa.Table:
    """(term, a, b, a2, b2) as ``term_evidence`` has them, of some texts in lower case."""
    size, number, words = numbered(low)
    every = max(1, len(words))
    pair, again = _once(np.repeat(np.arange(len(low)) * every, size) + number, np.zeros(len(number), bool))
    text, word = np.divmod(pair, every)
    bare, out = bare_words(words), []
    long = pc.utf8_length(bare).to_numpy()
    for n in (0, *STEMS):  # 0: whole words
        has = long > max(n, 1)
        part = bare.filter(pa.array(has))
        part = (pc.binary_join_element_wise(pc.utf8_slice_codeunits(part, 0, n), "-", "") if n else part).dictionary_encode()
        term, most = np.full(len(words), -1), max(1, len(part.dictionary))
        term[has] = part.indices.to_numpy()
        of = term[word]
        key, twice = _once((text * most + of)[of >= 0], again[of >= 0])
        held, of = np.divmod(key, most)
        marked = toxic[held]
        out.append(pa.table([part.dictionary, *(pa.array(np.bincount(of[x], minlength=len(part.dictionary))) for x in (marked, ~marked, marked & twice, ~marked & twice))], ["term", "a", "b", "a2", "b2"]))
    return pa.concat_tables(out)


def _once(key: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and whether it is there twice or was marked so."""
    key = np.sort(key << 1 | twice)
    twice, key = (key & 1).astype(bool), key >> 1
    last = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) if len(key) else key  # where a marked one is, if any
    return key[last], twice[last] | (np.diff(last, prepend=-1) > 1)



def term_evidence(training: DataFrame) -> DataFrame:
    """(term, a, b, a2, b2): the toxic and the other training texts that hold each term, and those
    that hold it twice or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []

        def merged() -> pa.Table:
            every = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([(c, "sum") for c in ("a", "b", "a2", "b2")])
            return every.select(["term", "a_sum", "b_sum", "a2_sum", "b2_sum"]).rename_columns(["term", "a", "b", "a2", "b2"])

        for batch in batches:
            parts.append(met_terms(lowered(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)))
            if sum(map(len, parts)) > 2_000_000:
                parts = [merged()]
                if len(parts[0]) > 800_000:
                    yield from parts.pop().combine_chunks().to_batches()
        if parts:
            yield from merged().combine_chunks().to_batches()

    return training.mapInArrow(count, "term string, a long, b long, a2 long, b2 long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("a", "b", "a2", "b2")))


def surroundings(rows: DataFrame, wanted: set[str]) -> DataFrame:
    """(term, around): how many distinct pairs of words stand around each term."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(Among(wanted))
        for batch in batches:
            found: set[tuple[str, bytes]] = set()
            for text in batch.column(0).to_pylist():
                ws = split(text)
                for i, met in enumerate(map(known.__getitem__, ws)):
                    if met:
                        pair = (ws[i - 1] if i else b"") + b" " + ws[i] + b" " + (ws[i + 1] if i + 1 < len(ws) else b"")
                        found.update((t, pair) for t in met)
            out = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([zlib.crc32(x[1]) for x in out], pa.int64())], ["term", "pair"])

    return rows.select("text").mapInArrow(pairs, "term string, pair long").distinct().groupBy("term").agg(F.count("*").alias("around"))


def _gain(a: Column, b: Column, share: float) -> Column:
    """The log-likelihood ratio of a term's texts against the share of toxic ones; 0 for terms that
    toxic texts do not hold LIFT times as often as their share."""
    part = lambda x, of: F.when(x > 0, x * F.log(x / ((a + b) * of))).otherwise(0.0)
    return F.when(a >= LIFT * share * (a + b), 2 * (part(a, share) + part(b, max(1 - share, 1e-9)))).otherwise(0.0)


def without_doubles(rated: list[tuple[str, int, float]]) -> list[str]:
    """Of (term, toxic texts, gain): no stem which one longer term makes up for the most part, and
    no term under a stem of as much evidence."""
    by_name = sorted(rated)
    names = [t for t, _, _ in by_name]

    def made_up(stem: str, a: int) -> bool:
        bare = stem[:-1]
        lo, hi = bisect.bisect_left(names, bare), bisect.bisect_left(names, bare + chr(0x10FFFF))
        return any(b >= BRANCHES * a and len(u.rstrip("-")) > len(bare) for u, b, _ in by_name[lo:hi])

    kept = [(t, g) for t, a, g in rated if not (t.endswith("-") and made_up(t, a))]
    gains = dict(kept)
    return [t for t, g in kept if not any(gains.get(f"{t[:n]}-", -1.0) >= g for n in STEMS if n < len(t.rstrip("-")))]


def vocabulary(training: DataFrame, toxic: int, clean: int) -> tuple[list[str], list[str], DataFrame]:
    """The toxic seeds, and the frequent words that are none; (term, n): the training texts that hold
    each word."""
    share = toxic / max(1, toxic + clean)
    rated = term_evidence(training).where((F.col("a") + F.col("b") >= LEAST_DOCS)).select("term", "a", "b", "a2", "b2")
    rated = cut(rated.withColumn("g", F.greatest(_gain(F.col("a"), F.col("b"), share), _gain(F.col("a2"), F.col("b2"), share))))
    chance = 2 * math.log(max(2, rated.count()))
    maybe = rated.where((F.col("g") > chance) & (F.col("a") >= max(LEAST_DOCS, SEED_SHARE * toxic))).select("term", "a", "g").collect()
    names = without_doubles(sorted(((r["term"], r["a"], r["g"]) for r in maybe), key=lambda x: (-x[2], x[0])))
    often = rated.where((F.col("a") + F.col("b") >= max(LEAST_DOCS, FREQUENT * (toxic + clean))) & (F.col("g") <= chance) & ~F.col("term").endswith("-")).select("term").collect()
    held = rated.where(~F.col("term").endswith("-")).select("term", (F.col("a") + F.col("b")).alias("n"))
    if not names:
        return [], [], held
    close = rated.join(surroundings(training.where("toxic"), set(names)), "term").where(F.col("around") >= LEAST_DOCS)
    for c in ("a", "a2"):
        close = close.withColumn(c, F.least(c, "around"))
    close = close.withColumn("g", F.greatest(_gain(F.col("a"), F.col("b"), share), _gain(F.col("a2"), F.col("b2"), share)))
    seeds = close.where(F.col("g") > chance).select("term", "g").collect()
    return [r["term"] for r in sorted(seeds, key=lambda r: (-r["g"], r["term"]))], sorted(r["term"] for r in often), held


def together(docs: DataFrame, words: list[str]) -> tuple[np.ndarray, int]:
    """In how many stretches each two words are met (the diagonal: each word), and how many
    stretches there are, over all documents. A task sends one packed matrix of bounded size."""
    number, k = {w: i for i, w in enumerate(words)}, len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, several, among = np.zeros((k, k), np.int64), 0, {}, Among(number)

        def code(word: bytes) -> int:
            """The one term of a word, a number beyond all terms for several, -1 for none."""
            met = tuple(number[t] for t in among(word))
            return met[0] if len(met) == 1 else several.setdefault(met, k + len(several)) if met else -1

        def add(row: np.ndarray, codes: np.ndarray, size: int) -> None:
            x = np.zeros((size, k + len(several)), np.float32)
            x[row, codes] = 1
            for met, column in several.items():
                x[:, list(met)] = np.maximum(x[:, list(met)], x[:, [column]])
            x = x[:, :k]
            total[:] += np.rint(x.T @ x).astype(np.int64)

        place = Known(code)
        for batch in batches:
            sizes, of, words_ = numbered(lowered(batch.column(0)))
            codes = among.values(words_, place, np.int32, -1)[of]
            row, size = stretch_of(sizes)
            row, codes = row[codes >= 0], codes[codes >= 0]
            for lo in range(0, size, 1024):
                i, j = np.searchsorted(row, (lo, lo + 1024))
                add(row[i:j] - lo, codes[i:j], min(1024, size - lo))
            n += size
        at = np.flatnonzero(np.triu(total))
        packed = zlib.compress(at.astype("<u4").tobytes() + total.reshape(-1)[at].astype("<i8").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([n])], ["packed", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(k * k, np.int64), 0
        for batch in batches:
            for packed, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, n = zlib.decompress(packed), n + m
                size = len(raw) // 12
                total[np.frombuffer(raw, "<u4", size)] += np.frombuffer(raw, "<i8", size, 4 * size)
        at = np.flatnonzero(total)
        packed = zlib.compress(at.astype("<u4").tobytes() + total[at].astype("<i8").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([n])], ["packed", "n"])

    parts = texts(docs).select("text").mapInArrow(count, "packed binary, n long")
    parts = cut(parts)
    while (width := parts.count()) > 16:  # a tree: no task and no driver takes every task's matrix
        parts = cut(parts.repartition(-(-width // 16)).mapInArrow(merge, "packed binary, n long"))
    total, n = np.zeros(k * k, np.int64), 0
    for r in parts.collect():
        raw, n = zlib.decompress(r["packed"]), n + r["n"]
        size = len(raw) // 12
        total[np.frombuffer(raw, "<u4", size)] += np.frombuffer(raw, "<i8", size, 4 * size)
    both = total.reshape(k, k)
    return both + np.triu(both, 1).T, n


def associations(both: np.ndarray, n: int) -> np.ndarray:
    """The positive pointwise mutual information of each two terms that are met together more often
    than chance explains."""
    alone = np.maximum(np.diag(both), 1).astype(float)
    chance = np.outer(alone, alone) / max(n, 1)
    sure = (both >= LEAST_DOCS) & (both > chance + SURE * np.sqrt(chance))
    ppmi = np.log(np.where(sure, both / chance, 1))
    np.fill_diagonal(ppmi, 0)
    return ppmi


def communities(weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """A label for each node, by moving nodes while modularity grows."""
    label, degree = np.arange(len(weight)), weight.sum(1)
    mass, total = degree.copy(), max(degree.sum(), 1e-12)
    for _ in range(rounds):
        moved = 0
        for i in range(len(weight)):
            mass[label[i]] -= degree[i]
            gain = np.bincount(label, weights=weight[i], minlength=len(weight)) - degree[i] * mass / total
            best = int(gain.argmax())
            if gain[best] > gain[label[i]] + 1e-12:
                label[i], moved = best, moved + 1
            mass[label[i]] += degree[i]
        if not moved:
            break
    return label


def polarity(both: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """Of the first ``toxic`` terms, seeds, and the others, frequent words: each term's share of
    toxic arrivals of random walks over the PPMI graph, within its own community. 0 for most clean
    arrivals; else the odds are scaled so that the community's median word has 0.5, or more evenly
    where even that word is all but out of the reach of its toxic seeds."""
    ppmi = associations(both, n)
    label = communities(ppmi[toxic:, toxic:])
    every, sizes = np.unique(label, return_counts=True)
    every = every[sizes >= min(LEAST_DOCS, sizes.max(initial=0))]
    if not len(every):
        return np.ones(len(both))
    near = np.stack([ppmi[:, toxic:][:, label == c].mean(1) for c in every], 1)
    own = near.argmax(1)
    step = ppmi / np.maximum(ppmi.sum(1, keepdims=True), 1e-12)

    def walk(seeds: np.ndarray) -> np.ndarray:
        start = np.zeros(len(both))
        start[seeds] = 1 / max(1, len(seeds))
        p = start
        for _ in range(ROUNDS):
            p = WALK_ON * (p @ step) + (1 - WALK_ON) * start
        return p

    out = np.zeros(len(both))
    for c, name in enumerate(every):
        seeds = np.flatnonzero(own[:toxic] == c)
        if len(seeds):
            bad, good = walk(seeds), walk(toxic + np.flatnonzero(label == name))
            odds, here = bad / np.maximum(good, 1e-12), own == c
            scaled = odds / max(float(np.median(odds[toxic:][label == name])), 0.1)
            out[here] = np.where(odds > 1, scaled / (1 + scaled), 0)[here]
    return out


GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True


def count_words(low: bytes) -> int:
    gap = GAPS[np.frombuffer(low, np.uint8)]
    return int((gap[:-1] & ~gap[1:]).sum()) + int(len(gap) > 0 and not gap[0])


def beginning_with(bare: list[str]) -> str | None:
    """An expression for texts, in lower case, with a word that begins with one of ``bare``; None if
    these are too many."""
    if not bare or sum(len(t.encode()) for t in bare) > LOOKED_FOR:
        return None
    return rf"(?:\A|[\x09-\x0d {re.escape(ENDS.decode())}])(?:{'|'.join(map(re.escape, bare))})"


class Weights:
    """The weights of words, and a quick look at which texts have any."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.begin = beginning_with(sorted({t.rstrip("-") for t in lexicon}))
        self.among = Among(lexicon)
        self.of_word = Known(lambda w: next((lexicon[t] for t in self.among(w)), 0.0))

    def look(self, low: pa.Array) -> pa.Array:
        """Which texts in lower case are not sure to have no weight."""
        return pc.match_substring_regex(low, self.begin) if self.begin else pa.array([True] * len(low), pa.bool_())

    def of(self, low: pa.Array) -> list[np.ndarray]:
        """The weights of each text's words."""
        size, number, words = numbered(low)
        weight = self.among.values(words, self.of_word, np.float64, 0.0)[number]
        return np.split(weight, np.cumsum(size)[:-1]) if len(low) else []


def stretches_with(batches: Iterable[list[str] | pa.Array], words: list[str]) -> np.ndarray:
    """In how many stretches of the texts each of ``words`` stands."""
    seen, wanted, begin = np.zeros(len(words), np.int64), pa.array(words, pa.string()), beginning_with(words)
    for batch in batches:
        low = lowered(batch)
        if begin:
            low = low.filter(pc.match_substring_regex(low, begin))
        size, number, each = numbered(low)
        of = pc.index_in(bare_words(each), value_set=wanted).fill_null(-1).to_numpy()[number]  # whole words alone, without their stems
        met = (stretch_of(size)[0] * len(words) + of)[of >= 0]
        met = np.sort(met)  # sorted by hand: np.unique hashes, which takes longer
        seen += np.bincount(met[np.diff(met, prepend=-1) > 0] % len(words), minlength=len(words))
    return seen


def joining(docs: DataFrame, lexicon: dict[str, float], judged: set[str], held: DataFrame | None = None) -> dict[str, float]:
    """word -> weight of the words, whether labelled rows hold them or not, that the walk's last
    step reaches from the stretches which ``lexicon`` marks; but for those judged before. ``held``:
    (term, n), in how many texts a word stands at least; where so many stretches are too many to be
    marked often enough, no more of them are counted."""
    rows = texts(docs).select("text")
    # As many stretches, and surroundings, as would do if all of them were marked.
    least = math.ceil(SURE * SURE * JOINS / (1 - JOINS))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in batches:
            seen: dict[tuple[bytes, int], int] = {}
            low = lowered(batch.column(0))
            low = low.filter(weights.look(low))
            for text, w in zip(low.cast(pa.binary()).to_pylist(), weights.of(low)):
                ws = text.split() if w.any() else []
                for lo in range(0, len(ws), STRETCH):
                    if w[lo : lo + STRETCH].sum() >= MARKED:
                        here = [b"", *ws[lo : lo + STRETCH], b""]
                        at = {x.strip(ENDS): i for i, x in enumerate(here)}
                        for x, i in at.items():
                            pair = (x, zlib.crc32(here[i - 1] + b" " + here[i + 1]) if 0 < i < len(here) - 1 else 0)
                            seen[pair] = seen.get(pair, 0) + 1
            out = [(t, pair, n) for t, pair, n in ((x.decode(errors="replace"), pair, n) for (x, pair), n in seen.items()) if len(t) > 1]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2))], ["term", "pair", "n"])

    around = rows.mapInArrow(marked, "term string, pair long, n long").groupBy("term", "pair").agg(F.sum("n").alias("n")).groupBy("term").agg(F.count("*").alias("around"), F.sum("n").alias("marked"))
    near = cut(around.where((F.col("around") >= least) & (F.col("marked") >= least)))
    some = near
    if held is not None:  # ``low`` below is JOINS or more just if a word is marked so often, or more
        enough = JOINS * F.col("n") + SURE * F.sqrt(JOINS * (1 - JOINS) * F.col("n"))
        some = near.join(held, "term", "left").where(F.col("n").isNull() | (F.col("marked") >= enough * (1 - 1e-9)))
    may = {r["term"] for r in some.select("term").collect()} - judged
    may = sorted(t for t in may if not any(u in lexicon for u in terms(t.encode())))
    if not may:
        return {}

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = stretches_with((batch.column(0) for batch in batches), may)
        yield pa.RecordBatch.from_arrays([pa.array(may, pa.string()), pa.array(seen)], ["term", "n"])

    met = rows.mapInArrow(stretches, "term string, n long").groupBy("term").agg(F.sum("n").alias("met"))
    p, n, z = F.col("marked") / F.col("met"), F.col("met"), SURE
    low = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    sure = near.join(met, "term").withColumn("low", low).where(F.col("low") >= JOINS)
    return {r["term"]: r["low"] for r in sure.select("term", "low").collect()}


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slopes (not negative) of a logistic regression, with a weak ridge."""
    design, ridge = np.c_[np.ones(len(x)), x], np.r_[1e-6, np.full(x.shape[1], 1e-2)]
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    if (beta[1:] < 0).any() and x.shape[1] > 1:  # without the slopes that would turn a sign
        keep = beta[1:] > 0
        out = np.zeros(len(beta))
        out[np.r_[True, keep]] = fit(x[:, keep], y)
        return out
    return np.r_[beta[0], np.maximum(beta[1:], 0)]


def induced_lexicon(docs: DataFrame, training: DataFrame) -> dict[str, float]:
    """term -> weight of the terms that belong to the lexicon: polarity, or share of marked
    stretches at least."""
    n, toxic, distinct = training.agg(F.count("*"), F.sum(F.col("toxic").cast("int")), F.count_distinct(F.xxhash64("text"))).first()
    if not toxic:
        return {}
    seeds, often, held = vocabulary(training, toxic, n - toxic)
    if not seeds:
        return {}
    both, stretches = together(docs, [*seeds, *often])
    p = polarity(both, stretches, len(seeds))
    lexicon = {w: float(x) for w, x, m in zip(seeds, p, np.diag(both)) if x >= LEXICON and m >= LEAST_DOCS}
    # Where rows that repeat a doc_id are learnt from twice, texts are no lower bound of stretches.
    return lexicon | joining(docs, lexicon, {*seeds, *often}, held if n == distinct else None) if lexicon else {}


def weigh(texts_: list[str] | pa.Array, weights: Weights) -> np.ndarray:
    """The words of each text and the weights of its lexicon words, added up."""
    low = lowered(texts_)
    some = weights.look(low)
    found = iter(weights.of(low.filter(some)))
    out = np.zeros((len(low), 2))
    for i, (text, may) in enumerate(zip(low.cast(pa.binary()).to_pylist(), some.to_pylist())):
        w = next(found) if may else None
        out[i] = (count_words(text), 0) if w is None else (len(w), w.sum())
    return out


def rates(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight a word of toxic and of other texts; one word of the latter is assumed beforehand."""
    high = x[y == 1, 1].sum() / max(1.0, x[y == 1, 0].sum())
    low = (x[y == 0, 1].sum() + 1) / max(1.0, x[y == 0, 0].sum() + 1)
    return float(max(high, 1e-9)), float(min(low, max(high, 1e-9) / 2))


def evidence(x: np.ndarray, high: float, low: float) -> np.ndarray:
    """How much likelier a text's weights are at the toxic rate, on a scale that dampens both ends,
    and whether there are any."""
    z = x[:, 1] * math.log(high / low) - x[:, 0] * (high - low)
    return np.stack([np.sign(z) * np.log1p(np.abs(z)), 1 - np.exp(-x[:, 1])], 1)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    training = training_rows(docs, labels)
    lexicon = induced_lexicon(docs, training)
    rows = texts(docs)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    beta, high, low = np.zeros(3), 1.0, 0.5

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in batches:
            x = weigh(batch.column(1), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["y", "n", "x"])

    if lexicon:
        share = max(1, math.ceil(training.count() / FIT_ROWS))
        told = training.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select(F.col("toxic").cast("int").alias("y"), "text")
        sample = told.mapInArrow(weighed, "y int, n double, x double").limit(FIT_ROWS).toPandas()
        x, y = sample[["n", "x"]].to_numpy(), sample["y"].to_numpy().astype(float)
        high, low = rates(x, y)
        beta = fit(evidence(x, high, low), y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for batch in batches:
            x = weigh(batch.column(1), weights)
            score = 1 / (1 + np.exp(-np.clip(beta[0] + evidence(x, high, low) @ beta[1:], -700, 700))) if lexicon else np.zeros(len(x))
            held = [is_held_out(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")
