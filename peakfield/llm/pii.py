"""PII by bootstrapped contextual extraction, with DataFrame functions only.

Seed entities (emails, addresses, cards, phone numbers found by form) stand after lexical patterns:
the one or two words before them. Patterns and the identifier-like words that follow them form a
bipartite graph, over all documents. Spark scores it in rounds: a pattern by the mean score of its
instances, a word by its best patterns. A pattern of high score counts only if identifiers follow
most of its occurrences anywhere, as any common word stands before some. Words after the patterns
left that no form covers become spans of kind ``context``, and seeds of the next generation of
patterns, until it takes none.

Defined results: a null text counts as empty and has no spans; repeated rows get equal results and
count once each as evidence; a null doc_id is joined like any other; an empty table gives an empty
result; other columns are ignored; very long texts are read whole, in time that grows with their
length; of spans at one place the kind listed first comes first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, texts
from ._spans import find, joined, no_spans

#: A pattern's score at which it may be taken, the distinct seeds it needs, and rounds.
TAKE_SCORE, LEAST_SEEDS, ROUNDS = 0.7, 5, 3
#: The share of a pattern's occurrences that identifiers must follow, and the patterns that may be
#: broadcast to count occurrences; more are joined after counting.
LEAST_SHARE, BROADCAST_PATTERNS = 0.5, 100_000
#: Evidence against a pattern that is assumed before any is seen.
DOUBT = 2.0

# Matches start at the start of a run of the first class or where the last match ended, which
# leaves the same matches as trying every place, without a second look at long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: A word with a digit or an at sign: what a pattern may point at.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass Luhn's check: from the right, every second one is doubled."""
    reversed_ = F.filter(F.split(F.reverse(_digits(m)), ""), lambda c: c != "")

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * (i % 2 + 1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(reversed_, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_kinds(text: Column) -> dict[str, Column]:
    """The spans of each kind that is known by its form."""

    def where(hint: Column, spans: Column) -> Column:
        return F.when(hint, spans).otherwise(no_spans())

    def count(m: Column, lo: int, hi: int) -> Column:
        return F.length(_digits(m)).between(lo, hi)

    kinds: dict[str, tuple[str, Callable[[Column], Column] | None]] = {
        "email": (EMAIL, None),
        "ip": (IP, lambda m: m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        "card": (CARD, lambda m: count(m, 14, 19) & luhn(m)),
        "phone": (PHONE, lambda m: count(m, 10, 15)),
    }
    digit = text.rlike("[0-9]")
    hints = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit}
    return {k: where(hints[k], find(text, *v)) for k, v in kinds.items()}


def _context(before: Column) -> Column:
    """The last two words of a text in lower case, without outer punctuation."""
    near = F.filter(F.split(F.lower(before), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bare = F.transform(F.slice(near, F.greatest(F.size(near) - 1, F.lit(1)), 2), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}:=#]+$", ""))
    return F.array_join(bare, " ")


def instances(based: DataFrame) -> DataFrame:
    """(doc_id, h, start, end, found, seed, pattern): a row for each pattern before each
    identifier-like word. ``seed``: a span found by form touches the word."""
    said = F.filter(find(F.col("text"), CANDIDATE, before=True), lambda s: F.length(s["found"]) >= 5)
    words = based.where(F.col("text").rlike("[0-9@]")).select("doc_id", "h", "base", F.explode(said).alias("s"))
    seed = F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (b["end"] > F.col("s.start")))
    near = _context(F.col("s.before"))
    rows = words.select("doc_id", "h", "s.start", "s.end", F.regexp_replace("s.found", r"^[^\p{L}0-9+@]+|[^\p{L}0-9]+$", "").alias("found"), seed.alias("seed"), near.alias("near"))
    both = F.array_distinct(F.array("near", F.substring_index("near", " ", -1)))
    return rows.select("doc_id", "h", "start", "end", "found", "seed", F.explode(F.filter(both, lambda p: p.rlike("\\p{L}{2,}"))).alias("pattern"))


def graph(found: DataFrame) -> DataFrame:
    """(pattern, found, seed): the edges between patterns and words."""
    return cut(found.groupBy("pattern", "found").agg(F.max(F.col("seed").cast("int")).alias("seed")))


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, seeds) after rounds over the graph of patterns and words."""
    known = edges.groupBy("found").agg(F.max("seed").alias("seed"))
    scores = None
    for _ in range(rounds):
        if scores is None:
            words = known.select("found", F.col("seed").cast("double").alias("belief"))
        else:
            best = edges.join(scores, "pattern").groupBy("found").agg(F.max("score").alias("best"))
            words = known.join(best, "found", "left").select("found", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("best", F.lit(0.0)) * 0.5).alias("belief"))
        judged = edges.join(words, "found").groupBy("pattern")
        scores = cut(judged.agg((F.sum("belief") / (F.count("*") + DOUBT)).alias("score"), F.sum("seed").alias("seeds")))
    return scores


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, seen): how often each pattern's words stand in all texts, whatever follows."""
    gap = r"\x20\x09-\x0D"
    bare = F.regexp_replace(F.lower("text"), rf"(?<![^{gap}])[^\p{{L}}{gap}]++|[^\p{{L}}:=#{gap}]++(?![^{gap}])", "")
    split = texts(docs).select(F.filter(F.split(bare, f"[{gap}]+"), lambda w: w != "").alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    said = split.select(F.explode(F.concat("w", F.slice(pairs, 1, F.greatest(F.size("w") - 1, F.lit(0))))).alias("pattern"))
    if patterns.count() <= BROADCAST_PATTERNS:
        return said.join(F.broadcast(patterns), "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("seen"))
    return said.groupBy("pattern").agg(F.count("*").alias("seen")).join(patterns, "pattern", "left_semi")


def taken_patterns(docs: DataFrame, found: DataFrame, new: DataFrame) -> DataFrame:
    """(pattern): those that count, until no more do. The words of ``new`` after patterns that were
    taken are seeds of the next generation; each pattern's occurrences are counted once."""
    edges, judged = graph(found), None
    while True:
        good = pattern_scores(edges).where((F.col("score") >= TAKE_SCORE) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern")
        good = good if judged is None else good.join(judged, "pattern", "left_anti")
        good = cut(found.join(good, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n")))
        if judged is not None and not good.head(1):
            break
        seen = occurrences(docs, good.select("pattern"))
        now = cut(good.join(seen, "pattern").select("pattern", (F.col("n") >= LEAST_SHARE * F.col("seen")).alias("takes")))
        judged = now if judged is None else cut(judged.union(now))
        taken = now.where("takes")
        if not taken.head(1):
            break
        words = new.join(taken, "pattern", "left_semi").select("found").distinct().withColumn("more", F.lit(1))
        edges = cut(edges.join(words, "found", "left").select("pattern", "found", F.greatest("seed", F.coalesce("more", F.lit(0))).alias("seed")))
    return judged.where("takes").select("pattern")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, the count of each kind known by form, base_sha256, spans."""
    rows = texts(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))
    kinds = list(base_kinds(F.col("text")))
    based = rows.select("doc_id", "h", "text", *(s.alias(k) for k, s in base_kinds(F.col("text")).items()))
    found = cut(instances(based.select("doc_id", "h", "text", F.concat(*kinds).alias("base"))))
    new = found.where(~F.col("seed") & (F.length(_digits(F.col("found"))) >= 4))
    new = new.join(taken_patterns(docs, found, new), "pattern", "left_semi")
    context = new.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end", "found")).alias("context"))
    narrow = based.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), *kinds)
    both = narrow.join(context, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("h")), "left")
    base = [(k, F.col(k)) for k in kinds]
    return both.select(F.col("d").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined([*base, ("context", F.coalesce("context", no_spans()))]).alias("spans"))
