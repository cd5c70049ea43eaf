"""Quality rules as a short-circuit cascade, with DataFrame functions only.

On a bounded sample each rule's cost (time) and selectivity (share it rejects) are measured; the
rules then run by rejections per cost, and a document leaves the cascade at its first failure. The
order changes what the cascade costs, never which documents it keeps.

Defined results: a null or empty text has no words and fails the base; every count is 0 there;
repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, texts, words

#: Rows that the rules are measured on, the first found of at most so many characters: they pass
#: through the driver, as a limit within a plan would send as many rows of every partition to one.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 20_000
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document to reject; it may use t (text), w (words) and the counts."""

    name: str
    fails: Callable[[], Column]


def _share(part: Column, of: Column) -> Column:
    return part / F.greatest(of, F.lit(1))


def _matching(pattern: str) -> Column:
    return F.size(F.filter("w", lambda x: x.rlike(pattern)))


RULES = (
    Rule("symbols", lambda: _share(F.col("n_symbols"), F.col("n_words")) > 0.25),
    Rule("repeated_lines", lambda: (F.col("n_dup_lines") >= 3) & (_share(F.col("n_dup_lines"), F.col("n_lines")) > 0.5)),
    Rule("word_length", lambda: ~_share(F.col("word_chars"), F.col("n_words")).between(2.0, 14.0)),
    Rule("shouting", lambda: _share(_matching("!!$"), F.col("n_words")) > 0.25),
    Rule("capitals", lambda: _share(_matching("^\\p{Lu}{2,}[^\\p{Ll}]*$"), F.col("n_words")) > 0.5),
    Rule("letters", lambda: _share(_matching("\\p{L}"), F.col("n_words")) < 0.5),
    Rule("few_words", lambda: (F.col("n_words") >= 100) & (_share(F.size(F.array_distinct("w")), F.col("n_words")) < 0.1)),
)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, t, w, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Windows of five words are compared by 64-bit hashes; a text sorts its windows only if two of
    its hashes are equal."""
    split = texts(docs).select("doc_id", F.col("text").alias("t"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hashed = F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(5)))))
    counted = split.select("*", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"), hashed.alias("h"))
    repeats = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    sorted_ = counted.select("doc_id", "t", "w", "n_words", "word_chars", "n_symbols", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeats.alias("s"))
    same = lambda e, k: F.coalesce(F.get("s", k)["x"] == e["x"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("s", lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"]))
    found = sorted_.select("doc_id", "t", "w", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", at.alias("at"))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("at", start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(5))).alias("n")))
    return found.select("doc_id", "t", "w", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def measured_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by falling rejections per second on a bounded sample."""
    first = docs.select(F.lit(0).alias("doc_id"), "text").where(F.length("text") <= SAMPLE_CHARS).limit(sample_rows)
    sample = cut(features(docs.sparkSession.createDataFrame(first.collect(), first.schema)))
    sample.select(F.count("*")).collect()
    value: dict[str, float] = {}
    for rule in rules:
        began = time.perf_counter()
        rejected = sample.select(F.coalesce(F.avg(rule.fails().cast("double")), F.lit(0.0))).first()[0]
        value[rule.name] = rejected / max(time.perf_counter() - began, 1e-4)
    return sorted(rules, key=lambda r: -value[r.name])


def _cascade(order: list[Rule]) -> Column:
    """The first rule that rejects, or null: CASE evaluates no branch after the one it takes."""
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in order:
        verdict = verdict.when(F.coalesce(rule.fails(), F.lit(False)), F.lit(rule.name))
    return verdict


def quality_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    order = measured_order(docs, rules)
    return features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), _cascade(order).isNull().alias("kept"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns kept."""
    order = measured_order(docs, rules)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    judged = features(docs.select(row.alias("doc_id"), "text"))
    # A filter would be pushed under the features' projections, copying them into each rule.
    kept = F.when(_cascade(order).isNull(), F.array("doc_id"))
    return judged.select(F.explode(kept).alias("row")).select("row.*")
