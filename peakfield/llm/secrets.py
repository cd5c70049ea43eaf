"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query of trigrams that a matching text must hold
(in lower case). One pass builds postings for the queries' trigrams, as bitmaps of doc_ids; the
bitmaps of a clause are intersected and those of a rule's clauses united; a second pass runs each
expression on its candidates alone. Rules without mandatory trigrams scan every text.

Defined results: a null text counts as empty and has no spans; rows that repeat a doc_id share
their candidates and are verified each; a null doc_id is always a candidate; an empty table gives
an empty result; other columns are ignored by the digest and kept by ``redact_secrets``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, texts
from ._spans import find, joined, no_spans
from .trigrams import query

#: Bytes of candidate bitmaps that may be broadcast; beyond, each text is held to its rules'
#: Boolean queries where it lies, with the same candidates and no join.
BROADCAST_BYTES = 64 << 20
BITMAP_BITS = 32768


@dataclass(frozen=True)
class Secret:
    """A kind of secret. ``ok`` drops matches; ``base`` kinds count and come first."""

    kind: str
    pattern: str
    ok: Callable[[Column], Column] | None = None
    base: bool = False


ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

SECRETS = (
    Secret("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6, True),
    Secret("access", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20, True),
    Secret("hex", r"[0-9a-f]{24,}", None, True),
    Secret("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Secret("git_token", r"\bgh[pousr]_[A-Za-z0-9]{30,}"),
    Secret("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Secret("cloud_key", r"\bAIza[A-Za-z0-9_-]{30,}"),
    Secret("pay_key", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{10,}"),
    Secret("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Secret("bearer", r"\b[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
)


def index(rows: DataFrame, rules: tuple[Secret, ...]) -> DataFrame:
    """Postings (gram, bucket, docs): for each trigram of the rules' queries, the bitmaps of the
    doc_ids whose text holds it."""
    grams = sorted({g for r in rules for clause in query(r.pattern) or () for g in clause})
    low = rows.select("doc_id", F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains("low", g)) if grams else F.array().cast("array<string>")
    posted = low.where("doc_id is not null").select("doc_id", F.explode(held).alias("gram"))
    return posted.groupBy("gram", F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("docs"))


def candidates(rows: DataFrame, rules: tuple[Secret, ...]) -> DataFrame:
    """(bucket, one bitmap of candidates a rule with mandatory trigrams): intersected postings."""
    asked = [(r.kind, n, g, len(clause)) for r in rules for n, clause in enumerate(sorted(query(r.pattern) or (), key=sorted)) for g in sorted(clause)]
    wanted = rows.sparkSession.createDataFrame(asked, "kind string, clause int, gram string, n_grams int")
    met = index(rows, rules).join(F.broadcast(wanted), "gram").groupBy("kind", "clause", "bucket", "n_grams").agg(F.count("*").alias("n"), F.bitmap_and_agg("docs").alias("docs"))
    kinds = [r.kind for r in rules if query(r.pattern)]
    return met.where("n = n_grams").groupBy("bucket").agg(*(F.bitmap_or_agg(F.when(F.col("kind") == k, F.col("docs"))).alias(k) for k in kinds))


def _bit(bitmap: Column, place: Column) -> Column:
    """Whether the bit is set; false for a null bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def _holds(low: Column, rule: Secret) -> Column:
    out = F.lit(False)
    for clause in query(rule.pattern):
        all_ = F.lit(True)
        for g in sorted(clause):
            all_ = all_ & F.contains(low, F.lit(g))
        out = out | all_
    return out


def scan(docs: DataFrame, rules: tuple[Secret, ...] = SECRETS, carry: Column | None = None) -> DataFrame:
    """doc_id, text and, for each rule, an array of spans named by its kind; ``carry`` as ``row``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.lit(None) if carry is None else carry).alias("row"))
    indexed = [r for r in rules if query(r.pattern)]
    found = cut(candidates(texts(docs), rules))
    if found.count() * len(indexed) * BITMAP_BITS // 8 <= BROADCAST_BYTES:
        bitmaps = found.select("bucket", F.struct(*(r.kind for r in indexed)).alias("maps"))
        rows = rows.withColumn("bucket", F.bitmap_bucket_number("doc_id")).join(F.broadcast(bitmaps), "bucket", "left")
        place = F.bitmap_bit_position("doc_id")
        may = {r.kind: F.col("doc_id").isNull() | _bit(F.col("maps")[r.kind], place) for r in indexed}
    else:
        may = {r.kind: _holds(F.lower("text"), r) for r in indexed}
    spans = {r.kind: find(F.col("text"), r.pattern, r.ok) for r in rules}
    return rows.select("doc_id", "text", "row", *(F.when(may[k], s).otherwise(no_spans()).alias(k) if k in may else s.alias(k) for k, s in spans.items()))


def secrets_digest(docs: DataFrame, rules: tuple[Secret, ...] = SECRETS) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256, spans."""
    base, every = [r.kind for r in rules if r.base], [r.kind for r in rules]
    return scan(docs, rules).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined((k, F.col(k)) for k in base), 256).alias("base_sha256"),
        joined((k, F.col(k)) for k in every).alias("spans"),
    )


def redact_secrets(docs: DataFrame, rules: tuple[Secret, ...] = SECRETS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans by one) and n_chars, where
    there is such a column, brought up to date for the texts changed."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    kept = scan(docs, rules, row)
    every = F.sort_array(F.concat(*(F.transform(r.kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for r in rules)))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        clear = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.when(s["start"] >= acc["at"], F.concat(acc["out"], clear, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    done = F.aggregate(every, begin, step)
    new = F.when(F.size(every) > 0, F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))).otherwise(F.col("row.text"))
    kept = kept.select("row", (F.size(every) > 0).alias("changed"), new.alias("text"))
    values = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return kept.select(*(v.alias(c) for c, v in values.items()))

