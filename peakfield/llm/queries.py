"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._common import documents
from .bpe import bpe_digest
from .exact_dedup import exact_dedup_digest
from .lm import score_digest
from .near_dedup import near_components
from .packing import pack
from .pii import pii_digest
from .quality import quality_digest
from .secrets import secrets_digest
from .substring_dedup import repeated_passages
from .toxicity import toxicity_digest


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this package

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": lambda spark, d: quality_digest(documents(spark, d)),
        "op2_near_dedup": lambda spark, d: near_components(documents(spark, d), k=3, threshold=0.85),
        "op3_exact_dedup": lambda spark, d: exact_dedup_digest(documents(spark, d)),
        "op4_secrets": lambda spark, d: secrets_digest(documents(spark, d)),
        "op5_substring_dedup": lambda spark, d: repeated_passages(documents(spark, d)),
        "op6_lm_score": lambda spark, d: score_digest(documents(spark, d)),
        "op7_toxicity": lambda spark, d: toxicity_digest(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op8_packing": lambda spark, d: pack(documents(spark, d), tokenizer_path()),
        "op9_pii": lambda spark, d: pii_digest(documents(spark, d)),
        "op10_bpe": lambda spark, d: bpe_digest(documents(spark, d), tokenizer_path()),
        "pipeline": _pipeline,
    }


WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality": rf"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
            l AS (SELECT *, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
                length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
            g AS (SELECT doc_id, i, w[i:i + 4] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
            c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
            r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM c WHERE n > 1) GROUP BY 1),
            f AS (SELECT l.doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, len(lines) AS n_lines,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, w FROM l LEFT JOIN r USING (doc_id)),
            b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, greatest(n_words, 1)::DOUBLE AS n FROM f)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                NOT (base_failed OR n_symbols / n > 0.25 OR (n_dup_lines >= 3 AND n_dup_lines / greatest(n_lines, 1)::DOUBLE > 0.5)
                OR NOT word_chars / n BETWEEN 2 AND 14 OR len(list_filter(w, lambda x: x LIKE '%!!')) / n > 0.25
                OR len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}{{2,}}[^\p{{Ll}}]*$'))) / n > 0.5
                OR len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / n < 0.5
                OR (n_words >= 100 AND len(list_distinct(w)) / n < 0.1)) AS kept FROM b""",
        "op2_near_dedup": f"""
            WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
            p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
            e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
            pairs AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
            reach AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT node, y FROM reach JOIN pairs ON x = other)
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
            FROM d LEFT JOIN n USING (doc_id) JOIN reach ON node = d.doc_id GROUP BY 1, 2""",
        "op3_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d
            WINDOW w AS (PARTITION BY t)""",
    }
