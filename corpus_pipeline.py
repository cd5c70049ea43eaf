"""A pipeline that turns documents into packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the pipeline writes it as Parquet
and gives what it reads back to the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from peakfield.llm._common import documents, shared_dir
from peakfield.llm.exact_dedup import exact_dedup
from peakfield.llm.near_dedup import near_dedup
from peakfield.llm.packing import pack
from peakfield.llm.quality import quality_rules
from peakfield.llm.queries import tokenizer_path
from peakfield.llm.secrets import redact_secrets


def drop_bad_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a quality rule rejects go."""
    return quality_rules(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles, similarity of 0.8 or more."""
    return near_dedup(docs, k=5, threshold=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; the documents stay."""
    return redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, with their ids."""
    return pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality", drop_bad_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: No DuckDB SQL: near-duplicate signatures and packing are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, out = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
