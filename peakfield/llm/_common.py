"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule here: a word is a run of anything else.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of its own only where the session names none (tests)."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="peakfield-"))
    return spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")


def mounted(folder: str) -> str:
    """The shared folder as a path, which every executor must have mounted."""
    url = urlsplit(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the files that workers map need a mounted shared folder, not {folder}")
    return unquote(url.path) if url.scheme else folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, so that a lost executor costs no more than a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (null text: empty), so that other columns cannot clash with ours."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed, whatever the locale or script."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text in order: runs without ASCII white space."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch holds, as a few documents may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
