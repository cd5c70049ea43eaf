"""Landscapes bound to the relational tables: which rows are nodes, values and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import symbols
from ..operators.edges import hamming_edges, hamming_edges_binary, hamming_kinds
from ..operators.graph import cut

CUBE_BITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, code, bits, value): six yes/no facts of a line item, its mean price by their code."""
    facts = [F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_returnflag") == "R", F.col("l_linestatus") == "F", F.month("l_shipdate") % 2 == 1]
    code = F.lit(0).cast("long")
    for f in facts:
        code = code * 2 + F.coalesce(f, F.lit(False)).cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy(code.alias("code")).agg(F.avg("l_extendedprice").alias("value"))
    bits = F.array(*(F.expr(f"cast(shiftright(code, {CUBE_BITS - 1 - p}) & 1 as int)") for p in range(CUBE_BITS)))
    return rows.select(F.col("code").alias("node"), "code", bits.alias("bits"), "value")


def cube_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cube's nodes (64 rows at most) and its Hamming edges."""
    nodes = cut(cube(spark, sf_dir))
    return nodes, hamming_edges_binary(nodes, CUBE_BITS)


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, symbols, replicates value, block): orders by status, priority and quarter."""
    o = table(spark, sf_dir, "orders")
    s = F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1), F.quarter("o_orderdate").cast("string"))
    return o.select(F.concat_ws("|", s).alias("node"), s.alias("symbols"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("block"))


def part_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, seq, symbols, value, brand): parts as strings of size, brand and type."""
    p = table(spark, sf_dir, "part")
    seq = F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lpad(F.regexp_replace("p_brand", "[^0-9]", ""), 2, "0"), F.substring("p_type", 1, 1))
    return p.select(F.col("p_partkey").alias("row_id"), seq.alias("seq"), symbols(seq).alias("symbols"), F.col("p_retailprice").alias("value"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = part_strings(spark, sf_dir).withColumnRenamed("row_id", "node")
    return nodes, hamming_edges(nodes.select("node", "symbols"))


def part_kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same graph by kinds of equal strings: members(node, kind, value, ...) and pairs(a, b, s, t)."""
    return hamming_kinds(part_strings(spark, sf_dir).select(F.col("row_id").alias("node"), "symbols", "value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"), "label")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), "value")
