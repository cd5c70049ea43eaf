"""More registered queries: scalar functions, reshaped graphs and layers, extensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extensions as X
from ..functions import layers as LF
from ..functions import sequences as SF
from ..operators import kinds as K
from ..operators import layers as A
from ..operators import shape as S
from ..operators import stats as T
from . import bindings as B
from .landscape import Landscape
from .queries import CUBE, GENES, PARTS, query, r6

LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SUPPLY = "supply AS (SELECT l_suppkey AS u, l_partkey + 1000000 AS v, max(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY 1, 2)"


def _supply(spark, d):
    pairs = B.table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("u"), (F.col("l_partkey") + 1000000).cast("long").alias("v"), "l_quantity")
    return Landscape.from_graph(pairs, weight="l_quantity").edges


@query("total_weight", f"WITH {PARTS} SELECT count(*)::DOUBLE AS total, count(*) AS n_edges FROM part_edges")
def _(spark, d):
    return K.total_weight(*B.part_kinds(spark, d))


@query("graph_leaves", f"WITH {PARTS} SELECT node FROM (SELECT u AS node FROM part_edges UNION ALL SELECT v FROM part_edges) GROUP BY 1 HAVING count(*) = 1")
def _(spark, d):
    return K.leaves(*B.part_kinds(spark, d))


@query("edge_mutations", f"WITH {PARTS} SELECT a.node AS u, b.node AS v, a.s || a.i || b.s AS mutation FROM keys a JOIN keys b ON a.i = b.i AND a.k = b.k AND a.s <> b.s AND a.node < b.node")
def _(spark, d):
    members, pairs = B.part_kinds(spark, d)
    told = S.told_mutations(pairs, F.col("s"), F.col("t")).withColumnRenamed("mutations", "forwards")
    told = S.told_mutations(told, F.col("t"), F.col("s")).select("a", "b", *(F.array_join(c, ",").alias(c) for c in ("forwards", "mutations")))
    return K.expand(members, told).select("u", "v", F.when(F.col("forth"), F.col("forwards")).otherwise(F.col("mutations")).alias("mutation"))


@query("landscape_from_graph", f"WITH {SUPPLY} SELECT u, v, weight, round(1 / weight, 6) AS distance FROM supply")
def _(spark, d):
    return _supply(spark, d).select("u", "v", "weight", r6("distance").alias("distance"))


@query(
    "at_most_k_edges",
    f"WITH {SUPPLY}, ways AS (SELECT u AS a, v AS b, weight FROM supply UNION ALL SELECT v, u, weight FROM supply), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS r FROM ways) "
    "SELECT least(a, b) AS u, greatest(a, b) AS v FROM ranked WHERE r <= 5 GROUP BY 1, 2 HAVING count(*) = 2",
)
def _(spark, d):
    return S.at_most_k_edges(_supply(spark, d), 5).select("u", "v")


@query(
    "graph_table",
    f"WITH {SUPPLY}, ways AS (SELECT u, v, weight FROM supply UNION ALL SELECT v, u, weight FROM supply), "
    "numbers AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS place FROM (SELECT DISTINCT u AS node FROM ways)) "
    "SELECT a.place AS source, b.place AS target, weight FROM ways JOIN numbers a ON a.node = u JOIN numbers b ON b.node = v",
)
def _(spark, d):
    return S.graph_table(_supply(spark, d))


@query(
    "spanning_tree_of",
    "WITH k AS (SELECT * FROM nation WHERE n_nationkey % 4 = 0), r AS (SELECT DISTINCT n_regionkey FROM k) "
    "SELECT n_nationkey::BIGINT AS u, (1000 + n_regionkey)::BIGINT AS v FROM k UNION ALL SELECT (1000 + n_regionkey)::BIGINT, 9999::BIGINT FROM r WHERE (SELECT count(*) FROM r) > 1",
)
def _(spark, d):
    nation = B.table(spark, d, "nation")
    n, r = F.col("n_nationkey").cast("long"), (F.col("n_regionkey") + 1000).cast("long")
    tree = nation.select(n.alias("u"), r.alias("v")).union(nation.select(r, F.lit(9999).cast("long")).distinct())
    return S.spanning_tree_of(tree, nation.where("n_nationkey % 4 = 0").select(n.alias("node")))


@query("layers_wide", "SELECT p_partkey AS node, p_retailprice AS price, CASE WHEN p_partkey % 2 = 1 THEN p_size::DOUBLE END AS size FROM part")
def _(spark, d):
    p = B.table(spark, d, "part").withColumn("node", F.col("p_partkey"))
    return S.wide({"price": p.select("node", F.col("p_retailprice").cast("double").alias("value")), "size": p.where("node % 2 = 1").select("node", F.col("p_size").cast("double").alias("value"))})


@query("layers_long", "SELECT p_partkey AS node, 'price' AS layer, p_retailprice::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::DOUBLE FROM part WHERE p_size > 10")
def _(spark, d):
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").cast("double").alias("price"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("size"))
    return S.long(p, ["price", "size"])


@query("one_hot_round_trip", f"WITH {PARTS} SELECT node AS row_id, seq, 36 AS width FROM parts")
def _(spark, d):
    rows = B.part_strings(spark, d).withColumn("hot", SF.one_hot(F.col("symbols"), LETTERS))
    return rows.select("row_id", SF.text_of(SF.from_one_hot(F.col("hot"), LETTERS)).alias("seq"), F.size(F.col("hot")[0]).alias("width"))


@query("code_round_trip", f"WITH {PARTS} SELECT node AS row_id, seq FROM parts")
def _(spark, d):
    return B.part_strings(spark, d).select("row_id", SF.text_of(SF.from_codes(SF.codes(F.col("symbols"), LETTERS), LETTERS)).alias("seq"))


@query("sequence_mutate", f"WITH {PARTS} SELECT node AS row_id, '9' || substr(seq, 2, 3) || 'Z' AS seq FROM parts")
def _(spark, d):
    return B.part_strings(spark, d).select("row_id", SF.text_of(SF.mutate(F.col("symbols"), {0: "9", 4: "Z"})).alias("seq"))


@query("hamming_to_one", f"WITH {PARTS} SELECT node AS row_id, list_sum(list_transform(range(1, 6), lambda i: (substr(seq, i, 1) <> substr('1122S', i, 1))::INT))::BIGINT AS distance FROM parts")
def _(spark, d):
    one = F.array(*map(F.lit, "1122S"))
    return B.part_strings(spark, d).select("row_id", SF.hamming(F.col("symbols"), one).cast("long").alias("distance"))


@query("bits_round_trip", f"WITH {CUBE} SELECT code, substr(bin(code + 64), 2) AS bits FROM cube")
def _(spark, d):
    made = B.cube(spark, d).withColumn("b", SF.bits(F.col("code"), 6))
    return made.select(SF.from_bits(F.col("b")).alias("code"), F.array_join(F.transform("b", lambda x: x.cast("string")), "").alias("bits"))


NORM = "round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5)"


@query("vector_norms", f"SELECT vec_id, {NORM} AS norm FROM embeddings")
def _(spark, d):
    v = B.vectors(spark, d).withColumn("x", F.col("vector").cast("array<double>"))
    return v.select(F.col("node").alias("vec_id"), F.round(SF.euclidean(F.col("x"), F.transform("x", lambda _: F.lit(0.0))), 5).alias("norm"))


SOFTMAX = (
    "z AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(x::DOUBLE)) AS e FROM embeddings), "
    "p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM z)"
)


@query("prob_from_logits", f"WITH {SOFTMAX} SELECT vec_id, round(p[1], 6) AS first, list_position(p, list_max(p)) - 1 AS likeliest FROM p")
def _(spark, d):
    v = B.vectors(spark, d).select("node", LF.checked(LF.from_logits(F.slice(F.col("vector").cast("array<double>"), 1, 4))).alias("p"))
    return v.select(F.col("node").alias("vec_id"), r6(F.col("p")[0]).alias("first"), LF.likeliest(F.col("p")).alias("likeliest"))


@query("category_rank", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS place FROM orders")
def _(spark, d):
    return B.table(spark, d, "orders").select("o_orderkey", LF.rank(F.col("o_orderstatus"), ["F", "O", "P"]).alias("place"))


@query("replicate_spread", f"WITH {GENES} SELECT a || '|' || b || '|' || c AS node, round(stddev_pop(value), 3) AS spread FROM genes GROUP BY 1")
def _(spark, d):
    # Genotypes are few, and their replicates grow with the orders: no list of them is held.
    return B.genotypes(spark, d).groupBy("node").agg(F.round(F.stddev_pop(F.col("value").cast("double")), 3).alias("spread"))


@query("annotation_to_layer", "SELECT p_partkey AS node, coalesce(nullif(p_brand, 'Brand#11'), '__missing__') AS value FROM part")
def _(spark, d):
    notes = B.table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("brand"))
    return A.to_category(notes, "brand").withColumnRenamed("row_id", "node")


@query("trimmed_means", "SELECT o_orderstatus AS block, round((sum(o_totalprice) - min(o_totalprice) - max(o_totalprice)) / (count(*) - 2), 3) AS value FROM orders GROUP BY 1 HAVING count(*) > 2")
def _(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_orderstatus").alias("block"), F.col("o_totalprice").cast("double").alias("x"))
    return o.groupBy("block").agg(F.round(X.trimmed_mean("x"), 3).alias("value"))


@query("sequence_pieces", f"WITH {PARTS} SELECT node AS row_id, i::INT AS place, substr(seq, i + 1, 3) AS piece FROM parts, (SELECT unnest(range(3)) AS i)")
def _(spark, d):
    spark.udtf.register("pieces", X.Pieces)
    B.part_strings(spark, d).select("row_id", "seq").createOrReplaceTempView("part_strings")
    return spark.sql("SELECT row_id, place, piece FROM part_strings, LATERAL pieces(seq, 3)")


@query("previous_and_next", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return B.table(spark, d, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice").over(w).alias("after"))


@query("totals_by_cube", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, d):
    return B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).cube("flag", "status").agg(F.count("*").alias("n"))


@query("approximate_counts", "SELECT l_returnflag AS flag, true AS near_distinct, true AS near_median FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = B.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_partkey", F.col("l_extendedprice").cast("double").alias("x"))
    # Beside a distinct count, Spark would hold a sketch for every part of a flag.
    made = rows.groupBy("flag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.percentile_approx("x", 0.5, 10000).alias("p"))
    exact = rows.groupBy(F.col("flag").alias("of")).agg(F.countDistinct("l_partkey").alias("b"))
    median = T.medians(rows.select(F.col("flag").alias("group"), F.col("x").alias("value"))).withColumnRenamed("median", "q")
    made = made.join(exact, F.equal_null("flag", "of")).join(median, F.equal_null("flag", "group"))
    return made.select("flag", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("near_distinct"), (F.abs(F.col("p") - F.col("q")) <= 0.05 * F.col("q")).alias("near_median"))


@query("louvain_modularity", "SELECT true AS better_than_one, true AS covers_all")
def _(spark, d):
    from ..operators import matching as M

    nodes, edges = B.cube_graph(spark, d)
    found = S.cut(S.louvain(nodes.select("node"), edges))
    return spark.createDataFrame([(M.modularity(found, edges) > 0.3, found.count() == nodes.count())], "better_than_one boolean, covers_all boolean")
