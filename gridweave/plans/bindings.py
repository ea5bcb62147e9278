"""Matrices and result tables derived from the driver's Parquet tables, with the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import SparseMatrix
from .storage import materialize

ALGOS = ["amd", "degree", "gray", "groot", "metis", "rabbit", "rcm", "slashburn"]


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customer_part(spark, d) -> SparseMatrix:
    o, li = t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    e = o.join(li, o.o_orderkey == li.l_orderkey).groupBy(F.col("o_custkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))
    return SparseMatrix(e, t(spark, d, "customer").count(), t(spark, d, "part").count())


def order_part(spark, d) -> SparseMatrix:
    e = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.sum("l_quantity").alias("val"))
    return SparseMatrix(e, t(spark, d, "orders").count(), t(spark, d, "part").count())


def part_graph(spark, d) -> SparseMatrix:
    """Parts ordered together, both ways; an order has few lines, so the self-join is by its small groups. Written once: all that uses it reads it often."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    e = li.select("l_orderkey", F.col("l_partkey").alias("row")).join(li.select("l_orderkey", F.col("l_partkey").alias("col")), "l_orderkey").where("row <> col")
    n = t(spark, d, "part").count()
    return SparseMatrix(materialize(e.select("row", "col").distinct().withColumn("val", F.lit(1.0))), n, n, mirrored=True)


def part_pairs(spark, d) -> DataFrame:
    """(row, col), row < col: the parts of each order, a pair as often as there are orders with it. Orders are written as lists of parts, which come to far less than their pairs."""
    li = t(spark, d, "lineitem").where("l_orderkey IS NOT NULL").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    own = materialize(li.where(F.size("parts") > 1).select("parts")).select("parts", F.posexplode("parts").alias("at", "row"))
    return own.select(F.col("row").cast("long"), F.explode(F.slice("parts", F.col("at") + 2, F.size("parts")).cast("array<long>")).alias("col"))


def part_supplier(spark, d) -> SparseMatrix:
    e = t(spark, d, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).distinct().withColumn("val", F.lit(1.0))
    return SparseMatrix(e, t(spark, d, "part").count(), t(spark, d, "supplier").count())


CUSTOMER_PART = "SELECT o_custkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"
ORDER_PART = "SELECT l_orderkey AS r, l_partkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
PART_GRAPH = "SELECT DISTINCT a.l_partkey AS r, b.l_partkey AS c, 1.0 AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey"
PART_SUPPLIER = "SELECT DISTINCT l_partkey AS r, l_suppkey AS c, 1.0 AS v FROM lineitem"


def analysis(spark, d) -> DataFrame:
    """Result-shaped rows: a matrix a brand, an algorithm by the supplier's nation, a baseline over all."""
    li = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_tax", "l_quantity")
    j = li.join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    perm = F.element_at(F.array(*[F.lit(a) for a in ALGOS]), (F.pmod("s_nationkey", F.lit(8)) + 1).cast("int"))
    m = [F.round(F.avg("l_discount"), 6).alias("block_density_16"), F.round(F.avg("l_tax"), 6).alias("bandwidth_avg")]
    own = j.groupBy(F.col("p_brand").alias("matrix"), perm.alias("perm")).agg(*m).withColumn("perm_type", F.lit("SYMMETRIC"))
    base = j.groupBy(F.col("p_brand").alias("matrix")).agg(*m).withColumn("perm", F.lit(None).cast("string")).withColumn("perm_type", F.lit(None).cast("string"))
    return own.unionByName(base)


def operations(spark, d) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice")
    j = li.join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    perm = F.when(F.col("s_nationkey") > 0, F.element_at(F.array(*[F.lit(a) for a in ALGOS]), (F.pmod("s_nationkey", F.lit(8)) + 1).cast("int")))
    g = j.groupBy(F.col("p_brand").alias("matrix"), F.col("l_returnflag").alias("kernel"), perm.alias("perm"))
    return g.agg(F.round(F.avg("l_quantity"), 6).alias("time_operation_ms"), (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("time_order_ms")).withColumn("perm_type", F.when(F.col("perm").isNotNull(), F.lit("SYMMETRIC")))


def jobs(spark, d) -> DataFrame:
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = t(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("tag"), F.col("c_mktsegment").alias("perm"), F.col("n_name").alias("matrix"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("exit "), "o_orderpriority")).alias("error"))


_ALGO_LIST = "['" + "','".join(ALGOS) + "']"
ANALYSIS = f"""SELECT p_brand AS matrix, {_ALGO_LIST}[s_nationkey % 8 + 1] AS perm, 'SYMMETRIC' AS perm_type, round(avg(l_discount), 6) AS block_density_16, round(avg(l_tax), 6) AS bandwidth_avg
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
  UNION ALL SELECT p_brand, NULL, NULL, round(avg(l_discount), 6), round(avg(l_tax), 6) FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"""
OPERATIONS = f"""SELECT *, CASE WHEN perm IS NOT NULL THEN 'SYMMETRIC' END AS perm_type FROM (SELECT p_brand AS matrix, l_returnflag AS kernel, CASE WHEN s_nationkey > 0 THEN {_ALGO_LIST}[s_nationkey % 8 + 1] END AS perm,
  round(avg(l_quantity), 6) AS time_operation_ms, sum(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE / count(*) AS time_order_ms FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""
JOBS = """SELECT o_orderstatus AS status, o_orderpriority AS tag, c_mktsegment AS perm, n_name AS matrix, CASE WHEN o_orderstatus = 'F' THEN 'exit ' || o_orderpriority END AS error
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
