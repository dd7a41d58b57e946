"""Graphs over the driver's tables, each as a DataFrame and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relgraph.operators.model import Graph
from relgraph.sources.tables import table


def valid_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per key: the version with the latest updated_at (ties: a deleted one, then the latest created)."""
    cols = [c for c in df.columns if c != key]
    order = F.struct(F.col("updated_at").isNotNull(), F.col("updated_at"), F.col("deleted_at").isNotNull(), F.col("created_at"))
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("v"))
    return best.select(key, *[F.col(f"v.{c}").alias(c) for c in cols])


def valid_sql(name: str) -> str:
    return (
        f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, deleted_at IS NOT NULL DESC, created_at DESC NULLS LAST) AS rn "
        f"FROM {name} WHERE id IS NOT NULL) WHERE rn = 1)"
    )


def supplier_graph(spark: SparkSession, d: str, **options) -> Graph:
    """Suppliers and who sells to whom, valid by contract dates."""
    e = table(spark, d, "supplier_relationships").withColumns({c: F.col(c).cast("long") for c in ("seller_id", "buyer_id")})
    return Graph(spark, valid_rows(table(spark, d, "suppliers")), e, "seller_id", "buyer_id", start_col="contract_start_date", end_col="contract_end_date", **options)


def parts_graph(spark: SparkSession, d: str, **options) -> Graph:
    """Parts and what they consist of, valid by effectivity dates."""
    e = table(spark, d, "bill_of_materials").withColumns({c: F.col(c).cast("long") for c in ("parent_part_id", "child_part_id")})
    return Graph(spark, valid_rows(table(spark, d, "parts")), e, "parent_part_id", "child_part_id", start_col="effective_from", end_col="effective_to", **options)


def dag_edges(spark: SparkSession, d: str) -> DataFrame:
    """An acyclic structure over part with shared children: src, dst, qty."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").cast("long").alias("size"))
    half, third = F.expr("p div 2"), F.expr("p div 3")
    a = p.where("p >= 2").select(half.alias("src"), F.col("p").alias("dst"), F.col("size").alias("qty"))
    b = p.where((F.col("p") >= 3) & (half != third)).select(third.alias("src"), F.col("p").alias("dst"), (F.col("size") + 1).alias("qty"))
    return a.union(b)


DAG_SQL = """(SELECT p_partkey // 2 AS src, p_partkey AS dst, CAST(p_size AS BIGINT) AS qty FROM part WHERE p_partkey >= 2
  UNION ALL SELECT p_partkey // 3, p_partkey, CAST(p_size AS BIGINT) + 1 FROM part WHERE p_partkey >= 3 AND p_partkey // 2 <> p_partkey // 3)"""


#: The part from which the whole structure of dag_edges hangs.
DAG_TOP = 1


def net_edges(spark: SparkSession, d: str) -> DataFrame:
    """A weighted network of suppliers: who follows whom within orders, every pair.

    src, dst, n (orders), q (quantity, the weight), d0 and d1 (first and last ship date).
    """
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    steps = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst"), F.col("l_quantity").alias("q"), F.col("l_shipdate").alias("d"))
    return steps.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), F.min("d").alias("d0"), F.max("d").alias("d1"))


NET_SQL = """(SELECT src, dst, count(*) AS n, sum(q) AS q, min(d) AS d0, max(d) AS d1 FROM (
    SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS dst, l_quantity AS q, l_shipdate AS d FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""


def net_graph(spark: SparkSession, d: str, **options) -> Graph:
    return Graph(spark, table(spark, d, "supplier"), net_edges(spark, d), "src", "dst", "s_suppkey", start_col="d0", end_col="d1", **options)
