"""Queries p5, p7, p8 and p9 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.llm.leakage import leaks
from relgraph.llm.names import same_name_pairs, same_names
from relgraph.llm.reading import cross_validation, reading_levels
from relgraph.llm.tokenizer import encode_corpus
from relgraph.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = same_name_pairs(table(spark, d, "suppliers").select("id", "name"), "id", "name")
    return pairs.select(F.col("a").alias("supplier_id_a"), F.col("b").alias("supplier_id_b"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per supplier id with a name: the smallest id of its firm and how many ids the firm has."""
    groups = same_names(table(spark, d, "suppliers").select("id", "name"), "id", "name")
    firms = groups.groupBy("entity").agg(F.min("id").alias("firm_id"), F.count_distinct("id").alias("n_ids"))
    return groups.join(firms, "entity").select(F.col("id").alias("supplier_id"), "firm_id", "n_ids").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source"), table(spark, d, "reading_ratings").select("doc_id", "rater", "reading_level")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(*_rated(spark, d))


def p9_cross_validation(spark: SparkSession, d: str) -> DataFrame:
    return cross_validation(*_rated(spark, d))


QUERIES = {"p5_found": p5_found, "p5_entities": p5_entities, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_cross_validation": p9_cross_validation}
ORACLE: dict[str, str] = {}
