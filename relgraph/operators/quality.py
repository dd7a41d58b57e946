"""Checks of a graph's tables against what is declared of them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators.aggregate import is_acyclic
from relgraph.operators.model import Graph, key_column


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def count_matches(df: DataFrame, declared: int) -> tuple[bool, int]:
    """(whether the number of rows is the declared one, the number)."""
    n = df.count()
    return n == declared, n


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def dangling_edges(g: Graph) -> DataFrame:
    """Edges of which an end has no (live) node: src, dst, missing_end (src, dst or both). Null ends are no edges."""
    ids = g.live_nodes().select(F.col("__id").alias("id")).distinct()
    rows = g.with_(soft_delete=None).edge_rows().select("src", "dst")
    out = rows.join(ids.select(F.col("id").alias("src"), F.lit(1).alias("a")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    end = F.when(F.col("a").isNull() & F.col("b").isNull(), "both").when(F.col("a").isNull(), "src").when(F.col("b").isNull(), "dst")
    return out.select("src", "dst", end.alias("missing_end")).where(F.col("missing_end").isNotNull())


def self_loops(links: DataFrame) -> DataFrame:
    """Violations of irreflexive: src, dst with src = dst."""
    return links.where(F.col("src") == F.col("dst"))


def mutual_pairs(links: DataFrame) -> DataFrame:
    """Violations of asymmetric, each once: a < b with edges both ways."""
    rows = links.select("src", "dst").distinct()
    turned = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return rows.where(F.col("src") < F.col("dst")).join(turned, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b"))


def one_way_pairs(links: DataFrame) -> DataFrame:
    """Violations of symmetric: edges without the edge back."""
    rows = links.select("src", "dst").distinct()
    return rows.join(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")


def repeated_ends(links: DataFrame, end: str) -> DataFrame:
    """Violations of functional (end = src) or inverse functional (end = dst): nodes with several partners there."""
    other = "dst" if end == "src" else "src"
    return links.groupBy(F.col(end).alias("node")).agg(F.count_distinct(other).alias("partners")).where(F.col("partners") > 1)


def missing_loops(links: DataFrame) -> DataFrame:
    """Violations of reflexive: nodes of the edges without an edge to themselves."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(self_loops(links).select(F.col("src").alias("node")), "node", "left_anti")


def back_edge_ratio(g: Graph, rank: str) -> DataFrame:
    """One row: edges, back_edges (from a smaller to a greater rank of the node table), ratio. Unranked ends do not count."""
    ranks = g.live_nodes().select(F.col("__id").alias("id"), F.col(rank).alias("rank")).distinct()
    rows = g.edge_rows().select("src", "dst")
    both = rows.join(ranks.select(F.col("id").alias("src"), F.col("rank").alias("a")), "src").join(ranks.select(F.col("id").alias("dst"), F.col("rank").alias("b")), "dst").where("a is not null and b is not null")
    return both.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("a") < F.col("b")).alias("back_edges")).select("edges", "back_edges", F.try_divide("back_edges", "edges").alias("ratio"))


def missing_entities(df: DataFrame, column: str, wanted: Sequence[Any]) -> list:
    """Which of the wanted values no row has; the wanted values are few and come from the caller."""
    have = {r[0] for r in df.where(F.col(column).isin(list(wanted))).select(column).distinct().collect()}
    return [w for w in wanted if w not in have]


def axiom_report(spark: SparkSession, g: Graph, axioms: dict[str, bool]) -> DataFrame:
    """axiom, violations for every axiom that is declared and can be checked on the edges."""
    links = g.simple_edges().select("src", "dst")
    checks = {
        "irreflexive": lambda: self_loops(links).count(),
        "asymmetric": lambda: mutual_pairs(links).count(),
        "symmetric": lambda: one_way_pairs(links).count(),
        "reflexive": lambda: missing_loops(links).count(),
        "functional": lambda: repeated_ends(links, "src").count(),
        "inverse_functional": lambda: repeated_ends(links, "dst").count(),
        "acyclic": lambda: 0 if is_acyclic(links) else 1,
    }
    rows = [(a, int(check())) for a, check in checks.items() if axioms.get(a)]
    return spark.createDataFrame(rows, "axiom string, violations long")


def referential_report(df: DataFrame, column: str | Sequence[str], parents: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row: rows (with a value), orphans (whose value no parent has)."""
    refs = df.select(key_column(column).alias("ref")).where(F.col("ref").isNotNull())
    keys = parents.select(key_column(key).alias("ref"), F.lit(1).alias("hit")).where(F.col("ref").isNotNull()).distinct()
    return refs.join(keys, "ref", "left").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("hit").isNull()).alias("orphans"))
