"""Nodes, edges and limits: what every graph operator works on."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.functions.columns import key_column, key_literal, valid_at

DIRECTIONS = ("outbound", "inbound", "both")


class SafetyLimitExceeded(RuntimeError):
    """A running operator has met a limit."""


class SubgraphTooLarge(RuntimeError):
    """An operator refuses to start, or to go on enumerating: the graph it would visit is too large."""


#: Deeper than any search gets, which ends with its last level.
ANY_DEPTH = 2**31


@dataclass(frozen=True)
class Limits:
    """Bounds that keep an operator from running away; each can be raised per call. Beyond a bound an operator raises."""

    #: Deepest search that may be asked for; None: any.
    max_depth: int | None = None
    max_nodes: int = 10_000_000
    max_paths: int = 5_000_000
    #: Edges up to which betweenness sends them to every worker; more are joined.
    max_broadcast_edges: int = 2_000_000
    #: Edges up to which a task may hold all of them as arrays, which come by a shuffle; more are joined.
    max_task_edges: int = 40_000_000

    def depth(self, asked: int | None) -> int:
        """The depth to search to; None is any."""
        if self.max_depth is not None and (asked is None or asked > self.max_depth):
            raise SafetyLimitExceeded(f"depth {asked} asked for, limit {self.max_depth}")
        return ANY_DEPTH if asked is None else max(0, asked)


LIMITS = Limits()


def resolve(spark: SparkSession, table: DataFrame | str) -> DataFrame:
    """A DataFrame as it is, a name as a table or view of the session."""
    return spark.table(table) if isinstance(table, str) else table


@dataclass(frozen=True)
class Graph:
    """A node table and an edge table, seen as a directed graph.

    The one place where edge predicates, validity, soft deletion, exclusions, composite keys and weights take effect.
    An edge with a null end is no edge; one whose end is soft-deleted is gone; one with a null weight is gone where
    weights matter, a weight of 0 stays. Columns of any name may accompany either table.
    """

    spark: SparkSession
    nodes: DataFrame | None
    edges: DataFrame
    from_cols: str | Sequence[str]
    to_cols: str | Sequence[str]
    id_cols: str | Sequence[str] = "id"
    weight: str | None = None
    sql_filter: str | None = None
    soft_delete: str | None = None
    start_col: str | None = None
    end_col: str | None = None
    at: Any = None
    excluded: tuple = ()

    @classmethod
    def of(cls, spark: SparkSession, nodes: DataFrame | str | None, edges: DataFrame | str, from_cols, to_cols, **options) -> Graph:
        return cls(spark, None if nodes is None else resolve(spark, nodes), resolve(spark, edges), from_cols, to_cols, **options)

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    def live_nodes(self) -> DataFrame:
        """Rows of the node table that are not deleted, with their key in the column __id."""
        if self.nodes is None:
            raise ValueError("this operator needs a node table")
        nodes = self.nodes.withColumn("__id", key_column(self.id_cols)).where(F.col("__id").isNotNull())
        return nodes.where(F.col(self.soft_delete).isNull()) if self.soft_delete else nodes

    def node_rows(self, ids: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """Node rows joined with ids (a column ``node`` and more); all columns of the node table or the chosen ones."""
        nodes = self.live_nodes()
        keep = list(columns) if columns else [c for c in self.nodes.columns]
        taken = set(ids.columns)
        named = nodes.select("__id", *[F.col(c).alias(f"{c}_row" if c in taken else c) for c in keep])
        return ids.join(named, ids["node"] == named["__id"]).drop("__id")

    def edge_rows(self, direction: str = "outbound", extra: Sequence[str] = ()) -> DataFrame:
        """src, dst, extra columns, and w if the graph has a weight; parallel edges stay. "both" holds each edge twice."""
        if direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}")
        df = self.edges.alias("e")
        if self.sql_filter:
            df = df.where(F.expr(self.sql_filter))
        if self.at is not None:
            df = df.where(valid_at(self.start_col, self.end_col, self.at))
        cols = [key_column(self.from_cols).alias("src"), key_column(self.to_cols).alias("dst"), *[F.col(c) for c in extra]]
        if self.weight:
            cols.append(F.col(self.weight).cast("double").alias("w"))
        df = df.select(*cols).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        if self.weight:
            df = df.where(F.col("w").isNotNull())
        for value in self.excluded:
            df = df.where((F.col("src") != key_literal(value)) & (F.col("dst") != key_literal(value)))
        if self.soft_delete and self.nodes is not None:
            live = self.live_nodes().select("__id")
            df = df.join(live.select(F.col("__id").alias("src")), "src", "left_semi").join(live.select(F.col("__id").alias("dst")), "dst", "left_semi")
            df = df.select("src", "dst", *extra, *(["w"] if self.weight else []))
        if direction == "outbound":
            return df
        turned = df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in df.columns if c not in ("src", "dst")])
        return turned if direction == "inbound" else df.union(turned)

    def simple_edges(self, direction: str = "outbound") -> DataFrame:
        """One row per (src, dst), with the least weight w if the graph has one."""
        df = self.edge_rows(direction)
        return df.groupBy("src", "dst").agg(F.min("w").alias("w")) if self.weight else df.select("src", "dst").distinct()

    def typed_id(self, value: Any) -> Column:
        """An id as a literal of the edge ends' type."""
        kind = self.edges.select(key_column(self.from_cols).alias("k")).schema["k"].dataType
        return key_literal(value).cast(kind)
