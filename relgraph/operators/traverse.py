"""Bounded breadth-first traversal, level by level."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from relgraph.operators.estimate import EstimationConfig, SampleResult, estimate, sample_of_levels
from relgraph.operators.model import LIMITS, Graph, Limits, SafetyLimitExceeded, SubgraphTooLarge, key_column, valid_at
from relgraph.sources.scratch import Scratch, materialize

#: Levels after which the size of the whole traversal is estimated.
SAMPLE_LEVELS = 5


@dataclass
class Levels:
    """Rows (root, node, depth, path) of a breadth-first search and what was seen on the way."""

    df: DataFrame
    sizes: list[int]
    edges_seen: int
    expansions: int
    tables: list[Scratch] = field(default_factory=list)


#: Level tables that the test for visited nodes reads before they are written together.
VISITED_TABLES = 6


def search(edges: DataFrame, starts: DataFrame, max_depth: int, terminal: DataFrame | None = None, paths: bool = True, check=None) -> Levels:
    """Breadth-first search from every root at once, over edges (src, dst).

    starts: root, node. Each node comes out once per root, at its least depth, with the least of its shortest paths
    (arrays compare element by element). Nodes in ``terminal`` (column node) are reached but not left. ``check`` sees the
    sizes and edges so far after each level and may raise.

    One job per level, which joins the new nodes with the edges; Spark broadcasts them while they are few. Levels are
    written to the shared folder, so lineage stays short and lost executors cost one level.
    """
    first = starts.select("root", "node", F.lit(0).alias("depth"), *([F.array("node").alias("path")] if paths else [])).distinct()
    levels, seen_edges, expansions = [materialize(first)], 0, 0
    visited = [x.df.select("root", "node") for x in levels]
    for depth in range(1, max_depth + 1):
        front = levels[-1].df
        if terminal is not None:
            front = front.join(terminal.select("node"), "node", "left_anti")
        met = front.join(edges, front["node"] == edges["src"]).groupBy("root", F.col("dst").alias("node"))
        met = met.agg(F.count(F.lit(1)).alias("n"), *([F.min("path").alias("path")] if paths else []))
        count = Observation()
        met = met.observe(count, F.sum("n").alias("edges"))
        if len(visited) > VISITED_TABLES:
            visited = [materialize(reduce(DataFrame.unionAll, visited)).df]
        new = met.join(reduce(DataFrame.unionAll, visited), ["root", "node"], "left_anti").select(
            "root", "node", F.lit(depth).alias("depth"), *([F.array_append("path", F.col("node")).alias("path")] if paths else [])
        )
        level = materialize(new)
        seen_edges += int(dict(count.get).get("edges") or 0)
        expansions = depth
        if level.rows == 0:
            level.drop()
            break
        levels.append(level)
        visited.append(level.df.select("root", "node"))
        if check:
            check([x.rows for x in levels], seen_edges)
    df = reduce(DataFrame.unionAll, [x.df for x in levels])
    return Levels(df, [x.rows for x in levels], seen_edges, expansions, levels)


@dataclass
class TraverseResult:
    """nodes: node, depth and the node table's columns; paths: node, depth, path; edges: from_id, to_id of the search tree;
    terminal_nodes: node. depth_reached is the greatest depth of a node, nodes_visited counts the start."""

    nodes: DataFrame
    paths: DataFrame
    edges: DataFrame
    terminal_nodes: DataFrame
    depth_reached: int
    nodes_visited: int
    expansions: int
    sample: SampleResult


def traverse(
    spark: SparkSession,
    nodes: DataFrame | str,
    edges: DataFrame | str,
    edge_from_col: str | Sequence[str],
    edge_to_col: str | Sequence[str],
    start_id: Any,
    direction: str = "outbound",
    max_depth: int | None = 10,
    stop_condition: str | None = None,
    collect_columns: Sequence[str] | None = None,
    prefilter_sql: str | None = None,
    include_start: bool = True,
    id_column: str | Sequence[str] = "id",
    max_nodes: int | None = None,
    skip_estimation: bool = False,
    estimation_config: EstimationConfig | None = None,
    soft_delete_column: str | None = None,
    valid_at: Any = None,
    temporal_start_col: str | None = None,
    temporal_end_col: str | None = None,
    sql_filter: str | None = None,
    order_by: str | None = None,
    limits: Limits = LIMITS,
) -> TraverseResult:
    """Every node that can be reached from start_id within max_depth edges, with its least depth and shortest path.

    Nodes that meet stop_condition (SQL over the node table; the start too) are reached but not left. prefilter_sql and
    sql_filter both restrict the edges (SQL over the edge table, alias e). Ties between shortest paths go to the least
    path. A start that no edge leaves gives just itself; a start that is missing from the node table has a path but no
    node row. include_start=False leaves the start out of nodes and paths. max_depth None goes to the end, 0 and less
    visits the start only. Raises SubgraphTooLarge when the estimate after a few levels exceeds max_nodes, and
    SafetyLimitExceeded when the visited nodes do.
    """
    predicates = [f"({p})" for p in (prefilter_sql, sql_filter) if p]
    g = Graph.of(
        spark, nodes, edges, edge_from_col, edge_to_col, id_cols=id_column, soft_delete=soft_delete_column,
        start_col=temporal_start_col, end_col=temporal_end_col, at=valid_at, sql_filter=" AND ".join(predicates) or None,
    )
    return traverse_graph(g, start_id, direction, max_depth, stop_condition, collect_columns, include_start, max_nodes, skip_estimation, estimation_config, order_by, limits)


def traverse_graph(
    g: Graph, start_id: Any, direction: str = "outbound", max_depth: int | None = 10, stop_condition: str | None = None, collect_columns: Sequence[str] | None = None,
    include_start: bool = True, max_nodes: int | None = None, skip_estimation: bool = False, estimation_config: EstimationConfig | None = None,
    order_by: str | None = None, limits: Limits = LIMITS,
) -> TraverseResult:
    """traverse() over a Graph."""
    most = max_nodes or limits.max_nodes
    depth = limits.depth(max_depth)
    links = materialize(g.simple_edges(direction).select("src", "dst")).df
    terminal = None
    if stop_condition:
        terminal = g.live_nodes().where(F.expr(stop_condition)).select(F.col("__id").alias("node"))

    def check(sizes: list[int], edges_seen: int) -> None:
        if not skip_estimation and len(sizes) == SAMPLE_LEVELS + 1 and depth > SAMPLE_LEVELS:
            expected = estimate(sample_of_levels(sizes, edges_seen, False), depth, None, estimation_config)
            if expected > most:
                raise SubgraphTooLarge(f"about {expected:,} nodes expected, limit {most:,}; raise max_nodes or set skip_estimation")
        if sum(sizes) > most:
            raise SafetyLimitExceeded(f"{sum(sizes):,} nodes visited, limit {most:,}")

    start = g.spark.range(1).select(g.typed_id(start_id).alias("root"), g.typed_id(start_id).alias("node"))
    found = search(links, start, depth, terminal, True, check)
    rows = found.df.select("node", "depth", "path")
    shown = rows if include_start else rows.where(F.col("depth") > 0)
    result_nodes = g.node_rows(shown.select("node", "depth"), collect_columns)
    if order_by:
        result_nodes = result_nodes.orderBy(*[_ordering(x) for x in order_by.split(",")])
    tree = rows.where(F.col("depth") > 0).select(F.element_at("path", -2).alias("from_id"), F.col("node").alias("to_id"))
    ends = rows.select("node").join(terminal, "node", "left_semi") if terminal is not None else rows.select("node").limit(0)
    sizes = found.sizes
    ended = found.expansions == len(sizes)  # the last expansion met nothing new
    return TraverseResult(result_nodes, shown, tree, ends, len(sizes) - 1, sum(sizes), found.expansions, sample_of_levels(sizes + [0] * ended, found.edges_seen, ended))


def _ordering(text: str):
    words = text.strip().rsplit(None, 1)
    if len(words) == 2 and words[1].upper() in ("ASC", "DESC"):
        return F.expr(words[0]).desc() if words[1].upper() == "DESC" else F.expr(words[0]).asc()
    return F.expr(text)


def traverse_collecting(spark: SparkSession, nodes: DataFrame | str, edges: DataFrame | str, edge_from_col, edge_to_col, start_id: Any, target_condition: str, **options) -> TraverseResult:
    """traverse() without the start, keeping the nodes that meet target_condition (SQL over the node table).

    All options of traverse() hold. Paths and edges are those of the kept nodes.
    """
    options = {"include_start": False} | options
    result = traverse(spark, nodes, edges, edge_from_col, edge_to_col, start_id, **options)
    g = Graph.of(spark, nodes, edges, edge_from_col, edge_to_col, id_cols=options.get("id_column", "id"), soft_delete=options.get("soft_delete_column"))
    wanted = g.live_nodes().where(F.expr(target_condition)).select(F.col("__id").alias("node"))
    result.nodes = result.nodes.join(wanted, "node", "left_semi")
    result.paths = result.paths.join(wanted, "node", "left_semi")
    result.edges = result.edges.join(wanted.withColumnRenamed("node", "to_id"), "to_id", "left_semi").select("from_id", "to_id")
    return result


def multi_source(g: Graph, starts: DataFrame, direction: str = "outbound", max_depth: int | None = None, paths: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """Breadth-first search from many roots at once: root, node, depth (and path). starts: a column root."""
    links = materialize(g.simple_edges(direction).select("src", "dst")).df
    return search(links, starts.select("root", F.col("root").alias("node")), limits.depth(max_depth), None, paths).df


def fetch_edges_for_frontier(
    spark: SparkSession, edges: DataFrame | str, frontier: DataFrame, edge_from_col, edge_to_col, direction: str = "outbound", nodes: DataFrame | str | None = None, id_column: str | Sequence[str] = "id",
    soft_delete_column: str | None = None, valid_at: Any = None, temporal_start_col: str | None = None, temporal_end_col: str | None = None, sql_filter: str | None = None, weight_col: str | None = None,
) -> DataFrame:
    """Edges that leave (enter, touch) the frontier (a column node), as stored: from_id, to_id (and w). In "both" an edge
    comes out once, whichever of its ends is in the frontier."""
    g = Graph.of(
        spark, nodes, edges, edge_from_col, edge_to_col, id_cols=id_column, soft_delete=soft_delete_column,
        start_col=temporal_start_col, end_col=temporal_end_col, at=valid_at, sql_filter=sql_filter, weight=weight_col,
    )
    rows = g.edge_rows()
    ids = frontier.select("node").distinct()
    ends = {"outbound": ["src"], "inbound": ["dst"], "both": ["src", "dst"]}[direction]
    hits = [rows.join(ids.withColumnRenamed("node", e), e, "left_semi").select(*rows.columns) for e in ends]
    found = hits[0] if len(hits) == 1 else hits[0].union(hits[1].join(ids.withColumnRenamed("node", "src"), "src", "left_anti").select(*rows.columns))
    return found.withColumnsRenamed({"src": "from_id", "dst": "to_id"})


def fetch_nodes(spark: SparkSession, nodes: DataFrame | str, ids: DataFrame, columns: Sequence[str] | None = None, id_column: str | Sequence[str] = "id", soft_delete_column: str | None = None, order_by: str | None = None) -> DataFrame:
    """Node rows of the given ids (a column node; repeats count once); ids without a row have none."""
    g = Graph.of(spark, nodes, nodes, id_column, id_column, id_cols=id_column, soft_delete=soft_delete_column)
    rows = g.live_nodes().join(ids.select(F.col("node").alias("__id")), "__id", "left_semi")
    keep = list(columns) if columns else g.nodes.columns
    if order_by:
        rows = rows.orderBy(*[_ordering(x) for x in order_by.split(",")])
    return rows.select(*keep)


__all__ = ["TraverseResult", "fetch_edges_for_frontier", "fetch_nodes", "key_column", "multi_source", "search", "traverse", "traverse_collecting", "traverse_graph", "valid_at"]
