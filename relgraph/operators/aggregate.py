"""Edge values combined along all paths from a node, then across the paths of each node."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators.components import peeled, strong_groups
from relgraph.operators.model import LIMITS, Graph, Limits, SubgraphTooLarge
from relgraph.operators.traverse import search
from relgraph.sources.scratch import Scratch, materialize

OPERATIONS = ("sum", "max", "min", "multiply", "count")


def is_acyclic(edges: DataFrame) -> bool:
    """Whether edges (src, dst) hold no cycle: peeling off nodes without a way in or out takes everything away."""
    left = peeled(edges.select("src", "dst").distinct(), 0)
    rows = left.rows
    left.drop()
    return rows == 0


def _by_levels(links: DataFrame, start: DataFrame, operation: str, depth: int) -> DataFrame:
    """On an acyclic graph: one row per node and level instead of one per path. Columns node, value, alive."""
    v, n, q = F.col("value"), F.col("paths"), F.col("q")
    level = materialize(start.select("node", F.lit(1.0 if operation == "multiply" else 0.0 if operation == "sum" else None).cast("double").alias("value"), F.lit(1.0).alias("paths")))
    levels: list[Scratch] = []
    for _ in range(depth):
        met = level.df.join(links, level.df["node"] == links["src"])
        known = q.isNotNull()
        paths = F.sum(F.when(known, n).otherwise(0.0)).alias("paths") if operation in ("sum", "multiply") else F.sum(n).alias("paths")
        value = {
            "sum": F.sum(F.when(known, v + n * q).otherwise(0.0)),
            "multiply": F.sum(F.when(known, v * q).otherwise(0.0)),
            "max": F.max(F.greatest(v, q)),
            "min": F.min(F.least(v, q)),
        }[operation]
        level = materialize(met.groupBy(F.col("dst").alias("node")).agg(value.alias("value"), paths))
        if level.rows == 0:
            break
        levels.append(level)
    if not levels:
        return level.df.limit(0)
    return reduce(DataFrame.unionAll, [x.df for x in levels])


def _by_paths(links: DataFrame, start: DataFrame, operation: str, depth: int, limits: Limits) -> DataFrame:
    """On a graph with cycles: one row per node, level and set of nodes passed in the node's strong group. Columns node, value.

    A simple path that has left a strong group never comes back to it, so which nodes it may still enter depends on those
    it has passed in its present group alone: paths that agree there go on as one.
    """
    v, n, q = F.col("value"), F.col("paths"), F.col("q")
    groups = strong_groups(links.select("src", "dst").distinct())[0]
    ours = groups.select(F.col("node").alias("src"), F.col("component").alias("a"))
    theirs = groups.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    inside = F.coalesce(F.col("a") == F.col("b"), F.lit(False)) | (F.col("src") == F.col("dst"))
    ways = materialize(links.join(ours, "src", "left").join(theirs, "dst", "left").select("src", "dst", "q", inside.alias("inside"))).df
    first = F.lit(1.0 if operation == "multiply" else 0.0 if operation == "sum" else None).cast("double")
    level = materialize(start.select("node", F.array("node").alias("passed"), first.alias("value"), F.lit(1.0).alias("paths")))
    levels: list[Scratch] = []
    total = 0
    known = q.isNotNull()
    paths = F.sum(F.when(known, n).otherwise(0.0)).alias("paths") if operation in ("sum", "multiply") else F.sum(n).alias("paths")
    value = {
        "sum": F.sum(F.when(known, v + n * q).otherwise(0.0)),
        "multiply": F.sum(F.when(known, v * q).otherwise(0.0)),
        "max": F.max(F.greatest(v, q)),
        "min": F.min(F.least(v, q)),
    }[operation]
    for _ in range(depth):
        met = level.df.join(ways, level.df["node"] == ways["src"]).where(~(F.col("inside") & F.array_contains("passed", F.col("dst"))))
        passed = F.when(F.col("inside"), F.array_sort(F.array_append("passed", F.col("dst")))).otherwise(F.array("dst"))
        level = materialize(met.select(F.col("dst").alias("node"), passed.alias("passed"), "value", "paths", "q").groupBy("node", "passed").agg(value.alias("value"), paths))
        total += level.rows
        if level.rows == 0:
            break
        if total > limits.max_paths:
            raise SubgraphTooLarge(f"{total:,} ways through cycles, limit {limits.max_paths:,}; lower max_depth or filter the edges")
        levels.append(level)
    if not levels:
        return level.df.select("node", "value").limit(0)
    return reduce(DataFrame.unionAll, [x.df.select("node", "value") for x in levels])


def aggregate_paths(g: Graph, start_id: Any, value_col: str, operation: str = "sum", direction: str = "outbound", max_depth: int = 20, limits: Limits = LIMITS) -> DataFrame:
    """node, depth (least), value (double) of every node that a path leads to from start_id, the start left out.

    sum, multiply: edge values added or multiplied along each simple path, then added over the paths of a node; max, min:
    the extreme over all its paths; count: the least number of edges. Parallel edges make different paths. A null edge
    value voids the paths over it for sum and multiply and is passed over by max and min; a node with void paths only
    gets 0. max_depth 0 and a start without edges give no rows.

    If the reachable edges prove acyclic, levels are combined per node (cost levels times edges); otherwise per node and
    set of nodes passed in its strong group, up to limits.max_paths such rows.
    """
    if operation not in OPERATIONS:
        raise ValueError(f"operation must be one of {OPERATIONS}")
    depth = limits.depth(max_depth)
    all_links = materialize(g.edge_rows(direction, [value_col]).select("src", "dst", F.col(value_col).cast("double").alias("q"))).df
    start = g.spark.range(1).select(g.typed_id(start_id).alias("root"), g.typed_id(start_id).alias("node"))
    reach = search(all_links.select("src", "dst").distinct(), start, depth, None, False).df
    ends = reach.where(F.col("depth") > 0).select("node", "depth")
    if operation == "count":
        return ends.select("node", "depth", F.col("depth").cast("double").alias("value"))
    nodes = reach.select("node")
    links = materialize(all_links.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")).df
    if is_acyclic(links):
        rows = _by_levels(links, start, operation, depth)
    else:
        rows = _by_paths(links, start, operation, depth, limits)
    total = {"sum": F.sum, "multiply": F.sum, "max": F.max, "min": F.min}[operation]("value")
    values = rows.groupBy("node").agg(total.alias("value"))
    return ends.join(values, "node", "left").select("node", "depth", F.coalesce("value", F.lit(0.0)).alias("value"))


def path_aggregate(
    spark: SparkSession, nodes: DataFrame | str, edges: DataFrame | str, edge_from_col, edge_to_col, start_id: Any, value_col: str, operation: str = "sum", direction: str = "outbound",
    max_depth: int = 20, id_column: str | Sequence[str] = "id", soft_delete_column: str | None = None, valid_at: Any = None, temporal_start_col: str | None = None, temporal_end_col: str | None = None,
    sql_filter: str | None = None, limits: Limits = LIMITS,
) -> DataFrame:
    """aggregate_paths() over two tables, with the columns of the node table: node, depth, value, and the node's row."""
    g = Graph.of(
        spark, nodes, edges, edge_from_col, edge_to_col, id_cols=id_column, soft_delete=soft_delete_column,
        start_col=temporal_start_col, end_col=temporal_end_col, at=valid_at, sql_filter=sql_filter,
    )
    return g.node_rows(aggregate_paths(g, start_id, value_col, operation, direction, max_depth, limits))


def extended_cost(quantities: DataFrame, nodes: DataFrame, id_col: str, cost_col: str) -> DataFrame:
    """One row, total_cost: cost per node times its aggregated quantity, null costs left out."""
    rows = quantities.join(nodes.select(F.col(id_col).alias("node"), F.col(cost_col).cast("double").alias("cost")), "node")
    return rows.agg(F.sum(F.col("cost") * F.col("value")).alias("total_cost"))
