"""Shortest paths, tied paths, bounded simple paths and the best of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators.model import LIMITS, Graph, Limits, SubgraphTooLarge
from relgraph.sources.scratch import materialize


#: How much the bound of cost grows each time the k best paths are sought.
GROWTH = 1.25
#: Tables of bettered states that a round looks through before they are written together.
STATE_TABLES = 6


def distances(edges: DataFrame, starts: DataFrame, max_depth: int, paths: bool = True, within: float | None = None, target=None) -> DataFrame:
    """Least-cost walks of at most max_depth edges from every root: root, node, dist, hops (and path).

    edges: src, dst, w (not negative). starts: root, node. Ties go to fewer edges, then to the least path. Each round
    relaxes the edges of the nodes that got nearer in the last one and writes only the states that this betters, until
    none does. ``within`` drops walks that cost more. With a ``target`` (a node as a column) walks that have cost as much
    as the best one there is to it go no further, so the search ends early; then only the target's row is sure.
    """
    if edges.where(F.col("w") < 0).limit(1).count():
        raise ValueError("weights must not be negative")
    key, state_cols = ["root", "node"], ["dist", "hops", *(["path"] if paths else [])]
    first = starts.select(*key, F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), *([F.array("node").alias("path")] if paths else [])).distinct()
    state = F.struct(*state_cols)
    at_target = F.min(F.when(F.col("node") == target, F.col("dist"))) if target is not None else F.min(F.lit(None).cast("double"))
    fresh = materialize(first, near=at_target)
    better = [fresh]
    bound = fresh.seen["near"]

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.min("s").alias("s"))

    for _ in range(max_depth):
        front = fresh.df if bound is None else fresh.df.where(F.col("dist") < bound)
        met = front.join(edges, front["node"] == edges["src"])
        offers = met.select(
            "root", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"),
            *([F.array_append("path", F.col("dst")).alias("path")] if paths else []),
        )
        least = [x for x in (within, bound) if x is not None]
        if least:
            offers = offers.where(F.col("dist") <= min(least))
        offers = best(offers.select(*key, state.alias("s")))
        known = reduce(DataFrame.unionAll, [x.df for x in better]).select(*key, state.alias("was"))
        had = known.join(offers.select(*key), key, "left_semi").groupBy(*key).agg(F.min("was").alias("was"))
        news = offers.join(had, key, "left").where(F.col("was").isNull() | (F.col("s") < F.col("was"))).select(*key, "s.*")
        fresh = materialize(news, near=at_target)
        if not fresh.rows:
            fresh.drop()
            break
        if fresh.seen["near"] is not None:
            bound = fresh.seen["near"] if bound is None else min(bound, fresh.seen["near"])
        better.append(fresh)
        if len(better) > STATE_TABLES:
            merged = materialize(best(reduce(DataFrame.unionAll, [x.df for x in better]).select(*key, state.alias("s"))).select(*key, "s.*"))
            for x in better[:-1]:
                x.drop()
            better = [merged]
    return best(reduce(DataFrame.unionAll, [x.df for x in better]).select(*key, state.alias("s"))).select(*key, "s.*")


@dataclass
class PathResult:
    """path is None if there is none; nodes: position, node and the node table's columns, in path order; edges: position,
    from_id, to_id, weight."""

    path: list | None
    distance: float | None
    hops: int | None
    nodes: DataFrame | None
    edges: DataFrame | None
    excluded_nodes: tuple
    error: str | None = None


def _weighted(g: Graph) -> DataFrame:
    links = g.simple_edges()
    return links if g.weight else links.withColumn("w", F.lit(1.0))


def _graph(spark, nodes, edges, edge_from_col, edge_to_col, weight_col, id_column, excluded_nodes, soft_delete_column, sql_filter) -> Graph:
    return Graph.of(
        spark, nodes, edges, edge_from_col, edge_to_col, weight=weight_col, id_cols=id_column,
        excluded=tuple(excluded_nodes or ()), soft_delete=soft_delete_column, sql_filter=sql_filter,
    )


def path_distances(g: Graph, start_id: Any, max_depth: int | None = 20, limits: Limits = LIMITS) -> DataFrame:
    """node, dist, hops, path from one node to every node it reaches; without a weight every edge costs 1."""
    links = materialize(_weighted(g)).df
    start = g.spark.range(1).select(g.typed_id(start_id).alias("root"), g.typed_id(start_id).alias("node"))
    return distances(links, start, limits.depth(max_depth)).drop("root")


def shortest_path(
    spark: SparkSession, nodes: DataFrame | str | None, edges: DataFrame | str, edge_from_col, edge_to_col, start_id: Any, end_id: Any, weight_col: str | None = None, max_depth: int | None = 20,
    id_column: str | Sequence[str] = "id", excluded_nodes: Sequence | None = None, soft_delete_column: str | None = None, sql_filter: str | None = None, limits: Limits = LIMITS,
) -> PathResult:
    """The cheapest path of at most max_depth edges; fewest edges without a weight. start = end costs 0.

    Null weights are no edges, a weight of 0 is free, of parallel edges the cheapest counts. Ties go to fewer edges, then
    to the least path. Excluded nodes are not passed; an excluded end has no path.
    """
    g = _graph(spark, nodes, edges, edge_from_col, edge_to_col, weight_col, id_column, excluded_nodes, soft_delete_column, sql_filter)
    barred = tuple(excluded_nodes or ())
    if start_id in barred or end_id in barred:
        return PathResult(None, None, None, None, None, barred, "an end of the path is excluded")
    links = materialize(_weighted(g)).df
    begin, end = g.typed_id(start_id), g.typed_id(end_id)
    start = spark.range(1).select(begin.alias("root"), begin.alias("node"))
    found = distances(links, start, limits.depth(max_depth), target=end).where(F.col("node") == end).first()
    if found is None:
        return PathResult(None, None, None, None, None, barred, f"no path within {max_depth} edges")
    path = list(found["path"])
    steps = spark.range(1).select(F.posexplode(F.array(*[g.typed_id(tuple(x) if isinstance(x, tuple) else x) for x in path])).alias("position", "node"))
    rows = g.node_rows(steps).orderBy("position") if nodes is not None else steps
    pairs = steps.select(F.col("position"), F.col("node").alias("to_id")).join(steps.select((F.col("position") + 1).alias("position"), F.col("node").alias("from_id")), "position")
    on_path = pairs.join(links, (pairs["from_id"] == links["src"]) & (pairs["to_id"] == links["dst"])).select("position", "from_id", "to_id", F.col("w").alias("weight")).orderBy("position")
    return PathResult(path, float(found["dist"]), len(path) - 1, rows, on_path, barred)


def _first(rows: DataFrame, most: int | None) -> DataFrame:
    return rows if most is None else rows.limit(most)


def tied_paths(g: Graph, start_id: Any, end_id: Any, max_paths: int | None = 10, max_depth: int | None = 20, limits: Limits = LIMITS) -> DataFrame:
    """All cheapest paths: path, dist, hops, the first max_paths in order of path (None: all). Steps of weight 0 are taken once."""
    links = materialize(_weighted(g)).df
    depth = limits.depth(max_depth)
    start = g.spark.range(1).select(g.typed_id(start_id).alias("root"), g.typed_id(start_id).alias("node"))
    end = g.spark.range(1).select(g.typed_id(end_id).alias("root"), g.typed_id(end_id).alias("node"))
    ahead = distances(links, start, depth, False).select(F.col("node"), F.col("dist").alias("d0"))
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    behind = distances(turned, end, depth, False).select(F.col("node"), F.col("dist").alias("d1"))
    least = ahead.where(F.col("node") == g.typed_id(end_id)).first()
    if least is None:
        return ahead.select(F.array("node").alias("path"), F.col("d0").alias("dist"), F.lit(0).alias("hops")).limit(0)
    slack = F.lit(least["d0"] + 1e-9 * max(1.0, abs(least["d0"])))
    tight = (
        links.join(ahead.withColumnsRenamed({"node": "src"}), "src").join(behind.withColumnsRenamed({"node": "dst"}), "dst").where(F.col("d0") + F.col("w") + F.col("d1") <= slack).select("src", "dst", "w")
    )
    return _first(simple_paths(materialize(tight).df, start.select("node"), g.typed_id(end_id), depth, limits).orderBy("path"), max_paths)


def all_shortest_paths(
    spark: SparkSession, nodes: DataFrame | str | None, edges: DataFrame | str, edge_from_col, edge_to_col, start_id: Any, end_id: Any, weight_col: str | None = None, max_depth: int | None = 20, max_paths: int = 10,
    id_column: str | Sequence[str] = "id", excluded_nodes: Sequence | None = None, soft_delete_column: str | None = None, sql_filter: str | None = None,
) -> DataFrame:
    """path, dist, hops of every cheapest path, at most max_paths, the least first; no rows if there is no path."""
    g = _graph(spark, nodes, edges, edge_from_col, edge_to_col, weight_col, id_column, excluded_nodes, soft_delete_column, sql_filter)
    return tied_paths(g, start_id, end_id, max_paths, max_depth)


def _ways_to(links: DataFrame, goal: DataFrame, max_depth: int, within: float | None = None, costs: bool = True) -> DataFrame:
    """Links (src, dst, w) from which the goal (root, node) can be reached: with the fewest edges (still) and the least cost (owed) from dst on."""
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    steps = distances(turned.withColumn("w", F.lit(1.0)), goal, max_depth, False).select(F.col("node").alias("dst"), F.col("hops").alias("still"))
    ways = links.join(steps, "dst")
    if costs:
        ways = ways.join(distances(turned, goal, max_depth, False, within).select(F.col("node").alias("dst"), F.col("dist").alias("owed")), "dst")
    else:
        ways = ways.withColumn("owed", F.lit(0.0))
    return materialize(ways.select("src", "dst", "w", "still", "owed")).df


def _enumerated(ways: DataFrame, start: DataFrame, end, max_depth: int, limits: Limits, within: float | None) -> DataFrame:
    """Every simple path over _ways_to() from start (a column node) to the node ``end``: path, dist, hops."""
    level = materialize(start.select("node", F.array("node").alias("path"), F.lit(0.0).alias("dist"), F.lit(0).alias("hops")))
    done = [level.df.where(F.col("node") == end)]
    total = 0
    for hop in range(1, max_depth + 1):
        open_ = level.df.where(F.col("node") != end)
        met = open_.join(ways, (open_["node"] == ways["src"]) & (ways["still"] <= max_depth - hop)).where(~F.array_contains("path", F.col("dst")))
        if within is not None:
            # A little slack, as sums from either end may round apart; the paths themselves are held to the bound.
            met = met.where(F.col("dist") + F.col("w") + F.col("owed") <= within + 1e-9 * abs(within))
        level = materialize(met.select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(hop).alias("hops")))
        total += level.rows
        if level.rows == 0:
            break
        if total > limits.max_paths:
            raise SubgraphTooLarge(f"{total:,} simple paths, limit {limits.max_paths:,}; lower max_depth or the cost bound")
        done.append(level.df.where(F.col("node") == end))
    found = reduce(DataFrame.unionAll, done).select("path", "dist", "hops")
    return found if within is None else found.where(F.col("dist") <= within)


def simple_paths(links: DataFrame, start: DataFrame, end, max_depth: int, limits: Limits = LIMITS, within: float | None = None) -> DataFrame:
    """Every simple path from start (a column node) to the node ``end`` over links (src, dst, w): path, dist, hops.

    Only nodes are entered that can still reach the end in the edges left, and, where ``within`` bounds the cost, at the
    cost left. So what is enumerated is little more than what comes out.
    """
    goal = start.limit(1).select(end.alias("root"), end.alias("node"))
    return _enumerated(_ways_to(links, goal, max_depth, within, within is not None), start, end, max_depth, limits, within)


def paths_within(g: Graph, start_id: Any, end_id: Any, max_cost: float | None = None, max_depth: int | None = 10, limits: Limits = LIMITS) -> DataFrame:
    """Every simple path of at most max_depth edges and max_cost: path, dist, hops."""
    links = materialize(_weighted(g)).df
    start = g.spark.range(1).select(g.typed_id(start_id).alias("node"))
    return simple_paths(links, start, g.typed_id(end_id), limits.depth(max_depth), limits, max_cost)


def best_paths(g: Graph, start_id: Any, end_id: Any, k: int = 3, max_depth: int | None = 10, limits: Limits = LIMITS) -> DataFrame:
    """The k cheapest simple paths of at most max_depth edges: path, dist, hops, in order of (dist, hops, path).

    Paths are enumerated up to a bound of cost, which grows from the cheapest path's until k paths are within it or
    none is beyond it. What is owed to the end is worked out once.
    """
    links = materialize(_weighted(g)).df
    depth = limits.depth(max_depth)
    begin, end = g.typed_id(start_id), g.typed_id(end_id)
    start = g.spark.range(1).select(begin.alias("node"))
    ways = _ways_to(links, g.spark.range(1).select(end.alias("root"), end.alias("node")), depth)
    r = links.agg(F.sum("w").alias("total"), F.min(F.when(F.col("w") > 0, F.col("w"))).alias("least")).first()
    nearest = ways.where(F.col("src") == begin).agg(F.min(F.col("w") + F.col("owed"))).first()[0]
    total, bound = r["total"] or 0.0, (nearest or 0.0) * GROWTH  # no simple path costs more than all edges
    while True:
        found = materialize(_enumerated(ways, start, end, depth, limits, min(bound, total)))
        if found.rows >= k or bound >= total:
            return found.df.orderBy("dist", "hops", "path").limit(k)
        found.drop()
        bound = max(bound * GROWTH, bound + (r["least"] or 1.0))
