"""Graph operators over the driver's tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators import estimate as E
from relgraph.operators import network as N
from relgraph.operators import quality as V
from relgraph.operators.aggregate import aggregate_paths, extended_cost
from relgraph.operators.blocks import reach_counts
from relgraph.operators.model import LIMITS, Graph
from relgraph.operators.paths import PathResult, best_paths, path_distances, paths_within, shortest_path, tied_paths
from relgraph.operators.traverse import fetch_edges_for_frontier, fetch_nodes, multi_source, traverse, traverse_collecting, traverse_graph
from relgraph.sources.derived import DAG_SQL, DAG_TOP, NET_SQL, dag_edges, net_edges, net_graph, parts_graph, supplier_graph, valid_rows, valid_sql
from relgraph.sources.scratch import materialize
from relgraph.sources.copytext import copy_lines
from relgraph.sources.tables import table
from relgraph.streaming.degrees import run_available, streaming_degrees

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DEPTH = 4
AT = datetime.date(2020, 6, 30)


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


# Starts: the seller and the parent with most rows, ties by the smaller id. -------------------------------------------


def _busiest(df: DataFrame, col: str) -> int:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("k")).count().orderBy(F.desc("count"), "k").first()["k"]


def _busiest_sql(t: str, col: str) -> str:
    return f"(SELECT CAST({col} AS BIGINT) FROM {t} WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


SELLER = _busiest_sql("supplier_relationships", "seller_id")
PARENT = _busiest_sql("bill_of_materials", "parent_part_id")


def _seller(spark: SparkSession, d: str) -> int:
    return _busiest(table(spark, d, "supplier_relationships"), "seller_id")


def _parent(spark: SparkSession, d: str) -> int:
    return _busiest(table(spark, d, "bill_of_materials"), "parent_part_id")


def _edges_sql(t: str, a: str, b: str, where: str = "TRUE") -> str:
    return f"SELECT CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b FROM {t} AS e WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND ({where})"


REL = ("supplier_relationships", "seller_id", "buyer_id")
BOM = ("bill_of_materials", "parent_part_id", "child_part_id")


def _reach_sql(edges: str, start: str, depth: int, stop: str = "FALSE", extra: str = "") -> str:
    """Least depth per node by a recursive union over (node, depth)."""
    return f"""
WITH RECURSIVE {extra} e AS (SELECT DISTINCT a, b FROM ({edges})),
r AS (SELECT CAST({start} AS BIGINT) AS node, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < {depth} AND NOT ({stop})),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)"""


_MINE = "SELECT node, CAST(depth AS INTEGER) AS depth FROM m"


def _walk(direction: str = "outbound", graph=supplier_graph, start=_seller, depth: int = DEPTH, **options):
    graph_options = {k: options.pop(k) for k in ("soft_delete", "sql_filter", "at") if k in options}

    def run(spark: SparkSession, d: str) -> DataFrame:
        return traverse_graph(graph(spark, d, **graph_options), start(spark, d), direction, depth, **options).paths.select("node", "depth")

    return run


_both = f"{_edges_sql(*REL)} UNION ALL {_edges_sql(REL[0], REL[2], REL[1])}"
_add("g1_traverse_outbound", _walk(), _reach_sql(_edges_sql(*REL), SELLER, DEPTH) + _MINE)
_add("g1_traverse_inbound", _walk("inbound", start=lambda s, d: _busiest(table(s, d, REL[0]), "buyer_id"), depth=2), _reach_sql(_edges_sql(REL[0], REL[2], REL[1]), _busiest_sql(REL[0], "buyer_id"), 2) + _MINE)
_add("g1_traverse_both", _walk("both", depth=2), _reach_sql(_both, SELLER, 2) + _MINE)
_live = f"v AS (SELECT id FROM {valid_sql('suppliers')} WHERE deleted_at IS NULL),"
_add("g1_traverse_soft_delete", _walk(soft_delete="deleted_at"), _reach_sql(_edges_sql(*REL, "seller_id IN (SELECT id FROM v) AND buyer_id IN (SELECT id FROM v)"), SELLER, DEPTH, extra=_live) + _MINE)
_valid = "(contract_start_date IS NULL OR contract_start_date <= DATE '2020-06-30') AND (contract_end_date IS NULL OR contract_end_date >= DATE '2020-06-30')"
_add("g1_traverse_valid_at", _walk(at=AT), _reach_sql(_edges_sql(*REL, _valid), SELLER, DEPTH) + _MINE)
_add(
    "g1_traverse_prefilter",
    lambda s, d: traverse(s, (g := supplier_graph(s, d)).nodes, g.edges, "seller_id", "buyer_id", _seller(s, d), max_depth=DEPTH, prefilter_sql="e.is_primary", sql_filter="e.relationship_status = 'active'").paths.select("node", "depth"),
    _reach_sql(_edges_sql(*REL, "e.is_primary AND e.relationship_status = 'active'"), SELLER, DEPTH) + _MINE,
)
_add("g1_traverse_sql_filter", _walk(sql_filter="e.relationship_status = 'active'"), _reach_sql(_edges_sql(*REL, "e.relationship_status = 'active'"), SELLER, DEPTH) + _MINE)
_stops = f"s AS (SELECT id FROM {valid_sql('suppliers')} WHERE tier = 1),"
_add("g1_traverse_stop", _walk(stop_condition="tier = 1"), _reach_sql(_edges_sql(*REL), SELLER, DEPTH, "r.node IN (SELECT id FROM s)", _stops) + _MINE)
_add("g1_explosion", _walk(graph=parts_graph, start=_parent, depth=50), _reach_sql(_edges_sql(*BOM), PARENT, 50) + _MINE)
_add("g1_where_used", _walk("inbound", parts_graph, lambda s, d: _busiest(table(s, d, BOM[0]), BOM[2]), 50), _reach_sql(_edges_sql(BOM[0], BOM[2], BOM[1]), _busiest_sql(BOM[0], BOM[2]), 50) + _MINE)
_eff = "(effective_from IS NULL OR effective_from <= DATE '2020-06-30') AND (effective_to IS NULL OR effective_to >= DATE '2020-06-30')"
_add("g1_explosion_valid_at", _walk(graph=parts_graph, start=_parent, depth=50, at=AT), _reach_sql(_edges_sql(*BOM, _eff), PARENT, 50) + _MINE)


def g1_traverse_paths(spark: SparkSession, d: str) -> DataFrame:
    r = traverse_graph(parts_graph(spark, d), _parent(spark, d), max_depth=3)
    return r.paths.select("node", F.array_join("path", "/").alias("path"))


_add(
    "g1_traverse_paths", g1_traverse_paths,
    f"""WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM ({_edges_sql(*BOM)})),
r AS (SELECT {PARENT} AS node, [{PARENT}] AS path UNION ALL SELECT e.b, list_append(r.path, e.b) FROM r JOIN e ON e.a = r.node WHERE len(r.path) <= 3 AND NOT list_contains(r.path, e.b))
SELECT node, array_to_string(arg_min(path, (len(path), path)), '/') AS path FROM r GROUP BY node""",
)


def g1_traverse_rows(spark: SparkSession, d: str) -> DataFrame:
    """The traversal through its full signature, with node columns."""
    g = supplier_graph(spark, d)
    r = traverse(spark, g.nodes, g.edges, "seller_id", "buyer_id", _seller(spark, d), max_depth=DEPTH, collect_columns=["name", "tier"], include_start=False, order_by="tier DESC, name")
    return r.nodes.select("node", "depth", "name", "tier")


_add(
    "g1_traverse_rows", g1_traverse_rows,
    _reach_sql(_edges_sql(*REL), SELLER, DEPTH) + f"SELECT m.node, CAST(m.depth AS INTEGER) AS depth, v.name, v.tier FROM m JOIN {valid_sql('suppliers')} AS v ON v.id = m.node WHERE m.depth > 0",
)


def g2_traverse_collecting(spark: SparkSession, d: str) -> DataFrame:
    g = supplier_graph(spark, d)
    r = traverse_collecting(spark, g.nodes, g.edges, "seller_id", "buyer_id", _seller(spark, d), "credit_rating = 'A'", max_depth=DEPTH)
    return r.nodes.select("node", "depth", "credit_rating")


_add(
    "g2_traverse_collecting", g2_traverse_collecting,
    _reach_sql(_edges_sql(*REL), SELLER, DEPTH)
    + f"SELECT m.node, CAST(m.depth AS INTEGER) AS depth, v.credit_rating FROM m JOIN {valid_sql('suppliers')} AS v ON v.id = m.node WHERE m.depth > 0 AND v.credit_rating = 'A'",
)

# Path aggregation --------------------------------------------------------------------------------------------------

#: Levels that the SQL of path aggregations goes down; the structure over part has one more for every doubling of parts.
LEVELS = 16
_SUMS = {
    "sum": "sum(w.value + w.paths * e.q) AS value, sum(w.paths) AS paths",
    "multiply": "sum(w.value * e.q) AS value, sum(w.paths) AS paths",
    "max": "max(greatest(w.value, e.q)) AS value, sum(w.paths) AS paths",
    "min": "min(least(w.value, e.q)) AS value, sum(w.paths) AS paths",
    "count": "min(w.value + 1) AS value, sum(w.paths) AS paths",
}
_FOLD = {"sum": "sum", "multiply": "sum", "max": "max", "min": "min", "count": "min"}


def _levels_sql(operation: str, edges: str = DAG_SQL, start: object = DAG_TOP, levels: int = LEVELS) -> str:
    """CTEs w0, w1, ...: one row per node and level of an acyclic graph; t: the values of all nodes."""
    first = {"sum": "0", "multiply": "1", "max": "NULL", "min": "NULL", "count": "0"}[operation]
    steps = ", ".join(
        f"w{k + 1} AS MATERIALIZED (SELECT e.b AS node, {_SUMS[operation]} FROM w{k} AS w JOIN e ON e.a = w.node GROUP BY e.b)" for k in range(levels)
    )
    every = " UNION ALL ".join(f"SELECT node, value FROM w{k + 1}" for k in range(levels))
    return f"""WITH e AS MATERIALIZED (SELECT src AS a, dst AS b, CAST(qty AS DOUBLE) AS q FROM {edges}), w0 AS (SELECT CAST({start} AS BIGINT) AS node, CAST({first} AS DOUBLE) AS value, CAST(1 AS DOUBLE) AS paths),
{steps}, t AS (SELECT node, {_FOLD[operation]}(value) AS value FROM ({every}) GROUP BY node) """


def _aggregate(operation: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = Graph.of(spark, None, dag_edges(spark, d), "src", "dst")
        return aggregate_paths(g, DAG_TOP, "qty", operation, max_depth=None).select("node", "value")

    return run


for _op in _FOLD:
    _add(f"g3_path_{_op}", _aggregate(_op), _levels_sql(_op) + "SELECT node, value FROM t")


def g3_cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Cost of one of the top part, to six digits."""
    g = Graph.of(spark, None, dag_edges(spark, d), "src", "dst")
    totals = aggregate_paths(g, DAG_TOP, "qty", "multiply", max_depth=None)
    cost = extended_cost(totals, table(spark, d, "part"), "p_partkey", "p_retailprice")
    return cost.select(F.round(F.log10("total_cost"), 6).alias("log_cost"))


_add("g3_cost_rollup", g3_cost_rollup, _levels_sql("multiply") + "SELECT round(log10(sum(t.value * p.p_retailprice)), 6) AS log_cost FROM t JOIN part AS p ON p.p_partkey = t.node")


def g3_path_depth_limit(spark: SparkSession, d: str) -> DataFrame:
    """Quantities over paths of at most three links of the bill of materials as recorded, cycles and all."""
    return aggregate_paths(parts_graph(spark, d), _parent(spark, d), "quantity", "multiply", max_depth=3).select("node", "value")


_add(
    "g3_path_depth_limit", g3_path_depth_limit,
    f"""WITH RECURSIVE e AS (SELECT CAST(parent_part_id AS BIGINT) AS a, CAST(child_part_id AS BIGINT) AS b, CAST(quantity AS DOUBLE) AS q FROM bill_of_materials WHERE parent_part_id IS NOT NULL AND child_part_id IS NOT NULL),
w AS (SELECT b AS node, [a, b] AS path, q AS value FROM e WHERE a = {PARENT} AND a <> b
  UNION ALL SELECT e.b, list_append(w.path, e.b), w.value * e.q FROM w JOIN e ON e.a = w.node WHERE len(w.path) <= 3 AND NOT list_contains(w.path, e.b))
SELECT node, coalesce(sum(value), 0.0) AS value FROM w GROUP BY node""",
)


def whole_explosion(spark: SparkSession, d: str) -> DataFrame:
    """node, depth, value: quantities of the bill of materials as recorded, to its full depth."""
    return aggregate_paths(parts_graph(spark, d), _parent(spark, d), "quantity", "multiply", max_depth=None)


# Simple paths through the cycles of the whole structure are beyond SQL; brute force on small graphs checks them.
_add("g3_real_explosion", lambda s, d: whole_explosion(s, d).select("node", "value"))

# Shortest paths ----------------------------------------------------------------------------------------------------

_END = "(SELECT max(s_suppkey) // 2 FROM supplier)"
_START = "CAST(0 AS BIGINT)"
#: Rounds of relaxation in SQL: more than any cheapest way over the test data has edges.
ROUNDS = 12


def _end(spark: SparkSession, d: str) -> int:
    return table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] // 2


def _relaxed_sql(name: str, edges: str, start: str, rounds: int = ROUNDS, turned: bool = False) -> str:
    """CTEs name0, name1, ...: least (dist, hops, path) of every node over at most so many edges (src, dst, w) from start."""
    a, b = ("dst", "src") if turned else ("src", "dst")
    steps = ", ".join(
        f"{name}{k + 1} AS MATERIALIZED (SELECT node, s.dist AS dist, s.hops AS hops, s.path AS path FROM (SELECT node, min({{'dist': dist, 'hops': hops, 'path': path}}) AS s FROM "
        f"(SELECT * FROM {name}{k} UNION ALL SELECT e.{b}, x.dist + e.w, x.hops + 1, list_append(x.path, e.{b}) FROM {name}{k} AS x JOIN {edges} AS e ON e.{a} = x.node) GROUP BY node))"
        for k in range(rounds)
    )
    return f"{name}0 AS (SELECT {start} AS node, CAST(0 AS DOUBLE) AS dist, 0 AS hops, [{start}] AS path), {steps}"


def _net_sql(weight: str = "q", where: str = "TRUE") -> str:
    return f"WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, CAST({weight} AS DOUBLE) AS w FROM {NET_SQL} WHERE {where}), "


_LAST = f"d{ROUNDS}"
_SHOW = "array_to_string(path, '/') AS path"
_DISTANCES_SQL = _net_sql() + _relaxed_sql("d", "e", _START)
_FIRST_HUB = f"(SELECT min(dst) FROM e WHERE src = 0 AND dst <> {_END})"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("path", "/").alias("path"), F.col("dist").cast("double").alias("dist"), F.col("hops").cast("int").alias("hops"))


def _path(spark: SparkSession, d: str, weight: str | None, excluded: bool = False, max_depth: int | None = None) -> PathResult:
    """The cheapest way from the first to the middle supplier; excluded: not over the first neighbour."""
    end = _end(spark, d)
    edges = net_edges(spark, d)
    out = [edges.where((F.col("src") == 0) & (F.col("dst") != end)).agg(F.min("dst")).first()[0]] if excluded else None
    return shortest_path(spark, table(spark, d, "supplier"), edges, "src", "dst", 0, end, weight, max_depth, "s_suppkey", out)


def _one_path(weight: str | None, excluded: bool = False, max_depth: int | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        r = _path(spark, d, weight, excluded, max_depth)
        rows = [("/".join(map(str, r.path)), r.distance, r.hops)] if r.path else []
        return spark.createDataFrame(rows, "path string, dist double, hops int")

    return run


_add("g4_shortest_path_weighted", _one_path("q"), f"{_DISTANCES_SQL} SELECT {_SHOW}, dist, hops FROM {_LAST} WHERE node = {_END}")
_add("g4_shortest_path_hops", _one_path(None), f"{_net_sql('1')}{_relaxed_sql('d', 'e', _START)} SELECT {_SHOW}, dist, hops FROM {_LAST} WHERE node = {_END}")
_add(
    "g4_shortest_path_excluded", _one_path("q", True),
    f"{_net_sql()} x AS MATERIALIZED (SELECT * FROM e WHERE src <> {_FIRST_HUB} AND dst <> {_FIRST_HUB}), {_relaxed_sql('d', 'x', _START)} SELECT {_SHOW}, dist, hops FROM {_LAST} WHERE node = {_END}",
)
_add("g4_shortest_path_two_edges", _one_path("q", max_depth=2), f"{_net_sql()}{_relaxed_sql('d', 'e', _START, 2)} SELECT {_SHOW}, dist, hops FROM d2 WHERE node = {_END}")
_add("g4_path_edges", lambda s, d: _path(s, d, "q").edges, f"""{_DISTANCES_SQL}, p AS (SELECT path, unnest(range(1, len(path))) AS position FROM {_LAST} WHERE node = {_END})
SELECT CAST(p.position AS INTEGER) AS position, e.src AS from_id, e.dst AS to_id, e.w AS weight FROM p JOIN e ON e.src = p.path[p.position] AND e.dst = p.path[p.position + 1]""")
_add("g4_path_nodes", lambda s, d: _path(s, d, "q").nodes.select("position", "node", "s_name"), f"""{_DISTANCES_SQL}, p AS (SELECT path, unnest(range(1, len(path) + 1)) AS position FROM {_LAST} WHERE node = {_END})
SELECT CAST(p.position - 1 AS INTEGER) AS position, s.s_suppkey AS node, s.s_name FROM p JOIN supplier AS s ON s.s_suppkey = p.path[p.position]""")
_add(
    "g4_distances", lambda s, d: path_distances(net_graph(s, d, weight="q"), 0, None).select("node", "dist", F.array_join("path", "/").alias("path")),
    f"{_DISTANCES_SQL} SELECT node, dist, {_SHOW} FROM {_LAST}",
)
_TIED = f"""{_net_sql('1')}{_relaxed_sql('d', 'e', _START)}, {_relaxed_sql('b', 'e', _END, turned=True)},
tight AS MATERIALIZED (SELECT e.src, e.dst FROM e JOIN {_LAST} AS x ON x.node = e.src JOIN b{ROUNDS} AS y ON y.node = e.dst WHERE x.dist + 1 + y.dist = (SELECT dist FROM {_LAST} WHERE node = {_END})),
w AS (SELECT {_START} AS node, [{_START}] AS path UNION ALL SELECT t.dst, list_append(w.path, t.dst) FROM w JOIN tight AS t ON t.src = w.node)
SELECT {_SHOW}, CAST(len(path) - 1 AS DOUBLE) AS dist, CAST(len(path) - 1 AS INTEGER) AS hops FROM w WHERE node = {_END} ORDER BY w.path"""
_add("g5_all_shortest_paths", lambda s, d: _shown(tied_paths(net_graph(s, d), 0, _end(s, d), None, None)), _TIED)
_add("g5_first_shortest_paths", lambda s, d: _shown(tied_paths(net_graph(s, d), 0, _end(s, d), 10, None)), _TIED + " LIMIT 10")
#: Every simple path of a bounded cost, by way of what is still owed to the end.
_BOUNDED = f"""{_DISTANCES_SQL}, {_relaxed_sql('b', 'e', _END, turned=True)}, best AS (SELECT dist FROM {_LAST} WHERE node = {_END}),
w AS (SELECT {_START} AS node, [{_START}] AS path, CAST(0 AS DOUBLE) AS dist
  UNION ALL SELECT e.dst, list_append(w.path, e.dst), w.dist + e.w FROM w JOIN e ON e.src = w.node JOIN b{ROUNDS} AS y ON y.node = e.dst JOIN best ON w.dist + e.w + y.dist <= 1.5 * best.dist
  WHERE w.node <> {_END} AND NOT list_contains(w.path, e.dst))
SELECT {_SHOW}, dist, CAST(len(path) - 1 AS INTEGER) AS hops FROM w WHERE node = {_END}"""
_add("g5_best_paths", lambda s, d: _shown(best_paths(net_graph(s, d, weight="q"), 0, _end(s, d), 3, None)), f"{_BOUNDED} ORDER BY dist, hops, w.path LIMIT 3")


def g5_paths_within(spark: SparkSession, d: str) -> DataFrame:
    """Every path that costs at most half as much again as the cheapest."""
    g, end = net_graph(spark, d, weight="q"), _end(spark, d)
    best = path_distances(g, 0, None).where(F.col("node") == end).first()
    return _shown(paths_within(g, 0, end, 1.5 * best["dist"] if best else 0.0, None))


_add("g5_paths_within", g5_paths_within, _BOUNDED)


def _multi_depth(graph):
    def run(spark: SparkSession, d: str) -> DataFrame:
        starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("root"))
        links = materialize(graph(spark, d).simple_edges().select("src", "dst"))
        if links.rows > LIMITS.max_task_edges:
            return multi_source(graph(spark, d), starts, max_depth=DEPTH).groupBy("root").agg(F.count(F.lit(1)).alias("reached"), F.max("depth").alias("depth"))
        found, _ = reach_counts(links.df, DEPTH)
        per = found.groupBy("root").agg(F.sum("n").alias("more"), F.max("depth").alias("deepest"))
        return starts.distinct().join(per, "root", "left").select("root", (F.coalesce("more", F.lit(0)) + 1).alias("reached"), F.coalesce("deepest", F.lit(0)).alias("depth"))

    return run


_add(
    "g1_multi_source_depth", _multi_depth(net_graph),
    f"""WITH RECURSIVE e AS (SELECT src, dst FROM {NET_SQL}),
r AS (SELECT s_suppkey AS root, s_suppkey AS node, 0 AS depth FROM supplier UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {DEPTH}),
m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node)
SELECT root, count(*) AS reached, CAST(max(depth) AS INTEGER) AS depth FROM m GROUP BY root""",
)

# Whole graph -------------------------------------------------------------------------------------------------------

_REL_EDGES = f"e AS (SELECT DISTINCT a, b FROM ({_edges_sql(*REL)}))"
_ENDS = "n AS (SELECT a AS node FROM e UNION SELECT b FROM e)"


def _score(kind: str, graph=net_graph, **options):
    return lambda s, d: N.scores_of(graph(s, d, **options), kind).select("node", F.round("score", 8).alias("score"))


_add("g6_degree", _score("degree", supplier_graph), f"WITH {_REL_EDGES}, {_ENDS} SELECT node, round(count(*) / ((SELECT count(*) FROM n) - 1.0), 8) AS score FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node")
_add(
    "g6_closeness", _score("closeness"),
    f"""WITH RECURSIVE e AS (SELECT src, dst FROM {NET_SQL}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r AS (SELECT node AS root, node, 0 AS depth FROM n UNION SELECT r.root, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 8),
m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node),
t AS (SELECT root, count(*) - 1 AS reached, sum(depth) AS far FROM m GROUP BY root)
SELECT root AS node, round(CASE WHEN far > 0 THEN reached / CAST(far AS DOUBLE) * reached / ((SELECT count(*) FROM n) - 1.0) ELSE 0.0 END, 8) AS score FROM t""",
)
#: Levels of a search in SQL: more than the network is deep over the test data.
WIDE = 6
_BRANDES = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {NET_SQL}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r AS (SELECT node AS root, node, 0 AS depth FROM n UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < {WIDE}),
m AS MATERIALIZED (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node),
t AS MATERIALIZED (SELECT a.root, a.node AS src, b.node AS dst, b.depth FROM m AS a JOIN e ON e.src = a.node JOIN m AS b ON b.root = a.root AND b.node = e.dst AND b.depth = a.depth + 1),
s0 AS (SELECT node AS root, node, CAST(1 AS DOUBLE) AS ways FROM n), """ + ", ".join(
    f"s{k} AS MATERIALIZED (SELECT t.root, t.dst AS node, sum(s.ways) AS ways FROM t JOIN s{k - 1} AS s ON s.root = t.root AND s.node = t.src WHERE t.depth = {k} GROUP BY t.root, t.dst)" for k in range(1, WIDE + 1)
) + f", o{WIDE} AS (SELECT root, node, ways, CAST(0 AS DOUBLE) AS owed FROM s{WIDE}), " + ", ".join(
    f"o{k} AS MATERIALIZED (SELECT s.root, s.node, any_value(s.ways) AS ways, coalesce(sum(s.ways / o.ways * (1 + o.owed)), 0.0) AS owed FROM s{k} AS s LEFT JOIN t ON t.root = s.root AND t.src = s.node AND t.depth = {k + 1} "
    f"LEFT JOIN o{k + 1} AS o ON o.root = t.root AND o.node = t.dst GROUP BY s.root, s.node)" for k in range(WIDE - 1, 0, -1)
) + " SELECT n.node, round(coalesce(sum(o.owed), 0.0) / (((SELECT count(*) FROM n) - 1.0) * ((SELECT count(*) FROM n) - 2.0)), 8) AS score FROM n LEFT JOIN (" + " UNION ALL ".join(
    f"SELECT * FROM o{k}" for k in range(1, WIDE + 1)
) + ") AS o ON o.node = n.node AND o.root <> o.node GROUP BY n.node"
_add("g6_betweenness", _score("betweenness"), _BRANDES)
_add("g6_betweenness_weighted", _score("betweenness", weight="q"))


def _top(spark: SparkSession, d: str) -> DataFrame:
    """The five suppliers with most partners, through the full signature."""
    r = N.centrality(spark, table(spark, d, "supplier"), net_edges(spark, d), "src", "dst", "degree", 5, id_column="s_suppkey")
    s = r.graph_stats
    return r.results.select("node", "s_name", F.round("score", 8).alias("score"), F.lit(s["nodes"]).cast("long").alias("nodes"), F.lit(s["edges"]).cast("long").alias("edges"), F.lit(s["is_connected"]).alias("connected"))


_add("g6_top_nodes", _top, f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {NET_SQL}), {_ENDS}, k AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node),
u AS (SELECT min(a) AS node FROM e UNION SELECT x.v FROM u JOIN (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e) AS x ON x.u = u.node)
SELECT k.node, s.s_name, round(k.d / ((SELECT count(*) FROM n) - 1.0), 8) AS score, (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM u) = (SELECT count(*) FROM n) AS connected
FROM k JOIN supplier AS s ON s.s_suppkey = k.node ORDER BY score DESC, k.node LIMIT 5""")


def _ranks_sql(rounds: int) -> str:
    return "".join(
        f", s{i + 1} AS MATERIALIZED (SELECT n.node, 0.15 / c.n + 0.85 * (coalesce(g.got, 0.0) + coalesce((SELECT sum(score) FROM s{i} WHERE node NOT IN (SELECT src FROM o)), 0.0) / c.n) AS score "
        f"FROM n CROSS JOIN c LEFT JOIN (SELECT e.dst AS node, sum(s.score / o.k) AS got FROM e JOIN o ON o.src = e.src JOIN s{i} AS s ON s.node = e.src GROUP BY e.dst) AS g ON g.node = n.node)"
        for i in range(rounds)
    )


_RANKS = f"""WITH e AS MATERIALIZED (SELECT src, dst FROM {NET_SQL}), n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT count(*) AS n FROM n), o AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src),
s0 AS (SELECT node, 1.0 / c.n AS score FROM n CROSS JOIN c)"""
_add("g6_pagerank", _score("pagerank"), f"{_RANKS}{_ranks_sql(24)}" + "".join(
    f", m{i} AS (SELECT sum(abs(a.score - b.score)) < 1e-6 * count(*) AS done FROM s{i} AS a JOIN s{i - 1} AS b ON b.node = a.node)" for i in range(4, 25, 4)
) + " SELECT node, round(score, 8) AS score FROM (" + " UNION ALL ".join(
    f"SELECT node, score FROM s{i} WHERE (SELECT done FROM m{i}){''.join(f' AND NOT (SELECT done FROM m{j})' for j in range(4, i, 4))}" for i in range(4, 25, 4)
) + ")")
_add(
    "g6_pagerank_8_rounds", lambda s, d: N.pagerank(net_graph(s, d).simple_edges(), tolerance=0.0, iterations=8).select("node", F.round("score", 8).alias("score")),
    f"{_RANKS}{_ranks_sql(8)} SELECT node, round(score, 8) AS score FROM s8",
)
_LABELS = """r AS (SELECT node AS root, node FROM n UNION SELECT r.root, x.v FROM r JOIN (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e) AS x ON x.u = r.node),
l AS (SELECT root AS node, min(node) AS component FROM r GROUP BY root)"""
_add(
    "g7_connected_components", lambda s, d: N.components_of(supplier_graph(s, d)).select("component", "size"),
    f"WITH RECURSIVE {_REL_EDGES}, {_ENDS}, {_LABELS} SELECT component, count(*) AS size FROM l GROUP BY component",
)
_add(
    "g7_isolates", lambda s, d: N.isolates(supplier_graph(s, d)),
    f"WITH {_REL_EDGES}, {_ENDS} SELECT DISTINCT id AS node FROM suppliers WHERE id IS NOT NULL AND id NOT IN (SELECT node FROM n)",
)


def g8_graph_density(spark: SparkSession, d: str) -> DataFrame:
    s = N.graph_density(spark, net_edges(spark, d), "src", "dst")
    row = (s["nodes"], s["edges"], round(s["density"], 8), s["is_weakly_connected"], s.get("is_strongly_connected"), round(s["avg_degree"], 6), s["max_degree"], s["min_degree"])
    return spark.createDataFrame([row], "nodes long, edges long, density double, weak boolean, strong boolean, avg_degree double, max_degree long, min_degree long")


_add(
    "g8_graph_density", g8_graph_density,
    f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {NET_SQL}), {_ENDS}, z AS (SELECT min(a) AS root FROM e),
u AS (SELECT root AS node FROM z UNION SELECT x.v FROM u JOIN (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e) AS x ON x.u = u.node),
f AS (SELECT root AS node FROM z UNION SELECT e.b FROM f JOIN e ON e.a = f.node), g AS (SELECT root AS node FROM z UNION SELECT e.a FROM g JOIN e ON e.b = g.node),
c AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges), k AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
SELECT nodes, edges, round(edges / (nodes * (nodes - 1.0)), 8) AS density, (SELECT count(*) FROM u) = nodes AS weak,
  CASE WHEN (SELECT count(*) FROM u) = nodes THEN (SELECT count(*) FROM f) = nodes AND (SELECT count(*) FROM g) = nodes END AS strong,
  (SELECT round(avg(d), 6) FROM k) AS avg_degree, (SELECT max(d) FROM k) AS max_degree, (SELECT min(d) FROM k) AS min_degree FROM c""",
)


def g9_neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = supplier_graph(spark, d)
    r = N.neighbors(spark, g.nodes, g.edges, "seller_id", "buyer_id", _seller(spark, d))
    return r.neighbors.select("node", "name", F.lit(r.outbound_count).cast("long").alias("out_edges"), F.lit(r.inbound_count).cast("long").alias("in_edges"), F.lit(r.total_degree).cast("long").alias("total_degree"))


_add(
    "g9_neighbors", g9_neighbors,
    f"""WITH x AS ({_edges_sql(*REL)}), o AS (SELECT b AS node FROM x WHERE a = {SELLER}), i AS (SELECT a AS node FROM x WHERE b = {SELLER}), u AS (SELECT node FROM o UNION SELECT node FROM i)
SELECT u.node, v.name, (SELECT count(*) FROM o) AS out_edges, (SELECT count(*) FROM i) AS in_edges, (SELECT count(*) FROM u) AS total_degree FROM u JOIN {valid_sql('suppliers')} AS v ON v.id = u.node""",
)


def g10_resilience(spark: SparkSession, d: str) -> DataFrame:
    hub = _busiest(table(spark, d, "supplier_relationships"), "buyer_id")
    g = supplier_graph(spark, d)
    r = N.resilience_analysis(spark, None, g.edges, "seller_id", "buyer_id", hub)
    row = (int(r.node_removed), r.components_before, r.components_after, r.isolated_nodes.count(), r.affected_node_count, r.is_critical)
    return spark.createDataFrame([row], "node long, before long, after long, isolated long, affected long, critical boolean")


_HUB = _busiest_sql(REL[0], "buyer_id")
_add(
    "g10_resilience", g10_resilience,
    f"""WITH RECURSIVE {_REL_EDGES}, {_ENDS}, h AS (SELECT {_HUB} AS hub), s AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
b0 AS (SELECT node AS root, node FROM n UNION SELECT r.root, s.v FROM b0 AS r JOIN s ON s.u = r.node),
b1 AS (SELECT node AS root, node FROM n, h WHERE node <> hub UNION SELECT r.root, s.v FROM b1 AS r JOIN s ON s.u = r.node, h WHERE s.v <> hub),
l0 AS (SELECT root, min(node) AS c FROM b0 GROUP BY root), l1 AS (SELECT root, min(node) AS c FROM b1 GROUP BY root),
k AS (SELECT DISTINCT s.v AS node, l1.c FROM s JOIN h ON s.u = hub JOIN l1 ON l1.root = s.v WHERE s.v <> hub),
lone AS (SELECT node FROM k WHERE node NOT IN (SELECT u FROM s, h WHERE v <> hub)),
t AS (SELECT (SELECT count(DISTINCT c) FROM l0) AS before, (SELECT count(DISTINCT c) FROM l1) AS after, (SELECT count(*) FROM lone) AS isolated)
SELECT h.hub AS node, before, after, isolated, (SELECT count(*) FROM k AS x WHERE (after > before AND EXISTS (SELECT 1 FROM k AS y WHERE y.c <> x.c)) OR x.node IN (SELECT node FROM lone)) AS affected,
  after > before OR isolated > 0 AS critical FROM t, h""",
)



def _hub_removed(spark: SparkSession, d: str):
    g = supplier_graph(spark, d)
    return N.resilience_analysis(spark, None, g.edges, "seller_id", "buyer_id", _busiest(table(spark, d, "supplier_relationships"), "buyer_id"))


def g10_parts(spark: SparkSession, d: str) -> DataFrame:
    """The parts that the hub's neighbours fall into without it: pairs of neighbours in different parts are cut off from each other."""
    r = _hub_removed(spark, d)
    return r.parts.groupBy("part").agg(F.max("part_size").alias("part_size"), F.count(F.lit(1)).alias("neighbours")).withColumn("pairs_cut", F.lit(r.pairs_cut).cast("long"))


_APART = f"""WITH RECURSIVE {_REL_EDGES}, h AS (SELECT {_HUB} AS hub), s AS MATERIALIZED (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
k0 AS (SELECT DISTINCT s.v AS node FROM s, h WHERE s.u = hub AND s.v <> hub),
x AS (SELECT node AS root, node FROM k0 UNION SELECT x.root, s.v FROM x JOIN s ON s.u = x.node, h WHERE s.v <> hub), k AS MATERIALIZED (SELECT root AS node, min(node) AS part FROM x GROUP BY root)"""
_add(
    "g10_parts", g10_parts,
    f"{_APART}, z AS (SELECT part, count(*) AS c FROM k GROUP BY part) SELECT part, c AS part_size, c AS neighbours, CAST(((SELECT count(*) FROM k) ** 2 - (SELECT sum(c * c) FROM z)) // 2 AS BIGINT) AS pairs_cut FROM z",
)
_add("g10_disconnected_pairs", lambda s, d: _hub_removed(s, d).disconnected_pairs, f"{_APART} SELECT x.node AS a, y.node AS b FROM k AS x JOIN k AS y ON x.node < y.node AND x.part <> y.part")

# Fetch primitives, estimator ---------------------------------------------------------------------------------------


def s2_frontier_edges(spark: SparkSession, d: str) -> DataFrame:
    front = table(spark, d, "suppliers").where("tier = 1").select(F.col("id").alias("node")).distinct()
    g = supplier_graph(spark, d)
    return fetch_edges_for_frontier(spark, g.edges, front, "seller_id", "buyer_id", "inbound").groupBy("to_id").agg(F.count(F.lit(1)).alias("n"))


_add("s2_frontier_edges", s2_frontier_edges, f"WITH x AS ({_edges_sql(*REL)}) SELECT b AS to_id, count(*) AS n FROM x WHERE b IN (SELECT id FROM suppliers WHERE tier = 1) GROUP BY b")


def _front(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "suppliers").where("tier = 1").select(F.col("id").alias("node")).distinct()


_TIER1 = "(SELECT id FROM suppliers WHERE tier = 1)"
_add(
    "s2_frontier_both", lambda s, d: fetch_edges_for_frontier(s, supplier_graph(s, d).edges, _front(s, d), "seller_id", "buyer_id", "both").groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n")),
    f"WITH x AS ({_edges_sql(*REL)}) SELECT a AS from_id, b AS to_id, count(*) AS n FROM x WHERE a IN {_TIER1} OR b IN {_TIER1} GROUP BY a, b",
)
_add(
    "s3_fetch_nodes", lambda s, d: fetch_nodes(s, valid_rows(table(s, d, "suppliers")), _front(s, d), ["id", "name", "tier"], soft_delete_column="deleted_at", order_by="tier DESC, name"),
    f"SELECT id, name, tier FROM {valid_sql('suppliers')} WHERE deleted_at IS NULL AND id IN {_TIER1}",
)
_add(
    "s4_weighted_frontier", lambda s, d: fetch_edges_for_frontier(s, net_edges(s, d), table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node")), "src", "dst", weight_col="q"),
    f"SELECT src AS from_id, dst AS to_id, q AS w FROM {NET_SQL} WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)",
)


def e1_sample(spark: SparkSession, d: str) -> DataFrame:
    r = E.GraphSampler(spark, parts_graph(spark, d).edges, "parent_part_id", "child_part_id").sample(_parent(spark, d), 3)
    sizes = r.level_sizes + [0] * (4 - len(r.level_sizes))
    return spark.createDataFrame([(r.visited_count, *sizes, r.edges_seen)], "visited long, l0 long, l1 long, l2 long, l3 long, edges_seen long")


_add(
    "e1_sample", e1_sample,
    _reach_sql(_edges_sql(*BOM), PARENT, 3)
    + """SELECT count(*) AS visited, count(*) FILTER (depth = 0) AS l0, count(*) FILTER (depth = 1) AS l1, count(*) FILTER (depth = 2) AS l2, count(*) FILTER (depth = 3) AS l3,
  (SELECT count(*) FROM e JOIN m AS x ON x.node = e.a WHERE x.depth < 3) AS edges_seen FROM m""",
)


#: Levels sampled, and the depth and size that estimates are asked for.
SAMPLE, AHEAD, ALLOWED = 3, 8, 40


def _samples(spark: SparkSession, d: str) -> list[tuple[int, E.SampleResult]]:
    """Samples around every seller of tier 1, from one search out of all of them."""
    g = supplier_graph(spark, d)
    starts = valid_rows(table(spark, d, "suppliers")).where("tier = 1").select(F.col("id").alias("root"))
    links = g.simple_edges()
    starts = starts.join(links.select(F.col("src").alias("root")).distinct(), "root")
    rows = multi_source(g, starts, max_depth=SAMPLE)
    out = links.groupBy(F.col("src").alias("node")).count()
    per = rows.join(out, "node", "left").groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("edges"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in per.collect():  # SAMPLE + 1 rows a start
        found.setdefault(r["root"], {})[r["depth"]] = (r["n"], r["edges"] or 0)
    samples = []
    for root, levels in sorted(found.items()):
        sizes = [levels[k][0] for k in range(len(levels))]
        ended = len(sizes) <= SAMPLE
        samples.append((root, E.sample_of_levels(sizes + [0] * ended, sum(e for k, (_, e) in levels.items() if k < SAMPLE), ended)))
    return samples


def e2_samples(spark: SparkSession, d: str) -> DataFrame:
    """Growth trend, convergence, cycle and hub signs of each sample."""
    rows = [(k, s.visited_count, s.edges_seen, s.terminated, s.growth_trend, round(s.convergence_ratio, 8), s.has_cycles, round(s.max_expansion_factor, 8), s.hub_detected) for k, s in _samples(spark, d)]
    return spark.createDataFrame(rows, "start long, visited long, edges long, ended boolean, trend string, ratio double, cycles boolean, widest double, hub boolean")


def e7_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Damping, estimate and early check of each sample."""
    c = E.EstimationConfig()
    rows = [(k, round(E.damping_of(s, c), 8), *E.estimate_with_early_termination_check(s, AHEAD, ALLOWED), E.estimate(s, AHEAD, 30)) for k, s in _samples(spark, d)]
    return spark.createDataFrame(rows, "start long, damping double, estimated long, within boolean, bounded long")


def e14_guards(spark: SparkSession, d: str) -> DataFrame:
    """What guards, size check and strategy say of each sample."""
    rows = []
    for k, s in _samples(spark, d):
        guard, size = E.check_guards(s, AHEAD, ALLOWED), E.check_size_estimate(s, AHEAD, ALLOWED)
        rows.append((k, guard.safe_to_proceed, guard.recommended_action, guard.estimated_nodes, len(guard.warnings), size.nodes, size.within, E.choose_strategy(s)[0]))
    return spark.createDataFrame(rows, "start long, safe boolean, action string, expected long, remarks long, nodes long, within boolean, strategy string")


_SAMPLED = f"""WITH RECURSIVE {_REL_EDGES}, v AS {valid_sql('suppliers')}, o AS (SELECT a AS node, count(*) AS k FROM e GROUP BY a), z AS (SELECT id AS root FROM v WHERE tier = 1 AND id IN (SELECT a FROM e)),
r AS (SELECT root, root AS node, 0 AS depth FROM z UNION SELECT r.root, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < {SAMPLE}),
m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY root, node),
l AS (SELECT root, {', '.join(f'count(*) FILTER (depth = {k}) AS l{k}' for k in range(SAMPLE + 1))}, count(*) AS visited, CAST(coalesce(sum(o.k) FILTER (depth < {SAMPLE}), 0) AS BIGINT) AS edges FROM m LEFT JOIN o ON o.node = m.node GROUP BY root),
f AS (SELECT *, l3 = 0 AS ended, CASE WHEN edges > 0 THEN visited / (edges + 1.0) ELSE 1.0 END AS ratio, greatest(l1 / 1.0, CASE WHEN l1 > 0 THEN l2 / CAST(l1 AS DOUBLE) ELSE 0 END, CASE WHEN l2 > 0 THEN l3 / CAST(l2 AS DOUBLE) ELSE 0 END) AS widest,
  CASE WHEN l1 > 0 THEN l2 / CAST(l1 AS DOUBLE) ELSE 0 END AS g1, CASE WHEN l2 > 0 THEN l3 / CAST(l2 AS DOUBLE) ELSE 0 END AS g2 FROM l),
h AS (SELECT *, CASE WHEN l2 = 0 THEN 'stable' WHEN g1 = 0 AND g2 > 0 OR g2 > 1.2 * g1 THEN 'increasing' WHEN g2 < 0.8 * g1 THEN 'decreasing' ELSE 'stable' END AS trend, NOT ended AND ratio < 0.9 AS cycles, widest > 50 AS hub FROM f),
k AS (SELECT *, least(1.0, greatest(0.3, 0.85 * CASE WHEN ratio < 0.95 THEN 0.8 * ratio + 0.2 ELSE 1 END * CASE WHEN trend = 'decreasing' THEN 0.7 ELSE 1 END)) AS damping FROM h),
x AS (SELECT *, damping * g2 AS g FROM k),
y AS (SELECT *, CASE WHEN ended THEN CAST(floor(visited * 1.05) AS BIGINT) ELSE CAST(floor((visited + floor(CASE WHEN g < 1 THEN l3 * g / (1 - g) WHEN g = 1 THEN l3 * {AHEAD - SAMPLE} ELSE
  {' + '.join(f'l3 * power(g, {k}) * power(damping, {k * (k - 1) // 2})' for k in range(1, AHEAD - SAMPLE + 1))} END)) * 1.2) AS BIGINT) END AS estimated FROM x) """
_add("e2_samples", e2_samples, _SAMPLED + "SELECT root AS start, visited, edges, ended, trend, round(ratio, 8) AS ratio, cycles, round(widest, 8) AS widest, hub FROM y")
_add("e7_estimates", e7_estimates, _SAMPLED + f"SELECT root AS start, round(damping, 8) AS damping, estimated, estimated <= {ALLOWED} AS within, least(estimated, 30) AS bounded FROM y")
_add(
    "e14_guards", e14_guards,
    _SAMPLED + f"""SELECT root AS start, NOT hub AND (ended OR estimated <= {ALLOWED}) AS safe, CASE WHEN NOT hub AND (ended OR estimated <= {ALLOWED}) THEN 'traverse' ELSE 'abort' END AS action,
  CASE WHEN ended AND NOT hub THEN visited ELSE estimated END AS expected, CASE WHEN cycles AND NOT hub THEN 1 ELSE 0 END AS remarks, CASE WHEN ended THEN visited ELSE estimated END AS nodes, ended OR estimated <= {ALLOWED} AS within,
  CASE WHEN cycles THEN 'whole_graph' ELSE 'level_loop' END AS strategy FROM y""",
)


def e7_explosion(spark: SparkSession, d: str) -> DataFrame:
    """Expected size of an explosion, what guards say of it, and the true size."""
    g, start = parts_graph(spark, d), _parent(spark, d)
    sample = E.GraphSampler(spark, g.edges, "parent_part_id", "child_part_id").sample(start, 3)
    bound = E.get_table_bound(g.edges, "parent_part_id", "child_part_id")
    guard = E.check_guards(sample, 20, table_bound=bound)
    true = traverse_graph(g, start, max_depth=20).nodes_visited
    row = (start, E.estimate(sample, 20, bound), true, guard.recommended_action, E.choose_strategy(sample)[0])
    return spark.createDataFrame([row], "start long, estimated long, visited long, action string, strategy string")


_add("e7_explosion", e7_explosion)
_add(
    "e11_table_bound", lambda s, d: s.createDataFrame([(E.get_table_bound(table(s, d, REL[0]), "seller_id", "buyer_id"),)], "nodes long"),
    "SELECT count(*) AS nodes FROM (SELECT seller_id FROM supplier_relationships WHERE seller_id IS NOT NULL UNION SELECT buyer_id FROM supplier_relationships WHERE buyer_id IS NOT NULL)",
)


def e12_table_stats(spark: SparkSession, d: str) -> DataFrame:
    r = E.get_table_stats(table(spark, d, REL[0]), "seller_id", "buyer_id", ["id"])
    return spark.createDataFrame([(r.row_count, r.unique_from, r.unique_to, round(r.density, 8))], "row_count long, unique_from long, unique_to long, density double")


_add(
    "e12_table_stats", e12_table_stats,
    """SELECT count(*) AS row_count, count(DISTINCT seller_id) AS unique_from, count(DISTINCT buyer_id) AS unique_to,
  round(count(*) / CAST(power(count(DISTINCT seller_id) + count(DISTINCT buyer_id), 2) AS DOUBLE), 8) AS density FROM supplier_relationships""",
)
_add(
    "e13_cardinality", lambda s, d: E.get_cardinality_stats(table(s, d, REL[0]), "seller_id", "buyer_id").select(F.round("avg_out_degree", 6).alias("avg_out"), F.col("max_out_degree").alias("max_out"), F.round("avg_in_degree", 6).alias("avg_in"), F.col("max_in_degree").alias("max_in")),
    """SELECT round(avg(o.n), 6) AS avg_out, max(o.n) AS max_out, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM supplier_relationships WHERE buyer_id IS NOT NULL GROUP BY buyer_id)) AS avg_in,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM supplier_relationships WHERE buyer_id IS NOT NULL GROUP BY buyer_id)) AS max_in FROM (SELECT count(*) AS n FROM supplier_relationships WHERE seller_id IS NOT NULL GROUP BY seller_id) AS o""",
)

# Quality -----------------------------------------------------------------------------------------------------------

_add(
    "v4_dangling_edges", lambda s, d: V.dangling_edges(supplier_graph(s, d)).select("src", "dst", "missing_end"),
    f"""WITH x AS ({_edges_sql(*REL)}), i AS (SELECT DISTINCT id FROM suppliers),
y AS (SELECT a AS src, b AS dst, a IN (SELECT id FROM i) AS has_a, b IN (SELECT id FROM i) AS has_b FROM x)
SELECT src, dst, CASE WHEN NOT has_a AND NOT has_b THEN 'both' WHEN NOT has_a THEN 'src' ELSE 'dst' END AS missing_end FROM y WHERE NOT (has_a AND has_b)""",
)
_add("v6_self_loops", lambda s, d: V.self_loops(parts_graph(s, d).simple_edges()), f"SELECT DISTINCT a AS src, b AS dst FROM ({_edges_sql(*BOM)}) WHERE a = b")
_add("v7_mutual_pairs", lambda s, d: V.mutual_pairs(parts_graph(s, d).simple_edges()), f"WITH x AS (SELECT DISTINCT a, b FROM ({_edges_sql(*BOM)})) SELECT a, b FROM x WHERE a < b AND (b, a) IN (SELECT a, b FROM x)")
_add(
    "v8_back_edges", lambda s, d: V.back_edge_ratio(supplier_graph(s, d), "tier").select("edges", "back_edges", F.round("ratio", 8).alias("ratio")),
    f"""WITH x AS ({_edges_sql(*REL)}), v AS {valid_sql('suppliers')}
SELECT count(*) AS edges, count(*) FILTER (p.tier < c.tier) AS back_edges, round(count(*) FILTER (p.tier < c.tier) / CAST(count(*) AS DOUBLE), 8) AS ratio
FROM x JOIN v AS p ON p.id = x.a JOIN v AS c ON c.id = x.b WHERE p.tier IS NOT NULL AND c.tier IS NOT NULL""",
)
_add(
    "v11_axioms", lambda s, d: V.axiom_report(s, parts_graph(s, d), dict.fromkeys(("irreflexive", "asymmetric", "acyclic", "functional"), True)).select("axiom", "violations"),
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT a, b FROM ({_edges_sql(*BOM)})), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT 'irreflexive' AS axiom, count(*) AS violations FROM e WHERE a = b UNION ALL SELECT 'asymmetric', count(*) FROM e AS x JOIN e AS y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b
UNION ALL SELECT 'acyclic', CAST(count(*) > 0 AS BIGINT) FROM r WHERE a = b UNION ALL SELECT 'functional', count(*) FROM (SELECT a FROM e GROUP BY a HAVING count(*) > 1)""",
)
_add(
    "v9_missing_entities",
    lambda s, d: s.createDataFrame([(x,) for x in V.missing_entities(table(s, d, "suppliers"), "supplier_code", [f"SU-{k:09d}" for k in range(990, 1011)])], "supplier_code string"),
    "SELECT * FROM (SELECT 'SU-' || lpad(CAST(unnest(range(990, 1011)) AS VARCHAR), 9, '0') AS supplier_code) WHERE supplier_code NOT IN (SELECT supplier_code FROM suppliers WHERE supplier_code IS NOT NULL)",
)
_add(
    "v10_referential", lambda s, d: V.referential_report(table(s, d, "bill_of_materials"), "child_part_id", table(s, d, "parts"), "id"),
    "SELECT count(*) AS rows, count(*) FILTER (child_part_id NOT IN (SELECT id FROM parts WHERE id IS NOT NULL)) AS orphans FROM bill_of_materials WHERE child_part_id IS NOT NULL",
)


def s7_bom_with_conversions(spark: SparkSession, d: str) -> DataFrame:
    """Each line of the bill of materials with the mass and cost of its quantity.

    A quantity in kg is the mass itself; pieces, metres and litres weigh what the part's unit does; of other units none is known.
    """
    bom = table(spark, d, "bill_of_materials").select("id", "parent_part_id", "child_part_id", "quantity", "unit", "is_optional", "assembly_sequence").distinct()
    parts = valid_rows(table(spark, d, "parts")).select(F.col("id").alias("child_part_id"), "unit_weight_kg", "unit_cost")
    quantity, per_unit, cost = F.col("quantity").cast("double"), F.coalesce("unit_weight_kg", F.lit(0)).cast("double"), F.coalesce("unit_cost", F.lit(0)).cast("double")
    mass = F.when(F.col("unit") == "kg", quantity).when(F.col("unit").isin("each", "m", "L"), quantity * per_unit)
    return bom.join(parts, "child_part_id").select("id", "parent_part_id", "child_part_id", "quantity", "unit", "is_optional", "assembly_sequence", F.round(mass, 6).alias("weight_kg"), F.round(quantity * cost, 4).alias("cost_usd"))


_add(
    "s7_bom_with_conversions", s7_bom_with_conversions,
    f"""SELECT b.id, b.parent_part_id, b.child_part_id, b.quantity, b.unit, b.is_optional, b.assembly_sequence,
  round(CASE WHEN b.unit = 'kg' THEN CAST(b.quantity AS DOUBLE) WHEN b.unit IN ('each', 'm', 'L') THEN b.quantity * coalesce(CAST(p.unit_weight_kg AS DOUBLE), 0) END, 6) AS weight_kg, round(b.quantity * coalesce(CAST(p.unit_cost AS DOUBLE), 0), 4) AS cost_usd
FROM (SELECT DISTINCT id, parent_part_id, child_part_id, quantity, unit, is_optional, assembly_sequence FROM bill_of_materials) AS b JOIN {valid_sql('parts')} AS p ON p.id = b.child_part_id""",
)


def s8_copy_text(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as bulk-load text, one line a row."""
    return copy_lines(valid_rows(table(spark, d, "suppliers")).select("id", "supplier_code", "name", "tier", "is_active", "created_at"))


_ESCAPED = "coalesce(replace(replace(replace(replace({0}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r'), '\\N')"
_add(
    "s8_copy_text", s8_copy_text,
    f"""SELECT id || chr(9) || {_ESCAPED.format('supplier_code')} || chr(9) || {_ESCAPED.format('name')} || chr(9) || coalesce(CAST(tier AS VARCHAR), '\\N') || chr(9) || CASE WHEN is_active THEN 't' WHEN NOT is_active THEN 'f' ELSE '\\N' END
  || chr(9) || coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '\\N') AS line FROM {valid_sql('suppliers')}""",
)


def x_streaming_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of users and event types as the events stream in."""
    rows = table(spark, d, "events")
    reader = spark.readStream.schema(rows.schema)
    single = any(f.endswith("/events.parquet") for f in rows.inputFiles())  # a stream reads folders, not a file
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(d) if single else reader.parquet(f"{d}/events.parquet")
    return run_available(streaming_degrees(stream, "user_id", "event_type"), ["node"])


_add(
    "x_streaming_degrees", x_streaming_degrees,
    """SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT CAST(user_id AS VARCHAR) AS node, 1 AS o, 0 AS i FROM events UNION ALL SELECT event_type, 0, 1 FROM events) GROUP BY node""",
)
