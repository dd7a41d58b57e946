"""Questions that joins, filters and aggregates answer, and those that put graph operators and tables together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relgraph.operators.aggregate import aggregate_paths
from relgraph.operators.blocks import reach_counts
from relgraph.operators.hierarchy import Hierarchy
from relgraph.operators.model import ANY_DEPTH, LIMITS, Graph
from relgraph.operators.network import degree_centrality, isolates
from relgraph.operators.paths import distances, path_distances
from relgraph.operators.quality import mutual_pairs
from relgraph.operators.traverse import multi_source, traverse_graph
from relgraph.queries.graph import _DISTANCES_SQL, _END, _LAST, _SHOW, _START, BOM, DAG_SQL, NET_SQL, PARENT, ROUNDS, _edges_sql, _levels_sql, _net_sql, _one_path, _parent, _reach_sql, _relaxed_sql, whole_explosion
from relgraph.sources.derived import DAG_TOP, dag_edges, net_edges, net_graph, parts_graph, supplier_graph, valid_rows, valid_sql
from relgraph.sources.scratch import materialize
from relgraph.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


# Look-ups, filters, joins along foreign keys, aggregates: DataFrames here, SQL as the second opinion -------------------


def _t(name: str, spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = table(spark, d, name)
    return df.select(*columns) if columns else df


def _round_sum(column, digits: int = 2):
    return F.round(F.sum(column), digits)


_add(
    "q01_supplier_by_code", lambda s, d: _t("suppliers", s, d).where(F.col("supplier_code") == "SU-000000004").select("id", "name", "tier").distinct(),
    "SELECT DISTINCT id, name, tier FROM suppliers WHERE supplier_code = 'SU-000000004'",
)
_add(
    "q02_active_by_tier", lambda s, d: _t("suppliers", s, d).where("is_active and deleted_at is null").groupBy("tier").agg(F.count_distinct("id").alias("n")),
    "SELECT tier, count(DISTINCT id) AS n FROM suppliers WHERE is_active AND deleted_at IS NULL GROUP BY tier",
)


def q03_parts_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    s = _t("suppliers", spark, d).where("tier = 1 and country = 'Japan'").select(F.col("id").alias("primary_supplier_id"))
    return _t("parts", spark, d).join(s, "primary_supplier_id", "left_semi").select("id", "part_number").distinct()


_add("q03_parts_of_suppliers", q03_parts_of_suppliers, "SELECT DISTINCT p.id, p.part_number FROM parts AS p JOIN suppliers AS s ON s.id = p.primary_supplier_id WHERE s.tier = 1 AND s.country = 'Japan'")


def q04_suppliers_of_critical_parts(spark: SparkSession, d: str) -> DataFrame:
    p = _t("parts", spark, d).where("is_critical").select(F.col("primary_supplier_id").alias("id"))
    return _t("suppliers", spark, d, "id", "name").join(p, "id", "left_semi").distinct()


_add("q04_suppliers_of_critical_parts", q04_suppliers_of_critical_parts, "SELECT DISTINCT s.id, s.name FROM suppliers AS s JOIN parts AS p ON p.primary_supplier_id = s.id WHERE p.is_critical")


def q05_components(spark: SparkSession, d: str) -> DataFrame:
    lines = _t("bill_of_materials", spark, d).where("is_optional and assembly_sequence <= 3").select("child_part_id").distinct()
    return lines.join(_t("parts", spark, d).select(F.col("id").alias("child_part_id"), "part_number"), "child_part_id").distinct()


_add("q05_components", q05_components, "SELECT DISTINCT b.child_part_id, p.part_number FROM bill_of_materials AS b JOIN parts AS p ON p.id = b.child_part_id WHERE b.is_optional AND b.assembly_sequence <= 3")


def q06_orders_by_status(spark: SparkSession, d: str) -> DataFrame:
    o = _t("orders", spark, d).where("o_orderstatus = 'F' and o_totalprice > 200000")
    c = _t("customer", spark, d).join(_t("nation", spark, d), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name", "n_name")


_add("q06_orders_by_status", q06_orders_by_status, "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders AS o JOIN customer AS c ON c.c_custkey = o.o_custkey JOIN nation AS n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderstatus = 'F' AND o.o_totalprice > 200000")
_add(
    "q07_name_pattern", lambda s, d: _t("parts", s, d).where(F.col("description").contains("cable") & (F.col("category") == "Linear Stock")).select("id", "part_number", "description").distinct(),
    "SELECT DISTINCT id, part_number, description FROM parts WHERE description LIKE '%cable%' AND category = 'Linear Stock'",
)
_add(
    "q08_column_compare", lambda s, d: _t("parts", s, d).where(F.col("min_stock_level") < F.col("lead_time_days")).select("id", "lead_time_days", "min_stock_level").distinct(),
    "SELECT DISTINCT id, lead_time_days, min_stock_level FROM parts WHERE min_stock_level < lead_time_days",
)


def q09_top_customers(spark: SparkSession, d: str) -> DataFrame:
    """The ten customers with most revenue in the last 365 days of orders."""
    o = _t("orders", spark, d)
    last = o.agg(F.max("o_orderdate")).first()[0]
    recent = o.where(F.col("o_orderdate") >= F.lit(last) - F.expr("INTERVAL 365 DAYS")) if last else o.limit(0)
    lines = _t("lineitem", spark, d).join(recent, F.col("l_orderkey") == F.col("o_orderkey"))
    revenue = lines.groupBy(F.col("o_custkey").alias("c_custkey")).agg(_round_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return revenue.join(_t("customer", spark, d), "c_custkey", "left_semi").orderBy(F.desc("revenue"), "c_custkey").limit(10)


_add(
    "q09_top_customers", q09_top_customers,
    """SELECT c.c_custkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer AS c JOIN orders AS o ON o.o_custkey = c.c_custkey JOIN lineitem AS l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderdate >= (SELECT max(o_orderdate) - INTERVAL '365' DAY FROM orders) GROUP BY c.c_custkey ORDER BY revenue DESC, c.c_custkey LIMIT 10""",
)


def q10_region_revenue(spark: SparkSession, d: str) -> DataFrame:
    per = _t("orders", spark, d).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v")).join(_t("customer", spark, d), F.col("o_custkey") == F.col("c_custkey"))
    where = _t("nation", spark, d).join(_t("region", spark, d), F.col("n_regionkey") == F.col("r_regionkey"))
    return per.join(where, per["c_nationkey"] == where["n_nationkey"]).groupBy("r_name").agg(_round_sum("v").alias("total"))


_add("q10_region_revenue", q10_region_revenue, "SELECT r.r_name, round(sum(o.o_totalprice), 2) AS total FROM region AS r JOIN nation AS n ON n.n_regionkey = r.r_regionkey JOIN customer AS c ON c.c_nationkey = n.n_nationkey JOIN orders AS o ON o.o_custkey = c.c_custkey GROUP BY r.r_name")
_add(
    "q46_single_source", lambda s, d: _t("lineitem", s, d).groupBy("l_partkey").agg(F.min("l_suppkey").alias("only_supplier"), F.max("l_suppkey").alias("last")).where("only_supplier = last").drop("last"),
    "SELECT l_partkey, min(l_suppkey) AS only_supplier FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1",
)


def q45_parts_losing_all(spark: SparkSession, d: str) -> DataFrame:
    """Parts of which no named supplier is live."""
    live = _t("suppliers", spark, d).where("deleted_at is null").select(F.col("id").alias("primary_supplier_id"), F.lit(1).alias("live")).distinct()
    named = _t("parts", spark, d, "id", "primary_supplier_id").where("primary_supplier_id is not null")
    return named.join(live, "primary_supplier_id", "left").groupBy("id").agg(F.max("live").alias("live")).where("live is null").select("id")


_add(
    "q45_parts_losing_all", q45_parts_losing_all,
    """SELECT p.id FROM (SELECT DISTINCT id, primary_supplier_id FROM parts WHERE primary_supplier_id IS NOT NULL) AS p LEFT JOIN (SELECT id, max(CASE WHEN deleted_at IS NULL THEN 1 ELSE 0 END) AS live FROM suppliers GROUP BY id) AS s
ON s.id = p.primary_supplier_id GROUP BY p.id HAVING max(coalesce(s.live, 0)) = 0""",
)


def q52_route_with_most_parts(spark: SparkSession, d: str) -> DataFrame:
    """The pair of supplier and customer nation over which most different parts go."""
    lines = _t("lineitem", spark, d).join(_t("orders", spark, d), F.col("l_orderkey") == F.col("o_orderkey")).join(_t("customer", spark, d), F.col("o_custkey") == F.col("c_custkey"))
    per = lines.groupBy("l_suppkey", "c_nationkey").agg(F.count_distinct("l_partkey").alias("n"))
    return per.orderBy(F.desc("n"), "l_suppkey", "c_nationkey").limit(1)


_add("q52_route_with_most_parts", q52_route_with_most_parts, "SELECT l_suppkey, c_nationkey, count(DISTINCT l_partkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY l_suppkey, c_nationkey ORDER BY n DESC, l_suppkey, c_nationkey LIMIT 1")


def q55_sole_source_in_many(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of tier 3 whose parts stand in more than three products."""
    tier = _t("suppliers", spark, d).where("tier = 3").select(F.col("id").alias("primary_supplier_id"))
    p = _t("parts", spark, d, "id", "primary_supplier_id").join(tier, "primary_supplier_id", "left_semi").distinct()
    uses = _t("bill_of_materials", spark, d).select(F.col("child_part_id").alias("id"), "parent_part_id").distinct()
    return p.join(uses, "id").groupBy("primary_supplier_id").agg(F.count_distinct("parent_part_id").alias("used_in")).where("used_in > 3")


_add(
    "q55_sole_source_in_many", q55_sole_source_in_many,
    """SELECT p.primary_supplier_id, count(DISTINCT b.parent_part_id) AS used_in FROM parts AS p JOIN bill_of_materials AS b ON b.child_part_id = p.id JOIN suppliers AS s ON s.id = p.primary_supplier_id WHERE s.tier = 3
GROUP BY p.primary_supplier_id HAVING count(DISTINCT b.parent_part_id) > 3""",
)
_add(
    "q56_two_cycles", lambda s, d: mutual_pairs(supplier_graph(s, d).simple_edges()),
    "SELECT DISTINCT a.seller_id AS a, a.buyer_id AS b FROM supplier_relationships AS a JOIN supplier_relationships AS r ON r.seller_id = a.buyer_id AND r.buyer_id = a.seller_id WHERE a.seller_id < a.buyer_id",
)


def q57_days_to_ship(spark: SparkSession, d: str) -> DataFrame:
    """Days from order to shipping of each line, against the average of the part's type: per priority, in days."""
    o = _t("orders", spark, d).select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_orderpriority")
    lines = _t("lineitem", spark, d).join(o, "l_orderkey").withColumn("days", F.datediff("l_shipdate", "o_orderdate"))
    return lines.groupBy("o_orderpriority").agg(F.round(F.avg("days"), 6).alias("avg_days"), F.min("days").alias("min_days"), F.max("days").alias("max_days"), F.count_if(F.col("days") < 0).alias("before_order"))


_add(
    "q57_days_to_ship", q57_days_to_ship,
    """SELECT o_orderpriority, round(avg(days), 6) AS avg_days, CAST(min(days) AS INTEGER) AS min_days, CAST(max(days) AS INTEGER) AS max_days, count(*) FILTER (days < 0) AS before_order
FROM (SELECT o_orderpriority, datediff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY o_orderpriority""",
)


def q58_six_table_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stay in one nation, per nation and region."""
    lines = _t("lineitem", spark, d, "l_orderkey", "l_suppkey", "l_quantity")
    buyers = _t("orders", spark, d, "o_orderkey", "o_custkey").join(_t("customer", spark, d, "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(_t("supplier", spark, d, "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    per = joined.where(F.col("c_nationkey") == F.col("s_nationkey")).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("lines"), _round_sum("l_quantity").alias("quantity"))
    where = _t("nation", spark, d).join(_t("region", spark, d), F.col("n_regionkey") == F.col("r_regionkey"))
    return per.join(where, per["s_nationkey"] == where["n_nationkey"]).select("r_name", "n_name", "lines", "quantity")


_add("q58_six_table_lineage", q58_six_table_lineage, """SELECT r.r_name, n.n_name, count(*) AS lines, round(sum(l.l_quantity), 2) AS quantity FROM lineitem AS l JOIN orders AS o ON o.o_orderkey = l.l_orderkey JOIN customer AS c ON c.c_custkey = o.o_custkey
JOIN supplier AS s ON s.s_suppkey = l.l_suppkey JOIN nation AS n ON n.n_nationkey = s.s_nationkey JOIN region AS r ON r.r_regionkey = n.n_regionkey WHERE c.c_nationkey = s.s_nationkey GROUP BY r.r_name, n.n_name""")
_add(
    "q60_unused_parts", lambda s, d: isolates(parts_graph(s, d)).select(F.col("node").alias("id")),
    "SELECT DISTINCT p.id FROM parts AS p WHERE p.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bill_of_materials AS b WHERE b.child_part_id = p.id) AND NOT EXISTS (SELECT 1 FROM bill_of_materials AS b WHERE b.parent_part_id = p.id)",
)
_add(
    "q62_expiring_contracts", lambda s, d: _t("supplier_relationships", s, d).where(F.col("contract_end_date").between("2025-01-01", "2025-03-31")).select("id", "seller_id", "buyer_id", "contract_end_date").distinct(),
    "SELECT DISTINCT id, seller_id, buyer_id, contract_end_date FROM supplier_relationships WHERE contract_end_date BETWEEN DATE '2025-01-01' AND DATE '2025-03-31'",
)
_add(
    "q64_relationship_status", lambda s, d: _t("supplier_relationships", s, d).groupBy("relationship_status", F.lower("relationship_type").alias("kind")).agg(F.count_distinct("id").alias("n")),
    "SELECT relationship_status, lower(relationship_type) AS kind, count(DISTINCT id) AS n FROM supplier_relationships GROUP BY relationship_status, lower(relationship_type)",
)
_add(
    "q66_open_ended", lambda s, d: _t("supplier_relationships", s, d).where("contract_start_date is not null and contract_end_date is null and is_primary").select("id").distinct(),
    "SELECT DISTINCT id FROM supplier_relationships WHERE contract_start_date IS NOT NULL AND contract_end_date IS NULL AND is_primary",
)


def q67_contract_days(spark: SparkSession, d: str) -> DataFrame:
    """Average length of contracts per kind, from the first to the last day, turned ones apart."""
    days = F.datediff("contract_end_date", "contract_start_date") + 1
    rows = _t("supplier_relationships", spark, d).select("id", F.lower("relationship_type").alias("kind"), days.alias("days")).distinct()
    return rows.where("days is not null").groupBy("kind").agg(F.round(F.avg(F.when(F.col("days") > 0, F.col("days"))), 6).alias("avg_days"), F.count_if(F.col("days") <= 0).alias("turned"))


_add(
    "q67_contract_days", q67_contract_days,
    """SELECT kind, round(avg(days) FILTER (days > 0), 6) AS avg_days, count(*) FILTER (days <= 0) AS turned FROM
(SELECT DISTINCT id, lower(relationship_type) AS kind, datediff('day', contract_start_date, contract_end_date) + 1 AS days FROM supplier_relationships) WHERE days IS NOT NULL GROUP BY kind""",
)
_add(
    "q71_discounted_orders", lambda s, d: _t("lineitem", s, d).where("l_discount > 0.05").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("l_discount"), 2).alias("most")).where("n >= 3"),
    "SELECT l_orderkey, count(*) AS n, round(max(l_discount), 2) AS most FROM lineitem WHERE l_discount > 0.05 GROUP BY l_orderkey HAVING count(*) >= 3",
)


def _waits(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from each event of a user to the next."""
    after = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t("events", spark, d).select("event_id", "user_id", "event_type", (F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("micros"))


_WAITS = "(SELECT event_id, user_id, event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS micros FROM events)"
_add(
    "q72_hours_per_user", lambda s, d: _waits(s, d).groupBy("user_id").agg(F.round(F.sum("micros") / 3.6e9, 4).alias("hours"), F.count(F.lit(1)).alias("n")),
    f"SELECT user_id, round(sum(micros) / 3.6e9, 4) AS hours, count(*) AS n FROM {_WAITS} GROUP BY user_id",
)
_add(
    "q74_waits_against_average", lambda s, d: _waits(s, d).groupBy("event_type").agg(F.round(F.avg("micros") / 1e6, 2).alias("avg_s"), F.round(F.max("micros") / 1e6, 2).alias("most_s"), F.round(F.min("micros") / 1e6, 2).alias("least_s")),
    f"SELECT event_type, round(avg(micros) / 1e6, 2) AS avg_s, round(max(micros) / 1e6, 2) AS most_s, round(min(micros) / 1e6, 2) AS least_s FROM {_WAITS} GROUP BY event_type",
)
_add(
    "q76_longest_steps", lambda s, d: _waits(s, d).where("micros is not null").orderBy(F.desc("micros"), "event_id").limit(10).select("event_id", "event_type", "micros"),
    f"SELECT event_id, event_type, micros FROM {_WAITS} WHERE micros IS NOT NULL ORDER BY micros DESC, event_id LIMIT 10",
)


def q77_forward_trace(spark: SparkSession, d: str) -> DataFrame:
    """From returned lines forward: the customers who got the same part from the same supplier, and how many of their orders."""
    lots = _t("lineitem", spark, d).where("l_returnflag = 'R' and l_partkey = 7").select("l_partkey", "l_suppkey").distinct()
    lines = _t("lineitem", spark, d).join(lots, ["l_partkey", "l_suppkey"], "left_semi")
    orders = _t("orders", spark, d, "o_orderkey", "o_custkey").join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))


_add(
    "q77_forward_trace", q77_forward_trace,
    """SELECT o_custkey, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey = 7) GROUP BY o_custkey""",
)


def q81_highest_return_rate(spark: SparkSession, d: str) -> DataFrame:
    per = _t("lineitem", spark, d).groupBy("l_suppkey").agg(F.round(F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)), 8).alias("rate"))
    return per.orderBy(F.desc("rate"), "l_suppkey").limit(1)


_add("q81_highest_return_rate", q81_highest_return_rate, "SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 8) AS rate FROM lineitem GROUP BY l_suppkey ORDER BY rate DESC, l_suppkey LIMIT 1")
_add(
    "q83_parts_never_bought", lambda s, d: _t("part", s, d, "p_partkey").join(_t("lineitem", s, d).select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"),
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)",
)


def q84_two_costs(spark: SparkSession, d: str) -> DataFrame:
    """What each nation bought and sold."""
    bought = _t("orders", spark, d).join(_t("customer", spark, d), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(_round_sum("o_totalprice").alias("bought"))
    sold = _t("lineitem", spark, d).join(_t("supplier", spark, d), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(_round_sum("l_extendedprice").alias("sold"))
    return bought.join(sold, "n_nationkey")


_add(
    "q84_two_costs", q84_two_costs,
    """SELECT a.n_nationkey, a.bought, b.sold FROM (SELECT c.c_nationkey AS n_nationkey, round(sum(o.o_totalprice), 2) AS bought FROM orders AS o JOIN customer AS c ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey) AS a
JOIN (SELECT s.s_nationkey AS n_nationkey, round(sum(l.l_extendedprice), 2) AS sold FROM lineitem AS l JOIN supplier AS s ON s.s_suppkey = l.l_suppkey GROUP BY s.s_nationkey) AS b ON b.n_nationkey = a.n_nationkey""",
)
_add(
    "q85_largest_queue", lambda s, d: _t("orders", s, d).where("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(1),
    "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 1",
)

# Graph operators with joins around them ------------------------------------------------------------------------------

_add(
    "q16_depth_per_root", lambda s, d: Hierarchy(dag_edges(s, d), "src", "dst").spans(),
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {DAG_SQL}), t AS (SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)),
w AS (SELECT node AS root, node, 0 AS depth FROM t UNION SELECT w.root, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node)
SELECT root, max(depth) AS deepest, count(DISTINCT node) AS n FROM w GROUP BY root""",
)


def q18_shared_reach(spark: SparkSession, d: str) -> DataFrame:
    """How many suppliers reach each one within two steps, where more than one does."""
    links = materialize(net_edges(spark, d).select("src", "dst"))
    if links.rows <= LIMITS.max_task_edges:
        _, reached = reach_counts(links.df, 2)
        return reached.groupBy("node").agg(F.sum("n").alias("roots")).where(F.col("roots") > 1)
    starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("root"))
    reach = multi_source(net_graph(spark, d), starts, max_depth=2).where("depth > 0")
    return reach.groupBy("node").agg(F.count_distinct("root").alias("roots")).where(F.col("roots") > 1)


_add(
    "q18_shared_reach", q18_shared_reach,
    f"""WITH e AS (SELECT src, dst FROM {NET_SQL}), r AS (SELECT src AS root, dst AS node FROM e UNION SELECT x.src, y.dst FROM e AS x JOIN e AS y ON y.src = x.dst WHERE y.dst <> x.src)
SELECT node, count(DISTINCT root) AS roots FROM r WHERE node <> root GROUP BY node HAVING count(DISTINCT root) > 1""",
)


def q25_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Parts at the bottom of one structure."""
    g = parts_graph(spark, d)
    found = traverse_graph(g, _parent(spark, d), max_depth=50).paths.select("node")
    return found.join(g.edge_rows().select(F.col("src").alias("node")), "node", "left_anti")


_add("q25_leaves", q25_leaves, _reach_sql(_edges_sql(*BOM), PARENT, 50) + "SELECT node FROM m WHERE node NOT IN (SELECT a FROM e)")


def _two_parents(spark: SparkSession, d: str) -> list[int]:
    per = table(spark, d, "bill_of_materials").groupBy(F.col("parent_part_id").cast("long").alias("k")).count().where("k is not null")
    return [r["k"] for r in per.orderBy(F.desc("count"), "k").limit(2).collect()]


def q26_common_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts in both of the two widest structures."""
    g = parts_graph(spark, d)
    a, b = [traverse_graph(g, p, max_depth=50, include_start=False).paths.select("node") for p in _two_parents(spark, d)]
    return a.intersect(b)


_SECOND = "(SELECT CAST(parent_part_id AS BIGINT) FROM bill_of_materials WHERE parent_part_id IS NOT NULL GROUP BY parent_part_id ORDER BY count(*) DESC, parent_part_id LIMIT 1 OFFSET 1)"
_add(
    "q26_common_parts", q26_common_parts,
    f"""WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM ({_edges_sql(*BOM)})),
x AS (SELECT {PARENT} AS node UNION SELECT e.b FROM x JOIN e ON e.a = x.node), y AS (SELECT {_SECOND} AS node UNION SELECT e.b FROM y JOIN e ON e.a = y.node)
SELECT node FROM x WHERE node <> {PARENT} INTERSECT SELECT node FROM y WHERE node <> {_SECOND}""",
)
_add(
    "q27_longest_chain", lambda s, d: Hierarchy(dag_edges(s, d), "src", "dst").longest(),
    f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {DAG_SQL}), w AS (SELECT DISTINCT src AS node, 0 AS depth FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node)
SELECT max(depth) AS longest FROM w""",
)


def q34_nearest_of_set(spark: SparkSession, d: str) -> DataFrame:
    """From each supplier, hops to the nearest one with a negative balance: one search from all of them, backwards."""
    targets = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    links = net_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("w"))
    starts = targets.select(F.lit(0).alias("root"), "node")
    return distances(links, starts, ANY_DEPTH, False).select("node", "hops")


_add(
    "q34_nearest_of_set", q34_nearest_of_set,
    f"""WITH RECURSIVE e AS (SELECT src, dst FROM {NET_SQL}), r AS (SELECT s_suppkey AS node, 0 AS hops FROM supplier WHERE s_acctbal < 0 UNION SELECT e.src, r.hops + 1 FROM r JOIN e ON e.dst = r.node WHERE r.hops < 8)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node""",
)


def _above_stock(spark: SparkSession, d: str, need: DataFrame) -> DataFrame:
    stock = valid_rows(table(spark, d, "parts")).select(F.col("id").alias("node"), "min_stock_level")
    return need.join(stock, "node").where(F.col("value") > F.col("min_stock_level")).select("node", "value", "min_stock_level")


# To the full depth, so beyond SQL, as g3_real_explosion.
_add("q41_explosion_and_stock", lambda s, d: _above_stock(s, d, whole_explosion(s, d)))


def q44_value_at_risk(spark: SparkSession, d: str) -> DataFrame:
    """Cost of all parts above the parts of each tier-3 supplier's country: where used, then summed."""
    parts = valid_rows(table(spark, d, "parts"))
    hit = parts.join(valid_rows(table(spark, d, "suppliers")).where("tier = 3 and country = 'Japan'").select(F.col("id").alias("primary_supplier_id")), "primary_supplier_id", "left_semi")
    links = parts_graph(spark, d).edge_rows().select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("w")).distinct()
    above = distances(links, hit.select(F.lit(0).alias("root"), F.col("id").alias("node")), ANY_DEPTH, False)
    return above.join(parts.select(F.col("id").alias("node"), "unit_cost"), "node").agg(F.count(F.lit(1)).alias("n"), F.sum("unit_cost").cast("double").alias("cost"))


_add(
    "q44_value_at_risk", q44_value_at_risk,
    f"""WITH RECURSIVE p AS {valid_sql('parts')}, v AS {valid_sql('suppliers')}, e AS (SELECT DISTINCT a, b FROM ({_edges_sql(*BOM)})),
r AS (SELECT p.id AS node FROM p JOIN v ON v.id = p.primary_supplier_id WHERE v.tier = 3 AND v.country = 'Japan' UNION SELECT e.a FROM r JOIN e ON e.b = r.node)
SELECT count(*) AS n, CAST(sum(p.unit_cost) AS DOUBLE) AS cost FROM r JOIN p ON p.id = r.node""",
)


def q49_degree_times_value(spark: SparkSession, d: str) -> DataFrame:
    """The ten suppliers with the highest product of degree centrality and balance."""
    score = degree_centrality(net_edges(spark, d).select("src", "dst"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), "s_acctbal")
    return score.join(s, "node").select("node", F.round(F.col("score") * F.col("s_acctbal"), 4).alias("weight")).orderBy(F.desc("weight"), "node").limit(10)


_add(
    "q49_degree_times_value", q49_degree_times_value,
    f"""WITH e AS (SELECT src, dst FROM {NET_SQL}), k AS (SELECT node, count(*) AS d FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node)
SELECT k.node, round(k.d / ((SELECT count(*) FROM k) - 1.0) * s.s_acctbal, 4) AS weight FROM k JOIN supplier AS s ON s.s_suppkey = k.node ORDER BY weight DESC, k.node LIMIT 10""",
)


def q50_reroute_cost(spark: SparkSession, d: str) -> DataFrame:
    """What every destination's cheapest way gets dearer when the hub next to the start is closed; null: cut off."""
    g = net_graph(spark, d, weight="q")
    hub = net_edges(spark, d).where("src = 0").agg(F.min("dst")).first()[0]
    a = path_distances(g, 0, None).select("node", F.col("dist").alias("cost"))
    b = path_distances(g.with_(excluded=(hub,)), 0, None).select("node", F.col("dist").alias("rerouted"))
    return a.where(F.col("node") != hub).join(b, "node", "left").select("node", "cost", (F.col("rerouted") - F.col("cost")).alias("extra"))


_HUB_NEXT = "(SELECT min(dst) FROM e WHERE src = 0)"
_add(
    "q50_reroute_cost", q50_reroute_cost,
    f"""{_DISTANCES_SQL}, x AS MATERIALIZED (SELECT * FROM e WHERE src <> {_HUB_NEXT} AND dst <> {_HUB_NEXT}), {_relaxed_sql('b', 'x', _START)}
SELECT a.node, a.dist AS cost, b.dist - a.dist AS extra FROM {_LAST} AS a LEFT JOIN b{ROUNDS} AS b ON b.node = a.node WHERE a.node <> {_HUB_NEXT}""",
)


def q53_path_over_stocked(spark: SparkSession, d: str) -> DataFrame:
    """Cheapest distances over suppliers with a positive balance only (the start apart)."""
    good = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"))
    e = net_edges(spark, d).join(good, "dst", "left_semi")
    return path_distances(Graph.of(spark, None, e, "src", "dst", weight="q"), 0, None).select("node", "dist")


_add(
    "q53_path_over_stocked", q53_path_over_stocked,
    f"{_net_sql(where='dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)')}{_relaxed_sql('d', 'e', _START)} SELECT node, dist FROM {_LAST}",
)
# The cheapest path by quantity among those of at most five edges.
_add("q54_cheapest_under_limit", _one_path("q", max_depth=5), f"{_net_sql()}{_relaxed_sql('d', 'e', _START, 5)} SELECT {_SHOW}, dist, hops FROM d5 WHERE node = {_END}")


def q23_where_the_cost_lies(spark: SparkSession, d: str) -> DataFrame:
    """The ten parts that add most to the cost of the top part, quantities multiplied through to the bottom: log10 of the cost."""
    need = aggregate_paths(Graph.of(spark, None, dag_edges(spark, d), "src", "dst"), DAG_TOP, "qty", "multiply", max_depth=None)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_retailprice")
    cost = need.join(p, "node").select("node", F.round(F.log10(F.col("value") * F.col("p_retailprice")), 6).alias("log_cost"))
    return cost.orderBy(F.desc("log_cost"), "node").limit(10)


_add(
    "q23_where_the_cost_lies", q23_where_the_cost_lies,
    _levels_sql("multiply") + "SELECT t.node, round(log10(t.value * p.p_retailprice), 6) AS log_cost FROM t JOIN part AS p ON p.p_partkey = t.node WHERE t.value * p.p_retailprice > 0 ORDER BY log_cost DESC, t.node LIMIT 10",
)
