"""Roles of an ontology over the driver's tables: what they say drives the operators, filters and validity included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators.quality import count_matches, missing_columns, table_exists
from relgraph.plans.bridge import RoleGraph
from relgraph.plans.ontology import Ontology
from relgraph.queries.graph import AT, BOM, DEPTH, PARENT, REL, SELLER, _edges_sql, _parent, _reach_sql, _seller
from relgraph.sources.derived import valid_rows, valid_sql
from relgraph.sources.export import relationships, vertices
from relgraph.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

ONTOLOGY = """
name: supply
version: "1"
annotations: {vg:database: '{"database_type": "files"}'}
classes:
  Supplier:
    description: a firm that sells or buys
    instantiates: [vg:SQLMappedClass]
    annotations: {vg:table: suppliers, vg:primary_key: '["id"]', vg:identifier: '["supplier_code"]', vg:soft_delete_column: deleted_at}
  Part:
    description: what is bought, built or sold
    instantiates: [vg:SQLMappedClass]
    annotations: {vg:table: parts, vg:primary_key: '["id"]'}
  SuppliesTo:
    description: who sells to whom
    instantiates: [vg:SQLMappedRelationship]
    annotations:
      vg:edge_table: supplier_relationships
      vg:domain_key: seller_id
      vg:range_key: buyer_id
      vg:domain_class: Supplier
      vg:range_class: Supplier
      vg:operation_types: "[recursive_traversal, temporal_traversal]"
      vg:temporal_bounds: '{"start_col": "contract_start_date", "end_col": "contract_end_date"}'
      vg:sql_filter: relationship_status = 'active'
      vg:irreflexive: true
  HasComponent:
    description: what a part consists of
    instantiates: [vg:SQLMappedRelationship]
    annotations:
      vg:edge_table: bill_of_materials
      vg:domain_key: parent_part_id
      vg:range_key: child_part_id
      vg:domain_class: Part
      vg:range_class: Part
      vg:operation_types: "[recursive_traversal, path_aggregation]"
      vg:weight_columns: '[{"name": "quantity", "type": "integer"}]'
  PrimarySupplier:
    description: where a part comes from first of all
    instantiates: [vg:SQLMappedRelationship]
    annotations:
      vg:edge_table: parts
      vg:domain_key: id
      vg:range_key: primary_supplier_id
      vg:domain_class: Part
      vg:range_class: Supplier
      vg:operation_types: "[direct_join]"
"""


def _add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def roles(spark: SparkSession, d: str) -> RoleGraph:
    """The ontology over valid versions of suppliers and parts, and distinct edge rows with long ids."""

    def read(name: str) -> DataFrame:
        df = table(spark, d, name)
        if name in ("suppliers", "parts"):
            df = valid_rows(df)
        return df.withColumns({c: F.col(c).cast("long") for c in ("seller_id", "buyer_id", "parent_part_id", "child_part_id", "primary_supplier_id") if c in df.columns})

    return RoleGraph(spark, Ontology.from_text(ONTOLOGY), read)


_LIVE = f"v AS (SELECT id FROM {valid_sql('suppliers')} WHERE deleted_at IS NULL),"
_ACTIVE = "relationship_status = 'active' AND seller_id IN (SELECT id FROM v) AND buyer_id IN (SELECT id FROM v)"
_ON_DAY = "(contract_start_date IS NULL OR contract_start_date <= DATE '2020-06-30') AND (contract_end_date IS NULL OR contract_end_date >= DATE '2020-06-30')"
_MINE = "SELECT node, CAST(depth AS INTEGER) AS depth FROM m"

_add("o_role_traverse", lambda s, d: roles(s, d).traverse("supplies_to", _seller(s, d), max_depth=DEPTH).paths.select("node", "depth"), _reach_sql(_edges_sql(*REL, _ACTIVE), SELLER, DEPTH, extra=_LIVE) + _MINE)
_add(
    "o_role_traverse_valid_at", lambda s, d: roles(s, d).traverse("SuppliesTo", _seller(s, d), "both", AT, max_depth=2).paths.select("node", "depth"),
    _reach_sql(f"{_edges_sql(*REL, f'{_ACTIVE} AND {_ON_DAY}')} UNION ALL {_edges_sql(REL[0], REL[2], REL[1], f'{_ACTIVE} AND {_ON_DAY}')}", SELLER, 2, extra=_LIVE) + _MINE,
)
_QUANTITIES = "SELECT CAST(parent_part_id AS BIGINT) AS a, CAST(child_part_id AS BIGINT) AS b, CAST(quantity AS DOUBLE) AS q FROM bill_of_materials WHERE parent_part_id IS NOT NULL AND child_part_id IS NOT NULL"
_add(
    "o_role_path_aggregate", lambda s, d: roles(s, d).path_aggregate("has_component", _parent(s, d), "quantity", "sum", max_depth=2).select("node", "value"),
    f"""WITH e AS ({_QUANTITIES}), w AS (SELECT b AS node, q AS value FROM e WHERE a = {PARENT} AND b <> a
  UNION ALL SELECT y.b, x.q + y.q FROM e AS x JOIN e AS y ON y.a = x.b WHERE x.a = {PARENT} AND x.b <> x.a AND y.b NOT IN (x.a, x.b))
SELECT node, coalesce(sum(value), 0.0) AS value FROM w GROUP BY node""",
)
_add(
    "o_role_distances", lambda s, d: roles(s, d).distances("has_component", _parent(s, d), max_depth=2).select("node", "dist"),
    f"""WITH e AS ({_QUANTITIES}), w AS (SELECT {PARENT} AS node, CAST(0 AS DOUBLE) AS dist UNION ALL SELECT b, q FROM e WHERE a = {PARENT} AND q IS NOT NULL
  UNION ALL SELECT y.b, x.q + y.q FROM e AS x JOIN e AS y ON y.a = x.b WHERE x.a = {PARENT} AND x.q IS NOT NULL AND y.q IS NOT NULL)
SELECT node, min(dist) AS dist FROM w GROUP BY node""",
)
_add(
    "o_role_degree", lambda s, d: roles(s, d).centrality("supplies_to").select("node", F.round("score", 8).alias("score")),
    f"""WITH {_LIVE[:-1]}, e AS (SELECT DISTINCT a, b FROM ({_edges_sql(*REL, _ACTIVE)})), k AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e)
SELECT node, round(count(*) / ((SELECT count(DISTINCT node) FROM k) - 1.0), 8) AS score FROM k GROUP BY node""",
)
_add(
    "o_direct_join", lambda s, d: roles(s, d).graph("primary_supplier").edge_rows().groupBy(F.col("dst").alias("supplier_id")).agg(F.count(F.lit(1)).alias("parts"))
    if roles(s, d).handler_for("primary_supplier") == ["join"] else None,
    f"WITH {_LIVE[:-1]}, p AS {valid_sql('parts')} SELECT CAST(primary_supplier_id AS BIGINT) AS supplier_id, count(*) AS parts FROM p WHERE primary_supplier_id IN (SELECT id FROM v) AND id IN (SELECT id FROM v) GROUP BY primary_supplier_id",
)
_add(
    "o_roles", lambda s, d: roles(s, d).ontology.roles_table(s).select("name", "edge_table", F.array_join("domain_key", ",").alias("domain_key"), F.array_join("range_key", ",").alias("range_key"), "sql_filter", F.array_join("axioms", ",").alias("axioms")),
    """SELECT * FROM (VALUES ('SuppliesTo', 'supplier_relationships', 'seller_id', 'buyer_id', 'relationship_status = ''active''', 'irreflexive'),
  ('HasComponent', 'bill_of_materials', 'parent_part_id', 'child_part_id', NULL, ''), ('PrimarySupplier', 'parts', 'id', 'primary_supplier_id', NULL, '')) AS t(name, edge_table, domain_key, range_key, sql_filter, axioms)""",
)
_add(
    "o_classes", lambda s, d: roles(s, d).ontology.classes_table(s).select("name", "table_name", F.array_join("primary_key", ",").alias("primary_key"), F.array_join("identifier", ",").alias("identifier"), "soft_delete_column"),
    "SELECT * FROM (VALUES ('Supplier', 'suppliers', 'id', 'supplier_code', 'deleted_at'), ('Part', 'parts', 'id', '', NULL)) AS t(name, table_name, primary_key, identifier, soft_delete_column)",
)
_add("s9_export_vertices", lambda s, d: vertices(roles(s, d)).select("label", "id"), f"SELECT 'Supplier' AS label, CAST(id AS VARCHAR) AS id FROM {valid_sql('suppliers')} WHERE deleted_at IS NULL UNION ALL SELECT 'Part', CAST(id AS VARCHAR) FROM {valid_sql('parts')}")
_add(
    "s9_export_relationships", lambda s, d: relationships(roles(s, d)).select("type", "src", "dst"),
    f"""WITH {_LIVE[:-1]} SELECT 'SuppliesTo' AS type, CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst FROM ({_edges_sql(*REL, _ACTIVE)})
UNION ALL SELECT 'HasComponent', CAST(a AS VARCHAR), CAST(b AS VARCHAR) FROM ({_edges_sql(*BOM)})
UNION ALL SELECT 'PrimarySupplier', CAST(id AS VARCHAR), CAST(primary_supplier_id AS VARCHAR) FROM {valid_sql('parts')} WHERE primary_supplier_id IN (SELECT id FROM v)""",
)
_add(
    "s9_export_properties", lambda s, d: relationships(roles(s, d)).where("type = 'HasComponent'").select("src", "dst", F.get_json_object("properties", "$.quantity").cast("long").alias("quantity")),
    "SELECT CAST(parent_part_id AS VARCHAR) AS src, CAST(child_part_id AS VARCHAR) AS dst, CAST(quantity AS BIGINT) AS quantity FROM bill_of_materials WHERE parent_part_id IS NOT NULL AND child_part_id IS NOT NULL",
)



def v1_mapped_tables(spark: SparkSession, d: str) -> DataFrame:
    """Each class and role: whether its table is there, which of its columns are not, and its rows against a declared number."""
    rg = roles(spark, d)
    rows = []
    for e in rg.ontology.entities.values():
        rg.read(e.table).createOrReplaceTempView(e.table)
        wanted = [*e.primary_key, *e.identifier, *([e.soft_delete_column] if e.soft_delete_column else [])]
        rows.append((e.name, table_exists(spark, e.table), ",".join(missing_columns(rg.read(e.table), wanted)), *count_matches(rg.read(e.table), DECLARED)))
    for r in rg.ontology.relationships.values():
        df = rg.read(r.edge_table)
        df.createOrReplaceTempView(r.edge_table)
        rows.append((r.name, table_exists(spark, r.edge_table), ",".join(missing_columns(df, [*r.domain_key, *r.range_key, *(w["name"] for w in r.weight_columns)])), *count_matches(df, DECLARED)))
    return spark.createDataFrame(rows, "name string, present boolean, missing string, as_declared boolean, n long")


DECLARED = 1_000
_add("v1_mapped_tables", v1_mapped_tables, f"""SELECT name, true AS present, '' AS missing, n = {DECLARED} AS as_declared, n FROM (
SELECT 'Supplier' AS name, count(DISTINCT id) AS n FROM suppliers UNION ALL SELECT 'Part', count(DISTINCT id) FROM parts UNION ALL SELECT 'PrimarySupplier', count(DISTINCT id) FROM parts
UNION ALL SELECT 'SuppliesTo', count(*) FROM supplier_relationships UNION ALL SELECT 'HasComponent', count(*) FROM bill_of_materials)""")

__all__ = ["ONTOLOGY", "ORACLE", "QUERIES", "roles"]
