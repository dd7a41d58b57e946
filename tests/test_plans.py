import pytest
from graphs import edges, nodes

from relgraph.operators import quality as V
from relgraph.operators.estimate import (
    EstimationConfig,
    GraphSampler,
    TableStats,
    check_guards,
    check_size_estimate,
    choose_strategy,
    estimate,
    get_cardinality_stats,
    get_table_bound,
    get_table_stats,
    sample_of_levels,
)
from relgraph.operators.model import Graph
from relgraph.plans.bridge import RoleGraph
from relgraph.plans.ontology import Ontology, OntologyValidationError, snake_case
from relgraph.sources.export import materialize_graph, relationships, vertices

# Estimator ---------------------------------------------------------------------------------------------------------


def test_estimate_of_samples():
    growing = sample_of_levels([1, 10, 50, 100], 160, False)
    assert growing.growth_trend == "decreasing" and growing.convergence_ratio == 1.0
    ended = sample_of_levels([1, 10, 20, 15, 4, 0], 60, True)
    assert estimate(ended, 10) == int(50 * 1.05) and estimate(ended, 10, 40) == 40
    hub = sample_of_levels([1, 100, 5000], 5100, False)
    assert hub.hub_detected and check_guards(hub, 10).recommended_action == "abort"
    assert check_guards(ended, 10).estimated_nodes == 50
    wide = sample_of_levels([1, 4, 16, 64], 84, False)
    assert estimate(wide, 10, config=EstimationConfig(base_damping=1.0, decreasing_trend_multiplier=1.0)) > 1000
    assert not check_guards(wide, 20, max_nodes=100).safe_to_proceed
    assert check_guards(wide, 4, max_nodes=10**6, stats=TableStats(5, is_junction=True)).warnings
    cyclic = sample_of_levels([1, 4, 4, 4], 30, False)
    assert cyclic.has_cycles and choose_strategy(cyclic)[0] == "whole_graph"
    assert choose_strategy(wide)[0] == "level_loop" and choose_strategy(wide, algorithm="PageRank")[0] == "whole_graph"
    assert check_size_estimate(ended, 10, 5)[1] and not check_size_estimate(wide, 20, 10)[1]
    assert sample_of_levels([1], 0, True).max_expansion_factor == 0.0 and estimate(sample_of_levels([1], 0, False), 5) == 1


def test_sampler_and_table_stats(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    s = GraphSampler(spark, e, "src", "dst").sample(1)
    assert (s.visited_count, s.level_sizes, s.terminated, s.edges_seen) == (4, [1, 2, 1, 0], True, 4)
    assert GraphSampler(spark, e, "src", "dst").sample(1, 1).terminated is False
    assert get_table_bound(e, "src", "dst") == 4
    t = get_table_stats(e, "src", "dst", ["src", "dst"])
    assert (t.row_count, t.unique_from, t.unique_to, t.is_junction) == (4, 3, 3, True) and t.density == 4 / 36
    assert get_table_stats(e.limit(0), "src", "dst").density == 0.0
    assert tuple(get_cardinality_stats(e, "src", "dst").first()) == (4 / 3, 2, 4 / 3, 2)


# Ontology ----------------------------------------------------------------------------------------------------------

GOOD = """
name: example
version: "1"
annotations: {vg:database: '{"database_type": "files"}'}
classes:
  Node:
    description: a thing
    instantiates: [vg:SQLMappedClass]
    annotations: {vg:table: nodes, vg:primary_key: '["id"]', vg:soft_delete_column: deleted_at, vg:row_count: 5}
  Other:
    instantiates: [vg:SQLMappedClass]
    annotations: {vg:table: others, vg:primary_key: id}
  LinksTo:
    instantiates: [vg:SQLMappedRelationship]
    annotations:
      vg:edge_table: links
      vg:domain_key: src
      vg:range_key: '["dst"]'
      vg:domain_class: Node
      vg:range_class: Node
      vg:operation_types: "[recursive_traversal, temporal_traversal]"
      vg:temporal_bounds: '{"start_col": "start_date", "end_col": "end_date"}'
      vg:sql_filter: q < 9
      vg:irreflexive: true
      vg:weight_columns: '[{"name": "w", "type": "double"}]'
  OwnedBy:
    instantiates: [vg:SQLMappedRelationship]
    annotations: {vg:edge_table: others, vg:domain_key: owner_id, vg:range_key: id, vg:domain_class: Other, vg:range_class: Node}
"""


def test_ontology_getters():
    o = Ontology.from_text(GOOD)
    assert o.get_class_soft_delete("Node") == (True, "deleted_at") and o.get_class_pk("Node") == ["id"] and o.get_class_row_count("Node") == 5
    assert o.role("links_to") is o.role("LinksTo") and snake_case("SubcomponentOf") == "subcomponent_of"
    assert o.get_operation_types("LinksTo") == ["recursive_traversal", "temporal_traversal"] and o.get_operation_categories("LinksTo") == ["traversal", "temporal"]
    assert o.get_temporal_bounds("links_to") == ("start_date", "end_date") and o.get_role_properties("LinksTo")["irreflexive"]
    assert o.get_role_cardinality("LinksTo") == ("0..*", "0..*") and o.database == {"database_type": "files"} and (o.name, o.version) == ("example", "1")
    assert not o.is_polymorphic("LinksTo") and not o.has_composite_key("Node")
    with pytest.raises(KeyError):
        o.role("Nothing")


def test_ontology_reports_every_problem():
    bad = (
        GOOD.replace("vg:table: nodes, ", "").replace("recursive_traversal", "teleport").replace(', "end_col": "end_date"', "").replace("q < 9", "q < 9; drop").replace("vg:range_class: Node}", "vg:range_class: Ghost}")
    )
    with pytest.raises(OntologyValidationError) as e:
        Ontology.from_text(bad)
    assert {(x.element_name, x.field) for x in e.value.errors} == {("Node", "table"), ("LinksTo", "operation_types"), ("LinksTo", "temporal_bounds"), ("LinksTo", "sql_filter"), ("OwnedBy", "range_class")}
    poly = GOOD.replace("vg:range_class: Node}", "vg:range_class: Node, vg:type_discriminator: '{\"mapping\": {\"x\": \"Other\"}}'}")
    assert {e.field for e in Ontology.from_text(poly, validate=False).validate()} == {"type_discriminator"}


def test_roles_drive_operators(spark, tmp_path):
    o = Ontology.from_text(GOOD)
    tables = {
        "nodes": nodes(spark, range(1, 6), deleted=(4,)),
        "links": edges(spark, [(1, 2), (2, 3), (3, 4), (4, 5), (1, 5, 1.0, 20), (2, 2)]),
        "others": spark.createDataFrame([(50, 1), (51, 4), (52, None)], "id long, owner_id long"),
    }
    rg = RoleGraph(spark, o, tables.__getitem__)
    assert {r["node"] for r in rg.traverse("links_to", 1).paths.collect()} == {1, 2, 3}
    assert {(r["node"], r["value"]) for r in rg.path_aggregate("links_to", 1, "q", "sum").collect()} == {(2, 1.0), (3, 2.0)}
    assert {(r["node"], r["dist"]) for r in rg.distances("links_to", 1).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}
    assert rg.handler_for("LinksTo") == ["traverse"] and rg.components("LinksTo").count() == 1 and rg.centrality("LinksTo").count() == 3
    df, a, b = rg.ends("OwnedBy")
    assert (a, b) == (["id"], ["owner_id"])
    assert sorted((r["type"], r["src"], r["dst"]) for r in relationships(rg).collect()) == [("LinksTo", "1", "2"), ("LinksTo", "2", "2"), ("LinksTo", "2", "3"), ("OwnedBy", "50", "1")]
    assert vertices(rg).groupBy("label").count().orderBy("label").collect() == [("Node", 4), ("Other", 3)]
    materialize_graph(rg, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/relationships").count() == 4
    assert o.classes_table(spark).count() == 2 and o.roles_table(spark).count() == 2


# Quality -----------------------------------------------------------------------------------------------------------


def test_quality(spark):
    g = Graph.of(spark, nodes(spark, range(1, 5), deleted=(4,)), edges(spark, [(1, 2), (2, 1), (3, 3), (1, 9), (4, 9)]), "src", "dst", soft_delete="deleted_at")
    assert {tuple(r) for r in V.dangling_edges(g).collect()} == {(1, 9, "dst"), (4, 9, "both")}
    links = g.with_(soft_delete=None).simple_edges()
    assert [tuple(r) for r in V.mutual_pairs(links).collect()] == [(1, 2)] and V.self_loops(links).count() == 1 and V.one_way_pairs(links).count() == 2
    assert {r["node"] for r in V.repeated_ends(links, "src").collect()} == {1} and V.missing_loops(links).count() == 4
    report = {r["axiom"]: r["violations"] for r in V.axiom_report(spark, g.with_(soft_delete=None), dict.fromkeys(("irreflexive", "asymmetric", "acyclic", "symmetric"), True)).collect()}
    assert report == {"irreflexive": 1, "asymmetric": 1, "acyclic": 1, "symmetric": 2}
    assert V.count_matches(links, 5) == (True, 5) and V.missing_columns(links, ["src", "x"]) == ["x"] and V.missing_entities(links, "src", [1, 8]) == [8]
    assert tuple(V.referential_report(links, "dst", g.nodes, "id").first()) == (5, 2)
    ranked = Graph.of(spark, spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, tier int"), edges(spark, [(1, 2), (2, 1), (3, 1)]), "src", "dst")
    assert tuple(V.back_edge_ratio(ranked, "tier").first()) == (2, 1, 0.5)
    assert not V.table_exists(spark, "no_such_table")


def test_scratch_tables_end_with_their_scope(spark):
    import glob

    from relgraph.sources.scratch import materialize, scratch_root, scratch_scope, shuffles_of

    kept = materialize(spark.range(3).toDF("id"))
    own = f"{scratch_root(spark).removeprefix('file:')}/relgraph-{spark.sparkContext.applicationId}/*"
    before = set(glob.glob(own))
    with scratch_scope():
        inside = materialize(spark.range(5).toDF("id"))
        inside.drop()
        assert materialize(spark.range(7).toDF("id")).df.count() == 7
    assert set(glob.glob(own)) == before and kept.df.count() == kept.rows == 3
    was = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError), shuffles_of(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == was


def test_stream_of_edges(spark, tmp_path):
    from relgraph.streaming.degrees import run_available, streaming_degrees, windowed_edges

    kind = "a long, b string, at timestamp, node string"
    for k, rows in enumerate([[(1, "x", "2024-01-01 00:10:00", "z"), (1, "y", "2024-01-01 00:20:00", "z"), (None, "x", "2024-01-01 00:20:00", "z")], [(2, "x", "2024-01-01 05:00:00", None), (1, None, None, None)]]):
        spark.createDataFrame(rows, kind.replace("timestamp", "string")).selectExpr("a", "b", "cast(at as timestamp) as at", "node").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = run_available(streaming_degrees(stream, "a", "b"), ["node"])
    assert {tuple(r) for r in got.collect()} == {("1", 2, 0), ("2", 1, 0), ("x", 0, 2), ("y", 0, 1)}
    windows = run_available(windowed_edges(stream, "at", "b"), ["start", "b"])
    assert sorted((r["b"], r["n"]) for r in windows.collect() if r["b"]) == [("x", 1), ("x", 2), ("y", 1)]
    assert run_available(streaming_degrees(stream.where("false"), "a", "b"), ["node"]).count() == 0


def test_copy_text_round_trip(spark, tmp_path):
    from relgraph.sources.copytext import copy_lines, read_copy, write_copy

    rows = [(1, "a\tb\\tc\nd\re", True, None), (2, None, False, 1.5), (3, "\\N", None, 0.0), (4, "", True, -2.0)]
    df = spark.createDataFrame(rows, "line long, s string, ok boolean, x double")
    assert copy_lines(df).first()["line"] == "1\ta\\tb\\\\tc\\nd\\re\tt\t\\N"
    write_copy(df, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in read_copy(df, str(tmp_path / "out")).collect()) == rows
    assert copy_lines(df.limit(0)).count() == 0


def test_entry_module_without_optional_part():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and {"p1_found", "p2_found", "p3_found", "p4_found", "p6_found", "g1_explosion"} <= set(q)
