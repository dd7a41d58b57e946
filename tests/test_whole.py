"""Queries over a small network and a structure with cycles, against brute force."""

import datetime

import pytest

from graphs import edges, simple_paths

from relgraph.operators.aggregate import aggregate_paths
from relgraph.operators.model import Graph, Limits
from relgraph.queries import registry

WAYS = [(0, 1, 50.0), (0, 2, 1.0), (0, 3, 30.0), (0, 4, 9.0), (0, 5, 2.0), (5, 6, 2.0), (6, 7, 2.0), (4, 7, 3.0)]
CHAIN = [(i, i + 1, 1.0) for i in range(7, 18)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Each way as an order of two lines; suppliers 0 to 18, of which 18 is eleven steps behind 7."""
    d = str(tmp_path_factory.mktemp("net"))
    day = datetime.date(2024, 1, 1)
    rows = []
    for k, (a, b, q) in enumerate(WAYS + CHAIN):
        rows += [(k, 1, a, 1, q, 1.0, day), (k, 2, b, 1, 1.0, 1.0, day)]
    lines = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(rows, lines).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, 1.0 if i % 2 else -1.0) for i in range(19)], "s_suppkey long, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    return d


def run(spark, folder, name):
    return registry()[0][name](spark, folder).collect()


def test_all_pairs_of_suppliers_count(spark, folder):
    ways = WAYS + CHAIN
    assert {r["node"] for r in run(spark, folder, "g6_pagerank")} == set(range(19))
    assert run(spark, folder, "g8_graph_density")[0]["edges"] == len(ways)
    dist = {0: 0.0}
    for _ in ways:
        for a, b, q in ways:
            if a in dist:
                dist[b] = min(dist.get(b, 9e9), dist[a] + q)
    assert {r["node"]: r["dist"] for r in run(spark, folder, "g4_distances")} == dist
    assert run(spark, folder, "g4_shortest_path_weighted")[0]["path"] == "0/5/6/7/8/9"
    assert {r["path"] for r in run(spark, folder, "g5_all_shortest_paths")} == {"0/4/7/8/9"}


def test_many_paths_beside_a_cycle(spark):
    """64 paths, more than the limit, lead to the end; a cycle within them, with a way out at each node, does not make each count."""
    rows = []
    for k in range(0, 12, 2):
        rows += [(k, k + 1, 1.0, 2), (k, k + 1, 1.0, 3), (k + 1, k + 2, 1.0, 1)]
    rows += [(5, 4, 1.0, 7), (4, 20, 1.0, 2), (20, 5, 1.0, 3), (20, 4, 1.0, 1), (6, 6, 1.0, 9)]
    want = {}
    for path in simple_paths(rows, 0, 99):
        value = 1.0
        for e in path:
            value *= e[3]
        want[path[-1][1]] = want.get(path[-1][1], 0.0) + value
    g = Graph.of(spark, None, edges(spark, rows), "src", "dst")
    got = aggregate_paths(g, 0, "q", "multiply", limits=Limits(max_paths=60))
    assert {r["node"]: r["value"] for r in got.collect()} == want
