import datetime
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from graphs import betweenness, components, edges, groups, nodes, reach, simple_paths

from pyspark.sql import functions as F

from relgraph.operators import network as N
from relgraph.operators.aggregate import OPERATIONS, aggregate_paths, is_acyclic, path_aggregate
from relgraph.operators.blocks import Placed
from relgraph.operators.components import strong_groups
from relgraph.operators.model import Graph, Limits, SafetyLimitExceeded, SubgraphTooLarge
from relgraph.operators.paths import all_shortest_paths, best_paths, distances, paths_within, shortest_path
from relgraph.operators.traverse import fetch_edges_for_frontier, fetch_nodes, multi_source, search, traverse, traverse_collecting

CHAIN = [(1, 2), (2, 3), (3, 4)]
DIAMOND = [(1, 2, 1.0, 2), (1, 3, 1.0, 1), (2, 4, 1.0, 3), (3, 4, 1.0, 5)]


def depths(result):
    return {r["node"]: r["depth"] for r in result.paths.collect()}


def test_traverse_chain(spark):
    e, n = edges(spark, CHAIN), nodes(spark, range(1, 5))
    r = traverse(spark, n, e, "src", "dst", 1)
    assert depths(r) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert (r.depth_reached, r.nodes_visited) == (3, 4)
    assert {tuple(x["path"]) for x in r.paths.collect()} == {(1,), (1, 2), (1, 2, 3), (1, 2, 3, 4)}
    assert {(x[0], x[1]) for x in r.edges.collect()} == set(CHAIN)
    assert depths(traverse(spark, n, e, "src", "dst", 3, direction="inbound")) == {3: 0, 2: 1, 1: 2}
    assert depths(traverse(spark, n, e, "src", "dst", 3, direction="both")) == {3: 0, 2: 1, 4: 1, 1: 2}
    assert depths(traverse(spark, n, e, "src", "dst", 1, max_depth=1, include_start=False)) == {2: 1}
    assert depths(traverse(spark, n, e, "src", "dst", 1, max_depth=0)) == {1: 0}
    assert depths(traverse(spark, n, e, "src", "dst", 4)) == {4: 0}


def test_traverse_options(spark):
    rows = [(1, 2, 1.0, 1, datetime.date(2024, 1, 1), datetime.date(2024, 6, 30)), (1, 3, 1.0, 1, None, None), (2, 4, 1.0, 9, None, None), (3, 4, 1.0, 9, None, datetime.date(2023, 12, 31)), (4, 5)]
    e = edges(spark, rows)
    n = nodes(spark, range(1, 6), lambda i: "stop" if i == 4 else "go", deleted=(2,))
    r = traverse(spark, n, e, "src", "dst", 1, stop_condition="kind = 'stop'", order_by="id DESC", collect_columns=["id", "kind"])
    assert depths(r) == {1: 0, 2: 1, 3: 1, 4: 2}
    assert [x["node"] for x in r.terminal_nodes.collect()] == [4]
    assert [x["id"] for x in r.nodes.collect()] == [4, 3, 2, 1] and r.nodes.columns == ["node", "depth", "id", "kind"]
    assert depths(traverse(spark, n, e, "src", "dst", 1, soft_delete_column="deleted_at")) == {1: 0, 3: 1, 4: 2, 5: 3}
    assert depths(traverse(spark, n, e, "src", "dst", 1, sql_filter="e.q < 5")) == {1: 0, 2: 1, 3: 1}
    assert depths(traverse(spark, n, e, "src", "dst", 1, prefilter_sql="q < 5")) == {1: 0, 2: 1, 3: 1}
    at = {"temporal_start_col": "start_date", "temporal_end_col": "end_date"}
    assert depths(traverse(spark, n, e, "src", "dst", 1, valid_at=datetime.date(2024, 6, 30), **at)) == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert depths(traverse(spark, n, e, "src", "dst", 1, valid_at=datetime.date(2023, 12, 31), **at)) == {1: 0, 3: 1, 4: 2, 5: 3}
    with pytest.raises(SafetyLimitExceeded):
        traverse(spark, n, e, "src", "dst", 1, max_nodes=2)
    c = traverse_collecting(spark, n, e, "src", "dst", 1, "kind = 'stop'")
    assert [x["node"] for x in c.nodes.collect()] == [4]
    assert sorted(tuple(x) for x in fetch_edges_for_frontier(spark, e, spark.createDataFrame([(2,), (4,)], "node long"), "src", "dst", "both").collect()) == [(1, 2), (2, 4), (3, 4), (4, 5)]
    assert [x["id"] for x in fetch_nodes(spark, n, spark.createDataFrame([(3,), (3,), (8,)], "node long")).collect()] == [3]


def test_empty_composite_and_clashing_columns(spark):
    none, n = edges(spark, []), nodes(spark, [1, 2])
    assert depths(traverse(spark, n, none, "src", "dst", 1)) == {1: 0}
    assert shortest_path(spark, n, none, "src", "dst", 1, 2).path is None
    assert N.graph_density(spark, none, "src", "dst")["nodes"] == 0
    assert N.connected_components(spark, n, none, "src", "dst").component_count == 0
    assert N.scores_of(Graph.of(spark, n, none, "src", "dst"), "pagerank").count() == 0
    assert aggregate_paths(Graph.of(spark, n, none, "src", "dst"), 1, "q").count() == 0
    e = spark.createDataFrame([(1, 1, 1, 2, "x"), (1, 2, 2, 1, "y"), (None, 2, 2, 1, "z")], "fa long, fb long, ta long, tb long, node string")
    m = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (2, 1, "r")], "a long, b long, depth string")
    r = traverse(spark, m, e, ["fa", "fb"], ["ta", "tb"], (1, 1), id_column=["a", "b"])
    assert {(tuple(x["node"]), x["depth"]) for x in r.nodes.collect()} == {((1, 1), 0), ((1, 2), 1), ((2, 1), 2)}
    assert shortest_path(spark, m, e, ["fa", "fb"], ["ta", "tb"], (1, 1), (2, 1), id_column=["a", "b"]).hops == 2
    g = Graph.of(spark, m, e, ["fa", "fb"], ["ta", "tb"], id_cols=["a", "b"])
    assert {tuple(x["node"]): x["score"] for x in N.scores_of(g, "betweenness").collect()} == {(1, 1): 0.0, (1, 2): 0.5, (2, 1): 0.0}


@pytest.mark.parametrize("seed", [1])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(22)})
    rows = [(a, b, float(rng.randrange(0, 5)), rng.choice([None, 1, 2, 3])) for a, b in pairs]
    e, n = edges(spark, rows), nodes(spark, range(12))
    start = rows[0][0]
    r = traverse(spark, n, e, "src", "dst", start)
    assert depths(r) == reach(rows, start)
    best = {}
    for p in simple_paths(rows, start, 50):
        path = (start, *[x[1] for x in p])
        best.setdefault(path[-1], []).append((len(path), path))
    assert {x["node"]: tuple(x["path"]) for x in r.paths.collect() if x["depth"]} == {k: min(v)[1] for k, v in best.items()}
    many = multi_source(Graph.of(spark, n, e, "src", "dst"), spark.createDataFrame([(0,), (1,)], "root long"))
    assert {(x["root"], x["node"]): x["depth"] for x in many.collect()} == {(s, v): k for s in (0, 1) for v, k in reach(rows, s).items()}
    found, back = strong_groups(e)
    got = {}
    for x in found.collect():
        got.setdefault(x["component"], []).append(x["node"])
    assert {tuple(sorted(v)) for v in got.values()} == groups(rows) and all(k == min(v) for k, v in got.items())
    left = {(a, b) for a, b, *_ in rows} - {tuple(x) for x in back.collect()}
    assert not groups(sorted(left))
    by_joins, back_by_joins = strong_groups(e, local_edges=0)
    assert {tuple(x) for x in by_joins.collect()} == {tuple(x) for x in found.collect()}
    assert {tuple(x) for x in back_by_joins.collect()} == {tuple(x) for x in back.collect()}
    labels = N.connected_labels(Graph.of(spark, n, e, "src", "dst").simple_edges())
    assert {x["node"]: x["component"] for x in labels.collect()} == components(rows)
    plain = [(a, b) for a, b in pairs if a != b]
    links = Graph.of(spark, n, edges(spark, plain), "src", "dst").simple_edges()
    want = betweenness(plain, 12)
    for scores in (N.betweenness_centrality(links), N.betweenness_centrality(links, Limits(max_broadcast_edges=0))):
        assert {x["node"]: round(x["score"], 9) for x in scores.collect()} == {k: round(v, 9) for k, v in want.items()}
    ends = sorted({x for p in plain for x in p})
    turned = [(b, a) for a, b in plain]
    for x in N.closeness_centrality(links).collect():
        d = reach(turned, x["node"])
        far, k = sum(d.values()), len(d) - 1
        assert math.isclose(x["score"], k / far * k / (len(ends) - 1) if far else 0.0)


def test_pairs_are_listed_where_nodes_lie(spark, monkeypatch):
    """No shuffle after the join that lists the pairs; nodes outside the largest part meet the others in blocks."""
    monkeypatch.setattr(N, "PAIR_BLOCK", 2)
    rows = [(99, k) for k in range(12)] + [(0, 1), (1, 2), (3, 4), (5, 6), (6, 7)]
    r = N.resilience_analysis(spark, None, edges(spark, rows), "src", "dst", 99)
    label = components([p for p in rows if 99 not in p] + [(k, k) for k in range(12)])
    got = [tuple(x) for x in r.disconnected_pairs.collect()]
    assert sorted(got) == [(a, b) for a in range(12) for b in range(a + 1, 12) if label[a] != label[b]] and len(got) == r.pairs_cut
    plan = r.disconnected_pairs._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoopJoin" in plan and "SortMergeJoin" not in plan


def test_counts_of_reach(spark, monkeypatch):
    """Counts by depth, in blocks of roots and of edges, against searches one by one."""
    from relgraph.operators import blocks

    monkeypatch.setattr(blocks, "PORTION", 7)
    rng = random.Random(12)
    pairs = sorted({(rng.randrange(90), rng.randrange(90)) for _ in range(150)})
    per_root, per_node = {}, {}
    for v in {x for p in pairs for x in p}:
        for u, k in reach(pairs, v, 3).items():
            if k:
                per_root[v, k] = per_root.get((v, k), 0) + 1
                per_node[u, k] = per_node.get((u, k), 0) + 1
    a, b = blocks.reach_counts(edges(spark, pairs), 3)
    assert {tuple(x)[:2]: x["n"] for x in a.collect()} == per_root and {tuple(x)[:2]: x["n"] for x in b.collect()} == per_node
    links = Graph.of(spark, None, edges(spark, pairs), "src", "dst").simple_edges()
    by_joins, in_tasks = (N.closeness_centrality(links, limits=Limits(max_task_edges=k)) for k in (0, 40_000_000))
    assert {x["node"]: round(x["score"], 12) for x in by_joins.collect()} == {x["node"]: round(x["score"], 12) for x in in_tasks.collect()}


def test_betweenness_in_tasks_and_by_joins(spark):
    """Beyond what is broadcast the edges are shuffled to tasks, and joined beyond that, with the same scores."""
    rng = random.Random(13)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(160)})
    rows = [(a, b, float(rng.randrange(1, 5))) for a, b in pairs if a != b]
    for weight in (None, "w"):
        links = Graph.of(spark, None, edges(spark, rows), "src", "dst", weight=weight).simple_edges()
        got = [{x["node"]: round(x["score"], 9) for x in N.betweenness_centrality(links, Limits(max_broadcast_edges=a, max_task_edges=b)).collect()} for a, b in ((0, 0), (0, 1000), (1000, 0))]
        assert got[0] == got[1] == got[2] and any(got[0].values())
    # A search stops once every node is reached.
    n = 400
    s, d = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    s, d = s[s != d], d[s != d]
    seen = N.Adjacency(n, s, d, None).hops(0)
    assert len(seen) == 1 and len(seen[0][0]) == n - 1
    w = np.where((d - s) % n <= 9, 1.0, 1000.0)
    a, b = N.Adjacency(n, s, d, w).cheapest(0)
    assert ((b - a) % n <= 9).all() and len(np.unique(b)) == n - 1


def test_hops_in_few_bytes_and_by_node():
    """Unweighted searches against those one edge after the other: thin, dense and torn graphs, and one beyond 2 ** 16 places."""

    def plain(n, out, source):
        depth, ways, order = {source: 0}, Counter({source: 1.0}), [source]
        for a in order:
            for b in out[a]:
                if b not in depth:
                    depth[b] = depth[a] + 1
                    order.append(b)
                if depth[b] == depth[a] + 1:
                    ways[b] += ways[a]
        owed = np.zeros(n)
        for a in reversed(order):
            owed[a] = sum(ways[a] / ways[b] * (1 + owed[b]) for b in out[a] if depth[b] == depth[a] + 1)
        owed[source] = 0.0
        return owed

    rng = np.random.default_rng(14)
    for n, m in ((1, 1), (12, 20), (15, 60), (16, 90), (40, 50), (60, 3_000), (300, 9_000), (90_000, 200_000)):
        s, d = (x.astype(np.int32) for x in np.unique(rng.integers(0, n, (m, 2)), axis=0).T)
        out = [[] for _ in range(n)]
        for a, b in zip(s.tolist(), d.tolist(), strict=True):
            out[a].append(b)
        edges_ = N.HopAdjacency(n, s, d)
        for v in range(0, n, max(1, n // 12)):
            assert np.allclose(edges_.betweenness(v), plain(n, out, v), rtol=1e-9, atol=1e-9)
    # Nodes beyond the first level are met over the edges into them, whichever they are.
    n = 400
    s, d = (x.ravel().astype(np.int32) for x in np.meshgrid(np.arange(n), np.arange(n)))
    kept = (s != d) & ((s > 0) | (d < 390))
    tracemalloc.start()
    owed = N.HopAdjacency(n, s[kept], d[kept]).betweenness(0)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(owed[1:390], 10 / 389) and not owed[390:].any() and most < 24 * kept.sum()


def test_edges_travel_packed(spark):
    """Tasks get all edges in fewer rows than there are edges, weighted or not."""
    rows = [(a, b, a + b / 100) for a in range(40) for b in range(40)]
    for weighted in (False, True):
        links = edges(spark, rows).select("src", "dst", *["w"] * weighted)
        placed = Placed(links)

        def run(n, task, tasks, s, d, w):
            got = sorted(zip(s.tolist(), d.tolist(), [0.0] * len(s) if w is None else w.tolist(), strict=True))
            yield pa.RecordBatch.from_pydict({"task": [task], "all": [got == sorted((a, b, c if w is not None else 0.0) for a, b, c in rows)]})

        done = placed.in_tasks(run, "task long, all boolean")
        assert sorted((x["task"], x["all"]) for x in done.collect()) == [(k, True) for k in range(2)]
        assert done._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 2


def test_search_with_stops(spark):
    rng = random.Random(11)
    rows = sorted({(rng.randrange(20), rng.randrange(20)) for _ in range(45)})
    starts = spark.createDataFrame([(0, 0), (3, 3)], "root long, node long")
    stop = spark.createDataFrame([(5,), (3,), (7,)], "node long")
    found = search(edges(spark, rows).select("src", "dst"), starts, 6, stop, True)
    want = {}
    for root in (0, 3):
        level, seen = {root: (root,)}, {}
        for depth in range(7):
            seen.update({v: (depth, p) for v, p in level.items()})
            nxt = {}
            for a, b in rows:
                if a in level and a not in (5, 3, 7) and b not in seen:
                    nxt[b] = min(nxt.get(b, (99,)), (*level[a], b))
            level = nxt
        want.update({(root, v): x for v, x in seen.items()})
    assert {(r["root"], r["node"]): (r["depth"], tuple(r["path"])) for r in found.df.collect()} == want
    assert found.sizes == [sum(1 for d, _ in want.values() if d == k) for k in range(len(found.sizes))]


def test_path_aggregate(spark):
    g = Graph.of(spark, nodes(spark, range(1, 5)), edges(spark, DIAMOND), "src", "dst")
    want = {"sum": 11.0, "max": 5.0, "min": 1.0, "multiply": 11.0, "count": 2.0}
    for op in OPERATIONS:
        assert {r["node"]: r["value"] for r in aggregate_paths(g, 1, "q", op).collect()}[4] == want[op], op
    assert {r["node"]: r["value"] for r in aggregate_paths(g, 4, "q", "multiply", "inbound").collect()} == {2: 3.0, 3: 5.0, 1: 11.0}
    assert aggregate_paths(g, 1, "q", "sum", max_depth=0).count() == 0
    with pytest.raises(ValueError):
        aggregate_paths(g, 1, "q", "median")
    with pytest.raises(SubgraphTooLarge):
        loop = Graph.of(spark, None, edges(spark, DIAMOND + [(4, 1)]), "src", "dst")
        aggregate_paths(loop, 1, "q", "sum", limits=Limits(max_paths=1))
    rows = path_aggregate(spark, g.nodes, g.edges, "src", "dst", 1, "q", "multiply")
    assert rows.columns == ["node", "depth", "value", "id", "kind", "deleted_at"] and rows.count() == 3


@pytest.mark.parametrize("acyclic", [True, False])
def test_path_aggregate_random(spark, acyclic):
    rng = random.Random(5)
    rows = []
    for _ in range(16):
        a, b = rng.sample(range(8), 2)
        rows.append((min(a, b), max(a, b)) if acyclic else (a, b))
    rows = [(a, b, 1.0, rng.choice([None, 1, 2, 3])) for a, b in rows]
    g = Graph.of(spark, None, edges(spark, rows), "src", "dst")
    assert is_acyclic(g.edge_rows()) == (not groups(rows))
    paths = simple_paths(rows, 0, 6)
    for op in ("sum", "multiply", "max", "min"):
        want = {}
        for p in paths:
            q = [x[3] for x in p]
            known = [x for x in q if x is not None]
            v = (None if None in q else sum(q) if op == "sum" else math.prod(q)) if op in ("sum", "multiply") else (max if op == "max" else min)(known) if known else None
            want.setdefault(p[-1][1], []).append(v)
        fold = {"sum": sum, "multiply": sum, "max": max, "min": min}[op]
        want = {k: float(fold([x for x in v if x is not None])) if any(x is not None for x in v) else 0.0 for k, v in want.items()}
        assert {r["node"]: r["value"] for r in aggregate_paths(g, 0, "q", op, max_depth=6).collect()} == want, op


def test_paths(spark):
    trap = [(1, 9, 100.0), (1, 2, 1.0), (2, 3, 1.0), (3, 9, 1.0)]
    n = nodes(spark, range(1, 10))
    r = shortest_path(spark, n, edges(spark, trap), "src", "dst", 1, 9, weight_col="w")
    assert (r.path, r.distance, r.hops) == ([1, 2, 3, 9], 3.0, 3)
    assert [x["id"] for x in r.nodes.collect()] == [1, 2, 3, 9]
    assert [(x["from_id"], x["to_id"], x["weight"]) for x in r.edges.collect()] == [(1, 2, 1.0), (2, 3, 1.0), (3, 9, 1.0)]
    assert shortest_path(spark, n, edges(spark, trap), "src", "dst", 1, 9).path == [1, 9]
    assert shortest_path(spark, n, edges(spark, trap), "src", "dst", 1, 9, weight_col="w", max_depth=2).path == [1, 9]
    assert shortest_path(spark, n, edges(spark, trap), "src", "dst", 1, 9, weight_col="w", excluded_nodes=[3]).path == [1, 9]
    assert shortest_path(spark, n, edges(spark, trap), "src", "dst", 1, 1).distance == 0.0
    assert shortest_path(spark, n, edges(spark, trap), "src", "dst", 9, 1).error
    parallel = edges(spark, [(1, 2, 5.0), (1, 2, 3.0), (1, 3, 1.0), (3, 2, 1.0), (1, 4, None), (4, 2, 0.0)])
    assert shortest_path(spark, n, parallel, "src", "dst", 1, 2, weight_col="w").path == [1, 3, 2]
    ties = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 5, 9.0)])
    assert [x["path"] for x in all_shortest_paths(spark, n, ties, "src", "dst", 1, 5, weight_col="w").collect()] == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert [x["path"] for x in all_shortest_paths(spark, n, ties, "src", "dst", 1, 5, weight_col="w", max_paths=1).collect()] == [[1, 2, 4, 5]]
    assert all_shortest_paths(spark, n, ties, "src", "dst", 5, 1).count() == 0
    g = Graph.of(spark, n, ties, "src", "dst", weight="w")
    assert [x["dist"] for x in best_paths(g, 1, 5).collect()] == [3.0, 3.0, 9.0]
    assert paths_within(g, 1, 5, 5.0).count() == 2
    with pytest.raises(ValueError):
        shortest_path(spark, n, edges(spark, [(1, 2, -1.0)]), "src", "dst", 1, 2, weight_col="w")


@pytest.mark.parametrize("paths", [True, False])
def test_distances(spark, paths):
    rng = random.Random(7)
    rows = [(rng.randrange(12), rng.randrange(12), float(rng.randrange(4))) for _ in range(30)]
    starts = [(0, 0), (1, 1), (1, 2)]
    best = {(r, v): (0.0, 0, (v,)) for r, v in starts}
    for _ in range(9):
        for (root, v), (dist, hops, path) in list(best.items()):
            for a, b, w in rows:
                if a == v:
                    best[root, b] = min(best.get((root, b), (9e9,)), (dist + w, hops + 1, (*path, b)))
    got = distances(edges(spark, rows), spark.createDataFrame(starts, "root long, node long"), 2**31, paths).collect()
    assert {(r["root"], r["node"]): (r["dist"], r["hops"]) for r in got} == {k: v[:2] for k, v in best.items()}
    if paths:
        assert {(r["root"], r["node"]): tuple(r["path"]) for r in got} == {k: v[2] for k, v in best.items()}
        for end in (3, 8):
            near = distances(edges(spark, rows), spark.createDataFrame(starts[:1], "root long, node long"), 2**31, True, target=F.lit(end)).where(F.col("node") == end).collect()
            assert [(r["dist"], tuple(r["path"])) for r in near] == [(best[0, end][0], best[0, end][2])] * ((0, end) in best)


def test_best_paths_and_weighted_betweenness(spark):
    rng = random.Random(2)
    rows = sorted({(a, b): float(rng.randrange(1, 4)) for a, b in ((rng.randrange(6), rng.randrange(6)) for _ in range(18)) if a != b}.items())
    rows = [(a, b, w) for (a, b), w in rows]
    g = Graph.of(spark, None, edges(spark, rows), "src", "dst", weight="w")
    paths = sorted((sum(e[2] for e in p), len(p), [0, *[e[1] for e in p]]) for p in simple_paths(rows, 0, 99) if p[-1][1] == 5)
    assert len(paths) > 3 and [(x["dist"], x["hops"], x["path"]) for x in best_paths(g, 0, 5, 3, None).collect()] == paths[:3]
    assert sorted((x["dist"], x["path"]) for x in paths_within(g, 0, 5, paths[0][0] + 1, None).collect()) == sorted((d, p) for d, _, p in paths if d <= paths[0][0] + 1)
    links = g.simple_edges()
    local, joined = (N.betweenness_centrality(links, Limits(max_broadcast_edges=k)) for k in (100, 0))
    assert {x["node"]: round(x["score"], 9) for x in local.collect()} == {x["node"]: round(x["score"], 9) for x in joined.collect()}


def test_depth_is_never_shortened_in_silence(spark):
    chain = edges(spark, [(i, i + 1) for i in range(60)])
    n = nodes(spark, range(61))
    assert traverse(spark, n, chain, "src", "dst", 0, max_depth=None, skip_estimation=True).depth_reached == 60
    with pytest.raises(SafetyLimitExceeded):
        traverse(spark, n, chain, "src", "dst", 0, max_depth=60, limits=Limits(max_depth=50))


def test_network(spark):
    star = edges(spark, [(5, 1), (5, 2), (3, 5), (4, 5)])
    n = nodes(spark, range(1, 7))
    r = N.resilience_analysis(spark, n, star, "src", "dst", 5)
    assert (r.components_before, r.components_after, r.is_critical, r.affected_node_count) == (1, 4, True, 4)
    assert r.disconnected_pairs.count() == r.pairs_cut == 6 and r.isolated_nodes.count() == 4
    two = N.resilience_analysis(spark, n, edges(spark, [(5, 1), (1, 2), (2, 5), (5, 3), (3, 4), (6, 6)]), "src", "dst", 5)
    assert {tuple(x) for x in two.disconnected_pairs.collect()} == {(1, 3), (2, 3)} and (two.pairs_cut, two.components_before, two.components_after) == (2, 2, 3)
    assert {tuple(x) for x in two.parts.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
    leaf = N.resilience_analysis(spark, n, star, "src", "dst", 1)
    assert (leaf.component_increase, leaf.is_critical, leaf.affected_node_count) == (0, False, 0)
    with pytest.raises(ValueError):
        N.resilience_analysis(spark, n, star, "src", "dst", 6)
    islands = edges(spark, [(1, 2), (2, 3), (4, 5)])
    c = N.connected_components(spark, n, islands, "src", "dst")
    assert [(x["component"], x["size"], x["sample_nodes"]) for x in c.components.collect()] == [(1, 3, [1, 2, 3]), (4, 2, [4, 5])]
    assert [x["node"] for x in c.isolated_nodes.collect()] == [6] and c.largest_component_size == 3
    assert N.connected_components(spark, n, islands, "src", "dst", min_size=3).component_count == 1
    d = N.graph_density(spark, edges(spark, [(1, 2), (2, 1), (2, 2)]), "src", "dst")
    assert d["is_strongly_connected"] and d["nodes"] == 2 and d["edges"] == 3 and d["max_degree"] == 4
    assert "is_strongly_connected" not in N.graph_density(spark, islands, "src", "dst")
    b = N.neighbors(spark, n, edges(spark, [(1, 2), (1, 2), (3, 1)]), "src", "dst", 1)
    assert (b.outbound_count, b.inbound_count, b.total_degree) == (2, 1, 2)
    top = N.centrality(spark, n, star, "src", "dst", "degree", top_n=1)
    assert [(x["node"], x["score"]) for x in top.results.collect()] == [(5, 1.0)] and top.graph_stats["is_connected"]
    with pytest.raises(ValueError):
        N.centrality(spark, n, star, "src", "dst", "fame")


def test_pagerank(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 1)]
    ids = sorted({x for p in pairs for x in p})
    score = dict.fromkeys(ids, 1 / len(ids))
    out = {v: [b for a, b in pairs if a == v] for v in ids}
    for _ in range(200):
        loose = sum(score[v] for v in ids if not out[v])
        score = {v: 0.85 * (sum(score[a] / len(out[a]) for a, b in pairs if b == v) + loose / len(ids)) + 0.15 / len(ids) for v in ids}
    got = {r["node"]: r["score"] for r in N.pagerank(Graph.of(spark, None, edges(spark, pairs), "src", "dst").simple_edges()).collect()}
    assert all(abs(got[v] - score[v]) < 1e-5 for v in ids)
