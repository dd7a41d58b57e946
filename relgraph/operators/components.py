"""Connected components, weak and strong, as DataFrame loops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.sources.scratch import Scratch, materialize

#: A weak component of up to so many edges is searched inside one task; larger ones by joins.
LOCAL_EDGES = 1_000_000
#: Edges per task where whole components are searched together.
TASK_EDGES = 250_000
#: Peeling goes on while a round takes away at least this share of the edges.
PEEL_SHARE = 0.2


def connected_labels(edges: DataFrame) -> DataFrame:
    """Weakly connected components of edges (src, dst): columns node, component (its smallest node).

    Each node points to the smallest of itself and its neighbours; the trees this makes are flattened by pointing to the
    pointer's pointer; each tree then shrinks to its root, which is its smallest node, and the edges between roots go
    round again. Nodes and edges at least halve every round, so the work is that of the first rounds.
    Nulls: edges with one are left out. Self loops make a component of their node. Repeated edges change nothing. No
    edges, no rows. Ids may be of any orderable type.
    """
    pairs = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst")
    both = materialize(pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    maps: list[Scratch] = []
    while both.rows or not maps:
        points = materialize(both.df.groupBy(F.col("src").alias("node")).agg(F.least("src", F.min("dst")).alias("root")))
        while True:
            inner = points.df.where(F.col("node") != F.col("root")).select(F.col("node").alias("via"), F.col("root").alias("next"))
            once = points.df.join(inner, points.df["root"] == inner["via"], "left").select("node", "root", F.coalesce("next", "root").alias("to"))
            nxt = materialize(once.select("node", F.col("to").alias("root"), (F.col("to") != F.col("root")).alias("moved")), moved=F.count_if("moved"))
            points.drop()
            points = nxt
            if not nxt.seen["moved"]:
                break
        points.df = points.df.drop("moved")
        maps.append(points)
        left = points.df.select(F.col("node").alias("src"), F.col("root").alias("a"))
        right = points.df.select(F.col("node").alias("dst"), F.col("root").alias("b"))
        shrunk = both.df.join(left, "src").join(right, "dst").where(F.col("a") != F.col("b")).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        nxt = materialize(shrunk)
        both.drop()
        both = nxt
    labels = maps[0].df.select("node", F.col("root").alias("component"))
    for m in maps[1:]:
        on = m.df.select(F.col("node").alias("component"), F.col("root").alias("further"))
        labels = labels.join(on, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    return materialize(labels).df if len(maps) > 1 else labels


def peeled(edges: DataFrame, share: float = PEEL_SHARE):
    """Take away, again and again, edges from nodes that no edge enters or to nodes that no edge leaves.

    No cycle loses an edge. Stops when a round takes less than ``share`` of the edges; what is left is a Scratch.
    """
    left = materialize(edges)
    while left.rows:
        ends = left.df.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("side")), F.struct(F.col("dst").alias("node"), F.lit(2).alias("side")))).alias("node", "side"))
        inner = ends.groupBy("node").agg(F.bit_or("side").alias("sides")).where(F.col("sides") == 3).select("node")
        kept = left.df.join(inner, left.df["src"] == inner["node"], "left_semi").join(inner, left.df["dst"] == inner["node"], "left_semi")
        nxt = materialize(kept)
        before, after = left.rows, nxt.rows
        left.drop()
        left = nxt
        if before - after < max(1, share * before):
            break
    return left


def coloured_search(src: np.ndarray, dst: np.ndarray) -> list[list]:
    """Depth-first search with node colours over whole components, without recursion.

    White nodes are unseen, grey ones on the current path, black ones done. An edge to a grey node closes a cycle; the
    nodes that share a cycle come out as one group. Returns the groups of two and more nodes or with a self loop.
    """
    nodes = np.unique(np.r_[src, dst])
    s, d = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    order = np.lexsort((d, s))
    s, d = s[order], d[order]
    first = np.searchsorted(s, np.arange(len(nodes) + 1)).tolist()
    d = d.tolist()
    n = len(nodes)
    white, grey, black = 0, 1, 2
    colour, seen, low = [white] * n, [0] * n, [0] * n
    open_nodes: list[int] = []
    is_open = [False] * n
    groups = []
    clock = 0
    for root in range(n):
        if colour[root] != white:
            continue
        path = [root]
        at = {root: first[root]}
        colour[root], seen[root], low[root] = grey, clock, clock
        clock += 1
        open_nodes.append(root)
        is_open[root] = True
        while path:
            v = path[-1]
            i = at[v]
            if i < first[v + 1]:
                at[v] = i + 1
                u = d[i]
                if colour[u] == white:
                    colour[u], seen[u], low[u] = grey, clock, clock
                    clock += 1
                    open_nodes.append(u)
                    is_open[u] = True
                    at[u] = first[u]
                    path.append(u)
                elif is_open[u]:  # grey, or black in a group that is not yet closed
                    low[v] = min(low[v], seen[u])
                continue
            path.pop()
            del at[v]
            colour[v] = black
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                group = []
                while True:
                    u = open_nodes.pop()
                    is_open[u] = False
                    group.append(u)
                    if u == v:
                        break
                if len(group) > 1 or v in d[first[v] : first[v + 1]]:
                    groups.append(sorted(nodes[x] for x in group))
    return groups


def _search_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    pdf = pd.concat(parts)
    groups = coloured_search(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
    yield pd.DataFrame([(g[0], x) for g in groups for x in g], columns=["component", "node"])


def _reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable from start (node, colour) along edges (src, dst, colour) of the same colour, start included."""
    seen = materialize(start.distinct())
    front = seen
    while front.rows:
        step = edges.join(front.df, (edges["src"] == front.df["node"]) & (edges["colour"] == front.df["colour"])).select(F.col("dst").alias("node"), edges["colour"]).distinct()
        front = materialize(step.join(seen.df, ["node", "colour"], "left_anti"))
        seen = materialize(seen.df.union(front.df))
    return seen.df


def strong_labels_by_joins(edges: DataFrame) -> DataFrame:
    """Strongly connected groups of two and more nodes, by joins only: columns component (smallest node), node.

    Every node takes the greatest node that reaches it as its colour; a node that keeps its own colour is a root, and
    its group is what reaches it inside its colour. Found groups leave, the rest goes round again.
    """
    found = None
    left = peeled(edges.where(F.col("src") != F.col("dst")).distinct(), 0)
    while left.rows:
        ends = left.df.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colours = materialize(ends.select("node", F.col("node").alias("colour")))
        while True:
            told = left.df.join(colours.df, left.df["src"] == colours.df["node"]).groupBy("dst").agg(F.max("colour").alias("told"))
            nxt = colours.df.join(told, colours.df["node"] == told["dst"], "left").select("node", F.col("colour").alias("old"), F.greatest("colour", "told").alias("colour"))
            nxt = materialize(nxt.select("node", "colour", (F.col("colour") != F.col("old")).alias("moved")), moved=F.count_if("moved"))
            colours.drop()
            colours = nxt
            if not nxt.seen["moved"]:
                break
        c = colours.df.drop("moved")
        coloured = left.df.join(c.select(F.col("node").alias("src"), "colour"), "src").join(c.select(F.col("node").alias("dst"), F.col("colour").alias("colour2")), "dst")
        inside = materialize(coloured.where(F.col("colour") == F.col("colour2")).select("src", "dst", "colour"))
        back = inside.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "colour")
        members = _reach(back, c.where(F.col("node") == F.col("colour")))
        ids = members.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n"))
        groups = materialize(members.join(ids.where(F.col("n") > 1), "colour").select("component", "node"))
        found = groups.df if found is None else found.union(groups.df)
        gone = members.select(F.col("node"))
        rest = inside.df.join(gone, inside.df["src"] == gone["node"], "left_anti").join(gone, inside.df["dst"] == gone["node"], "left_anti").select("src", "dst")
        left.drop()
        left = peeled(rest, 0)
    if found is None:
        return edges.select(F.col("src").alias("component"), F.col("dst").alias("node")).limit(0)
    return found


def strong_groups(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> tuple[DataFrame, DataFrame]:
    """Groups of nodes that reach each other, and the back edges that close their cycles.

    edges: src, dst (long). Returns (component, node) for groups of two and more nodes and for nodes with a self loop,
    component being the smallest node, and (src, dst) of the back edges: with the nodes of a group taken in ascending
    order, the edges inside it that do not ascend. Without them no cycle is left.

    Edges that cannot lie on a cycle are peeled off first; the rest falls into weak components, each is brought into
    one task and searched depth-first with colours. A weak component of more than local_edges edges would not be safe in
    one task and is split by joins instead, with the same results.
    """
    pairs = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    all_ = materialize(pairs.distinct())
    loops = all_.df.where(F.col("src") == F.col("dst"))
    left = peeled(all_.df.where(F.col("src") != F.col("dst")))
    labels = connected_labels(left.df)
    labelled = materialize(left.df.join(labels, left.df["src"] == labels["node"]).select("src", "dst", "component"))
    sizes = labelled.df.groupBy("component").count()
    big = [r[0] for r in sizes.where(F.col("count") > local_edges).select("component").collect()]  # at most edges / local_edges rows
    small = labelled.df.where(~F.col("component").isin(big)) if big else labelled.df
    tasks = max(1, -(-labelled.rows // TASK_EDGES), min(8, labelled.rows // 1000))
    groups = small.repartition(tasks, "component").select("src", "dst").mapInPandas(_search_partition, "component long, node long")
    if big:
        groups = groups.union(strong_labels_by_joins(labelled.df.where(F.col("component").isin(big)).select("src", "dst")))
    groups = materialize(groups).df
    ours, theirs = groups.select(F.col("node").alias("src"), F.col("component").alias("c1")), groups.select(F.col("node").alias("dst"), F.col("component").alias("c2"))
    inside = labelled.df.select("src", "dst").where(F.col("dst") < F.col("src")).join(ours, "src").join(theirs, "dst")
    back = inside.where(F.col("c1") == F.col("c2")).select("src", "dst")
    alone = loops.select(F.col("src").alias("node")).join(groups, "node", "left_anti").select(F.col("node").alias("component"), "node")
    return groups.union(alone), back.union(loops)
