"""Whole-graph measures: centrality, components, density, neighbours, resilience."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relgraph.operators.blocks import Placed, reach_counts
from relgraph.operators.components import connected_labels
from relgraph.operators.model import ANY_DEPTH, LIMITS, Graph, Limits, key_literal
from relgraph.operators.paths import distances
from relgraph.operators.traverse import search
from relgraph.sources.scratch import materialize

CENTRALITIES = ("degree", "betweenness", "closeness", "pagerank")
# Fixed values of PageRank.
ALPHA, TOLERANCE, ITERATIONS = 0.85, 1e-6, 100
#: Pairs of nodes that a block of searches may meet.
PAIRS = 200_000_000
#: Nodes that are sent to every task at once where pairs are listed, pairs that such a task lists, and tasks at most.
PAIR_BLOCK, PAIR_ROWS, MOST_TASKS = 20_000, 20_000_000, 4_000
#: PageRank iterations planned as one job.
BLOCK = 4


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degree_centrality(links: DataFrame) -> DataFrame:
    """node, score = (in + out degree) / (n - 1) over simple edges; a single node scores 1. A self loop counts twice."""
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").count()
    n = ends.count()
    return ends.select("node", (F.col("count") / F.lit(float(n - 1)) if n > 1 else F.lit(1.0)).alias("score"))


def closeness_centrality(links: DataFrame, roots: DataFrame | None = None, limits: Limits = LIMITS) -> DataFrame:
    """node, score over the ways into each node, in edges, scaled by the share of nodes that reach it; 0 if none does.

    roots (a column node) may name the nodes whose score is wanted. For all nodes, up to limits.max_task_edges, pairs are
    counted in tasks that hold all edges (blocks.reach_counts). Else the searches run as joins, in blocks of so many roots
    that a block meets about PAIRS nodes, and of each only one row a root stays.
    """
    held = materialize(links.select("src", "dst"))
    nodes = materialize(_ends(held.df))
    n = nodes.rows
    turned = held.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if roots is None and n and held.rows <= limits.max_task_edges:
        found, _ = reach_counts(turned, ANY_DEPTH)
        far = found.groupBy(F.col("root").alias("node")).agg(F.sum("n").alias("reached"), F.sum(F.col("n") * F.col("depth")).alias("far"))
        return nodes.df.join(far, "node", "left").select("node", F.coalesce(F.col("reached") / F.col("far") * F.col("reached") / F.lit(float(max(1, n - 1))), F.lit(0.0)).alias("score"))
    wanted = nodes.df if roots is None else nodes.df.join(roots.select("node"), "node", "left_semi")
    blocks = max(1, -(-n * n // PAIRS))
    parts = []
    for k in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k) if blocks > 1 else wanted
        found = search(turned, mine.select(F.col("node").alias("root"), "node"), ANY_DEPTH, None, False)
        parts.append(materialize(found.df.groupBy(F.col("root").alias("node")).agg((F.count(F.lit(1)) - 1).alias("reached"), F.sum("depth").alias("far"))).df)
        for x in found.tables:
            x.drop()
    per = reduce(DataFrame.unionAll, parts)
    score = F.when((F.col("far") > 0) & F.lit(n > 1), F.col("reached") / F.col("far") * F.col("reached") / F.lit(float(max(1, n - 1)))).otherwise(0.0)
    return per.select("node", score.alias("score"))


def pagerank(links: DataFrame, alpha: float = ALPHA, tolerance: float = TOLERANCE, iterations: int = ITERATIONS) -> DataFrame:
    """node, score by power iteration; nodes without a way out spread their score evenly.

    links: src, dst and optionally w (shares of a node's score; nodes whose weights sum to 0 count as without a way out).
    Ends after ``iterations`` rounds, or once the scores of a round differ from those before by less than tolerance per
    node. A few rounds make one job; the difference is taken at its end.
    """
    w = F.col("w") if "w" in links.columns else F.lit(1.0)
    held = materialize(links.select("src", "dst", w.cast("double").alias("w")))
    nodes = materialize(_ends(held.df))
    n = nodes.rows
    if n == 0:
        return nodes.df.select("node", F.lit(0.0).alias("score"))
    sums = held.df.groupBy("src").agg(F.sum("w").alias("out")).where(F.col("out") > 0)
    shares = materialize(held.df.join(sums, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share"))).df
    outlets = sums.select(F.col("src").alias("node"), F.lit(1).alias("outlet"))
    base = materialize(nodes.df.join(outlets, "node", "left").select("node", F.col("outlet").isNull().alias("dangling"))).df
    held_back = F.sum(F.when(F.col("dangling"), F.col("score")))
    state = materialize(base.select("node", "dangling", F.lit(1.0 / n).alias("score")), loose=held_back)
    done = 0
    while done < iterations:
        cur = state.df
        loose = float(state.seen["loose"] or 0.0)
        rounds = 1 if done + BLOCK > iterations else BLOCK
        lost = F.lit(loose)
        for _ in range(rounds):
            got = cur.join(shares, cur["node"] == shares["src"]).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
            nxt = base.join(got, base["node"] == got["to"], "left").select("node", "dangling", (F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + lost / n) + F.lit((1 - alpha) / n)).alias("score"))
            before, cur = cur, nxt
            if rounds > 1 and _ < rounds - 1:
                # What dangling nodes hold in the next round is a scalar of this one.
                lost = F.coalesce(cur.where("dangling").agg(F.sum("score")).scalar(), F.lit(0.0))
        was = before.select("node", F.col("score").alias("was"))
        new = materialize(cur.join(was, "node"), moved=F.sum(F.abs(F.col("score") - F.col("was"))), loose=held_back)
        state.drop()
        state = new
        state.df = new.df.drop("was")
        done += rounds
        if new.seen["moved"] < tolerance * n:
            break
    return state.df.select("node", "score")


class Adjacency:
    """Edges between places 0 to n - 1 in arrays, sorted by where they start, with their order by where they end."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None):
        order = np.lexsort((dst, src))
        self.n, self.src, self.dst = n, src[order], dst[order]
        self.weight = None if weight is None else weight[order]
        self.start = np.searchsorted(self.src, np.arange(n + 1))
        self.by_end = np.argsort(self.dst, kind="stable")
        self.into = np.searchsorted(self.dst[self.by_end], np.arange(n + 1))
        self._bounds: list[float] = []
        self._lighter: dict[int, tuple[float, Adjacency]] = {}

    def hops(self, source: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(from, to) of the edges on ways of fewest edges, level by level.

        A level follows the edges that leave the last one, or those that enter what is not reached yet, if they are fewer.
        """
        depth = np.full(self.n, -1)
        depth[source] = 0
        front, out, left = np.array([source]), [], self.n - 1
        while len(front) and left:
            k = len(out)
            leaving, entering = self._span(self.start, front), None
            if len(front) > left // 4:
                bare = np.flatnonzero(depth < 0)
                entering = self._span(self.into, bare)
            if entering is not None and entering[1] < leaving[1]:
                e = self.by_end[self._listed(*entering)]
                a, b = self.src[e], self.dst[e]
                tight = depth[a] == k
            else:
                e = self._listed(*leaving)
                a, b = self.src[e], self.dst[e]
                tight = depth[b] < 0
            a, b = a[tight], b[tight]
            new = np.zeros(self.n, dtype=bool)
            new[b] = True
            front = np.flatnonzero(new)
            depth[front] = k + 1
            left -= len(front)
            out.append((a, b))
        return out

    @staticmethod
    def _span(start: np.ndarray, nodes: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        size = start[nodes + 1] - start[nodes]
        return (start[nodes], size), int(size.sum())

    @staticmethod
    def _listed(span: tuple[np.ndarray, np.ndarray], total: int) -> np.ndarray:
        """Positions of the edges of each node, one node after the other."""
        begin, size = span
        return np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)

    def _light(self, k: int) -> tuple[float, Adjacency]:
        """The edges up to the k-th bound of weight, each bound about twice as many edges as the one before, and the bound."""
        if k not in self._lighter:
            if not self._bounds:
                share = min(1.0, 8 * self.n / max(1, len(self.src)))
                while share < 1:
                    self._bounds.append(float(np.quantile(self.weight, share, method="higher")))
                    share *= 2
                self._bounds.append(np.inf)
            most = self._bounds[k]
            kept = self.weight <= most
            self._lighter[k] = (most, self if kept.all() else Adjacency(self.n, self.src[kept], self.dst[kept], self.weight[kept]))
        return self._lighter[k]

    def _relaxed(self, source: int) -> np.ndarray:
        """Least distances; each round follows the edges of the nodes that have come nearer."""
        dist = np.full(self.n, np.inf)
        dist[source] = 0.0
        front = np.array([source])
        while len(front):
            e = self._listed(*self._span(self.start, front))
            offer, to = dist[self.src[e]] + self.weight[e], self.dst[e]
            nearer = offer < dist[to]
            np.minimum.at(dist, to[nearer], offer[nearer])
            moved = np.zeros(self.n, dtype=bool)
            moved[to[nearer]] = True
            front = np.flatnonzero(moved)
        return dist

    def cheapest(self, source: int) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of the edges on cheapest ways; weights greater than 0.

        Light edges come first. Once they reach every node within their bound, no heavier edge is on a cheapest way;
        until then more edges are taken, in the end all.
        """
        k = 0
        while True:
            most, light = self._light(k)
            dist = light._relaxed(source)
            far = dist.max()
            if far <= most:
                break
            k += 1
            while np.isfinite(far) and self._bounds[k] < far:
                k += 1
            if not np.isfinite(far) and k < len(self._bounds) - 1 and not self._whole(source):
                k = len(self._bounds) - 1
        ways = dist[light.src] + light.weight
        tight = np.isfinite(ways) & (ways == dist[light.dst])
        return light.src[tight], light.dst[tight]

    def _whole(self, source: int) -> bool:
        """Whether all nodes can be reached."""
        return sum(len(np.unique(b)) for _, b in self.hops(source)) == self.n - 1

    def betweenness(self, source: int) -> np.ndarray:
        """What the cheapest ways from one source contribute to the betweenness of all nodes."""
        if (self.weight <= 0).any():
            return self._with_free_edges(source)
        a, b = self.cheapest(source)
        # Such edges make no cycle, so walks of each length add up and come to an end.
        step = np.zeros(self.n)
        step[source] = 1.0
        ways = step.copy()
        while len(a) and (step := np.bincount(b, step[a], self.n)).any():
            ways += step
        step = share = ways[a] / ways[b]
        owed = np.bincount(a, share, self.n)
        total = owed.copy()
        while len(a) and (owed := np.bincount(a, share * owed[b], self.n)).any():
            total += owed
        total[source] = 0.0
        return total

    def _with_free_edges(self, source: int) -> np.ndarray:
        """As betweenness(); a node is done once, in order of distance, so that circles that cost nothing end."""
        ways, dist = np.zeros(self.n), np.full(self.n, np.inf)
        ways[source], dist[source] = 1.0, 0.0
        before: list[list[int]] = [[] for _ in range(self.n)]
        order: list[int] = []
        heap, done = [(0.0, source)], np.zeros(self.n, dtype=bool)
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = True
            order.append(v)
            for k in range(self.start[v], self.start[v + 1]):
                u, far = self.dst[k], d + self.weight[k]
                if far < dist[u]:
                    dist[u], ways[u], before[u] = far, ways[v], [v]
                    heapq.heappush(heap, (far, u))
                elif far == dist[u] and not done[u]:
                    ways[u] += ways[v]
                    before[u].append(v)
        owed = np.zeros(self.n)
        for u in reversed(order):
            for v in before[u]:
                owed[v] += ways[v] / ways[u] * (1 + owed[u])
        owed[source] = 0.0
        return owed


class Fans:
    """For each place from 0 to n - 1 the places at the other ends of its edges, one place after the other."""

    def __init__(self, n: int, here: np.ndarray, there: np.ndarray):
        key = here.astype(np.min_scalar_type(n * n))
        key *= n
        np.add(key, there, out=key, dtype=key.dtype, casting="unsafe")
        key.sort()
        self.start = np.r_[np.searchsorted(key, np.arange(n, dtype=key.dtype) * key.dtype.type(n)), len(key)]
        self.size = np.diff(self.start)
        key %= n
        self.there = key.astype(np.min_scalar_type(n))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many edges each node has, where they begin in what comes last, and their other ends."""
        begin, size = self.start[nodes], self.size[nodes]
        first = np.cumsum(size) - size
        total = int(size.sum())
        if total > 64 * len(nodes):
            return size, first, np.concatenate([self.there[i:j] for i, j in zip(begin.tolist(), (begin + size).tolist(), strict=True)], dtype=np.intp)
        return size, first, self.there[np.repeat(begin - first, size) + np.arange(total)].astype(np.intp)


class HopAdjacency:
    """Edges without weights between places 0 to n - 1, by where they start and by where they end, in a few bytes each."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.n, self.leaving, self.entering = n, Fans(n, src, dst), Fans(n, dst, src)

    def betweenness(self, source: int) -> np.ndarray:
        """What the ways of fewest edges from one source contribute to the betweenness of all nodes.

        A level follows the edges that leave the last one, or those that enter what is not reached yet, if they are fewer.
        Ways are added up, and on the way back shared out, by node where the edges of a node lie side by side.
        """
        n, leaving, entering = self.n, self.leaving, self.entering
        ways, bare = np.zeros(n), np.ones(n, dtype=bool)
        ways[source], bare[source] = 1.0, False
        left = len(entering.there) - entering.size[source]
        front, levels = np.array([source]), []
        while left and len(front := front[leaving.size[front] > 0]):
            if leaving.size[front].sum() <= left:
                size, first, there = leaving.of(front)
                got = np.bincount(there, np.repeat(ways[front], size), n)
                got[~bare] = 0.0
                new = np.flatnonzero(got)
                ways[new] = got[new]
                levels.append((front, new, there, first, None))
            else:
                ends = np.flatnonzero(bare & (entering.size > 0))
                size, first, there = entering.of(ends)
                near = np.zeros(n)
                near[front] = ways[front]
                got = np.add.reduceat(near[there], first)
                met = got > 0
                new = ends[met]
                ways[new] = got[met]
                levels.append((front, new, there, size, met))
            bare[new] = False
            left -= entering.size[new].sum()
            front = new
        owed = np.zeros(n)
        for front, new, there, by_node, met in reversed(levels):
            part = np.zeros(n if met is None else len(met))
            part[new if met is None else met] = (1 + owed[new]) / ways[new]
            if met is None:
                owed[front] = ways[front] * np.add.reduceat(part[there], by_node)
            else:
                owed[front] = ways[front] * np.bincount(there, np.repeat(part, by_node), n)[front]
        owed[source] = 0.0
        return owed


def _searched(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None) -> Adjacency | HopAdjacency:
    return HopAdjacency(n, src, dst) if weight is None else Adjacency(n, src, dst, weight)


def _betweenness_local(links: DataFrame, weighted: bool) -> DataFrame:
    """Sources spread over tasks, each with the whole adjacency, whose size the caller has checked."""
    pdf = links.select("src", "dst", *(["w"] if weighted else [])).toPandas()
    ids = np.unique(np.r_[pdf["src"].to_numpy(), pdf["dst"].to_numpy()])
    s, d = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])
    n = len(ids)
    shared = links.sparkSession.sparkContext.broadcast((n, s, d, pdf["w"].to_numpy(float) if weighted else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, edges = np.zeros(n), _searched(*shared.value)
        for pdf in batches:
            for v in pdf["id"]:
                score += edges.betweenness(int(v))
        at = np.flatnonzero(score)
        yield pd.DataFrame({"place": at, "part": score[at]})

    spark = links.sparkSession
    parts = spark.range(0, n, 1, max(1, min(n // 16, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "place long, part double")
    names = spark.createDataFrame(pd.DataFrame({"place": np.arange(n), "node": ids}))
    sums = parts.groupBy("place").agg(F.sum("part").alias("raw"))
    return names.join(sums, "place", "left").select("node", F.coalesce("raw", F.lit(0.0)).alias("raw"))


def _betweenness_in_tasks(links: DataFrame) -> DataFrame:
    """As _betweenness_local(), with the edges shuffled to the tasks, so that the driver holds none; any kind of id."""
    placed = Placed(links)

    def run(n: int, task: int, tasks: int, s: np.ndarray, d: np.ndarray, w: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        score, edges = np.zeros(n), _searched(n, s, d, w)
        del s, d, w
        for v in range(task, n, tasks):
            score += edges.betweenness(v)
        at = np.flatnonzero(score)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(score[at])], names=["place", "part"])

    sums = placed.in_tasks(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("raw"))
    return placed.nodes.df.join(sums, "place", "left").select("node", F.coalesce("raw", F.lit(0.0)).alias("raw"))


def _betweenness_joins(links: DataFrame) -> DataFrame:
    """Unweighted betweenness by joins alone: counts of shortest ways outward level by level, then dependencies inward."""
    held = materialize(links.select("src", "dst"))
    nodes = _ends(held.df)
    level = materialize(nodes.select(F.col("node").alias("root"), "node", F.lit(1.0).alias("ways")))
    levels = [level]
    visited = level.df.select("root", "node")
    while True:
        met = level.df.join(held.df, level.df["node"] == held.df["src"]).groupBy("root", F.col("dst").alias("node")).agg(F.sum("ways").alias("ways"))
        level = materialize(met.join(visited, ["root", "node"], "left_anti"))
        if level.rows == 0:
            break
        levels.append(level)
        visited = visited.union(level.df.select("root", "node"))
    owed = None
    scores = None
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k].df
        here = here.withColumn("owed", F.lit(0.0)) if owed is None else here.join(owed, ["root", "node"], "left").withColumn("owed", F.coalesce("owed", F.lit(0.0)))
        here = materialize(here).df
        part = here.select("node", F.col("owed").alias("part"))
        scores = part if scores is None else scores.union(part)
        back = here.select("root", F.col("node").alias("dst"), ((1 + F.col("owed")) / F.col("ways")).alias("share")).join(held.df, "dst")
        near = levels[k - 1].df
        owed = near.join(back.withColumnRenamed("src", "node"), ["root", "node"]).groupBy("root", "node").agg(F.sum(F.col("ways") * F.col("share")).alias("owed"))
    if scores is None:
        return nodes.select("node", F.lit(0.0).alias("raw"))
    sums = scores.groupBy("node").agg(F.sum("part").alias("raw"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("raw", F.lit(0.0)).alias("raw"))


def _betweenness_weighted_joins(links: DataFrame) -> DataFrame:
    """Weighted betweenness by joins: distances, then walks over the edges that lie on cheapest ways, out and back.

    Such edges form an acyclic graph for each root, so the numbers of walks of each length add up to the number of ways,
    and likewise for the shares that go back.
    """
    if links.where("w <= 0").limit(1).count():
        raise ValueError("weights must be greater than 0")
    nodes = _ends(links)
    near = materialize(distances(links, nodes.select(F.col("node").alias("root"), "node"), ANY_DEPTH, False)).df.select("root", "node", "dist")
    a = near.select("root", F.col("node").alias("src"), F.col("dist").alias("d0"))
    b = near.select("root", F.col("node").alias("dst"), F.col("dist").alias("d1"))
    tight = materialize(links.join(a, "src").join(b, ["root", "dst"]).where(F.col("d0") + F.col("w") == F.col("d1")).select("root", "src", "dst")).df

    def walked(level: DataFrame, step) -> DataFrame:
        levels = [materialize(level)]
        while levels[-1].rows:
            levels.append(materialize(step(levels[-1].df)))
        return materialize(reduce(DataFrame.unionAll, [x.df for x in levels]).groupBy("root", "node").agg(F.sum("v").alias("v"))).df

    def out(level: DataFrame) -> DataFrame:
        return level.join(tight, (level["root"] == tight["root"]) & (level["node"] == tight["src"])).groupBy(tight["root"], F.col("dst").alias("node")).agg(F.sum("v").alias("v"))

    ways = walked(nodes.select(F.col("node").alias("root"), "node", F.lit(1.0).alias("v")), out)
    shares = tight.join(ways.select("root", F.col("node").alias("src"), F.col("v").alias("x")), ["root", "src"]).join(ways.select("root", F.col("node").alias("dst"), F.col("v").alias("y")), ["root", "dst"])
    shares = materialize(shares.select("root", "src", "dst", (F.col("x") / F.col("y")).alias("share"))).df

    def back(level: DataFrame) -> DataFrame:
        return level.join(shares, (level["root"] == shares["root"]) & (level["node"] == shares["dst"])).groupBy(shares["root"], F.col("src").alias("node")).agg(F.sum(F.col("v") * F.col("share")).alias("v"))

    # What a node is owed: all that comes back over one edge and more.
    owed = walked(shares.groupBy("root", F.col("src").alias("node")).agg(F.sum("share").alias("v")), back)
    raw = owed.where(F.col("root") != F.col("node")).groupBy("node").agg(F.sum("v").alias("raw"))
    return nodes.join(raw, "node", "left").select("node", F.coalesce("raw", F.lit(0.0)).alias("raw"))


def betweenness_centrality(links: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """node, score: share of shortest ways through each node, directed, over (n - 1)(n - 2); 0 for up to two nodes.

    links: src, dst, and w for weighted ways. An edge table within limits.max_task_edges is shuffled to tasks that share
    the sources, since on the driver two million edges take more memory than it has; one beyond that, but within
    limits.max_broadcast_edges, goes by the driver; a larger one runs as joins. There, weights must be greater than 0.
    """
    held = materialize(links)
    weighted = "w" in links.columns
    if held.rows == 0:
        return held.df.select(F.col("src").alias("node"), F.lit(0.0).alias("score"))
    if held.rows <= limits.max_task_edges:
        raw = _betweenness_in_tasks(held.df)
    elif held.rows <= limits.max_broadcast_edges and not isinstance(held.df.schema["src"].dataType.jsonValue(), dict):
        raw = _betweenness_local(held.df, weighted)
    elif weighted:
        raw = _betweenness_weighted_joins(held.df)
    else:
        raw = _betweenness_joins(held.df)
    raw = materialize(raw)
    n = raw.rows
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return raw.df.select("node", (F.col("raw") * scale).alias("score"))


@dataclass
class CentralityResult:
    """results: node, score and the node table's columns, best first; graph_stats: nodes, edges, density, is_connected."""

    results: DataFrame
    graph_stats: dict


def scores_of(g: Graph, centrality_type: str, limits: Limits = LIMITS) -> DataFrame:
    """node, score of every node that an edge touches."""
    if centrality_type not in CENTRALITIES:
        raise ValueError(f"centrality_type must be one of {CENTRALITIES}")
    links = g.simple_edges()
    plain = links.select("src", "dst")
    return {
        "degree": lambda: degree_centrality(plain),
        "closeness": lambda: closeness_centrality(plain, limits=limits),
        "betweenness": lambda: betweenness_centrality(links, limits),
        "pagerank": lambda: pagerank(links),
    }[centrality_type]()


def graph_stats(links: DataFrame) -> dict:
    """nodes, edges, density m / (n (n - 1)), is_connected (weakly) of simple edges; no edges: zeros and False."""
    held = materialize(links.select("src", "dst"))
    labels = connected_labels(held.df)
    r = labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("c")).first()
    n, m = r["n"], held.rows
    return {"nodes": n, "edges": m, "density": m / (n * (n - 1)) if n > 1 else 0.0, "is_connected": r["c"] == 1}


def centrality(
    spark: SparkSession, nodes: DataFrame | str, edges: DataFrame | str, edge_from_col, edge_to_col, centrality_type: str = "degree", top_n: int = 10, weight_col: str | None = None,
    id_column: str | Sequence[str] = "id", soft_delete_column: str | None = None, sql_filter: str | None = None, limits: Limits = LIMITS,
) -> CentralityResult:
    """The top_n nodes by a centrality, ties by id, with their rows, and figures of the whole graph. closeness ignores weights."""
    g = Graph.of(spark, nodes, edges, edge_from_col, edge_to_col, weight=weight_col, id_cols=id_column, soft_delete=soft_delete_column, sql_filter=sql_filter)
    top = scores_of(g, centrality_type, limits).orderBy(F.desc("score"), "node").limit(top_n)
    return CentralityResult(g.node_rows(top).orderBy(F.desc("score"), "node"), graph_stats(g.simple_edges()))


def components_of(g: Graph, min_size: int = 1, with_isolated: bool = False) -> DataFrame:
    """component (smallest node), size, sample_nodes (its five smallest), for components of at least min_size nodes.

    with_isolated adds the nodes of the node table that no edge touches, each as its own component.
    """
    labels = connected_labels(g.simple_edges())
    if with_isolated:
        alone = isolates(g)
        labels = labels.union(alone.select("node", F.col("node").alias("component")))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_size)
    ranked = labels.withColumn("rank", F.row_number().over(Window.partitionBy("component").orderBy("node"))).where(F.col("rank") <= 5)
    samples = ranked.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("sample_nodes"))
    return sizes.join(samples, "component").orderBy(F.desc("size"), "component")


def isolates(g: Graph) -> DataFrame:
    """Live nodes of the node table that no edge touches: node."""
    return g.live_nodes().select(F.col("__id").alias("node")).distinct().join(_ends(g.simple_edges()), "node", "left_anti")


@dataclass
class ComponentsResult:
    components: DataFrame
    component_count: int
    largest_component_size: int
    isolated_nodes: DataFrame
    graph_stats: dict


def connected_components(spark: SparkSession, nodes: DataFrame | str, edges: DataFrame | str, edge_from_col, edge_to_col, min_size: int = 1, id_column: str | Sequence[str] = "id", soft_delete_column: str | None = None, sql_filter: str | None = None) -> ComponentsResult:
    """Weakly connected components, largest first; isolated_nodes are the node table's rows without any edge."""
    g = Graph.of(spark, nodes, edges, edge_from_col, edge_to_col, id_cols=id_column, soft_delete=soft_delete_column, sql_filter=sql_filter)
    found = materialize(components_of(g, min_size)).df
    r = found.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()
    return ComponentsResult(found.orderBy(F.desc("size"), "component"), r["n"], r["most"] or 0, isolates(g), graph_stats(g.simple_edges()))


def graph_density(spark: SparkSession, edges: DataFrame | str, edge_from_col, edge_to_col, weight_col: str | None = None, nodes: DataFrame | str | None = None, node_id_column: str | Sequence[str] = "id", soft_delete_column: str | None = None, sql_filter: str | None = None) -> dict:
    """nodes, edges, density, is_directed, is_weakly_connected, is_strongly_connected (only if weakly), avg/max/min degree."""
    g = Graph.of(spark, nodes, edges, edge_from_col, edge_to_col, weight=weight_col, id_cols=node_id_column, soft_delete=soft_delete_column, sql_filter=sql_filter)
    links = materialize(g.simple_edges().select("src", "dst")).df
    stats = graph_stats(links)
    out = {"nodes": stats["nodes"], "edges": stats["edges"], "density": stats["density"], "is_directed": True, "is_weakly_connected": stats["is_connected"]}
    if stats["is_connected"]:
        out["is_strongly_connected"] = is_strong(links, stats["nodes"])
    if stats["nodes"]:
        r = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").count().agg(F.avg("count"), F.max("count"), F.min("count")).first()
        out |= {"avg_degree": r[0], "max_degree": r[1], "min_degree": r[2]}
    return out


def is_strong(links: DataFrame, n: int) -> bool:
    """Whether one node reaches all n nodes and all reach it."""
    root = links.agg(F.min("src").alias("node")).select(F.col("node").alias("root"), "node")
    turned = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return all(sum(search(e, root, n, None, False).sizes) == n for e in (links, turned))


@dataclass
class NeighborsResult:
    """neighbors: node and its row, distinct; degrees count edges, total_degree counts distinct neighbours."""

    neighbors: DataFrame
    outbound_count: int
    inbound_count: int
    total_degree: int


def neighbors(spark: SparkSession, nodes: DataFrame | str, edges: DataFrame | str, edge_from_col, edge_to_col, node_id: Any, direction: str = "both", id_column: str | Sequence[str] = "id", soft_delete_column: str | None = None, sql_filter: str | None = None) -> NeighborsResult:
    """The nodes one edge away, with the numbers of edges out and in."""
    g = Graph.of(spark, nodes, edges, edge_from_col, edge_to_col, id_cols=id_column, soft_delete=soft_delete_column, sql_filter=sql_filter)
    me = g.typed_id(node_id)
    rows = g.edge_rows()
    sides = []
    if direction in ("outbound", "both"):
        sides.append(rows.where(F.col("src") == me).select(F.col("dst").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")))
    if direction in ("inbound", "both"):
        sides.append(rows.where(F.col("dst") == me).select(F.col("src").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    if not sides:
        raise ValueError("direction must be outbound, inbound or both")
    found = materialize((sides[0] if len(sides) == 1 else sides[0].union(sides[1])).groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")), out=F.sum("out"), into=F.sum("into"))
    return NeighborsResult(g.node_rows(found.df.select("node")), int(found.seen["out"] or 0), int(found.seen["into"] or 0), found.rows)


@dataclass
class ResilienceResult:
    """What falls apart when a node goes.

    parts: node (a neighbour of the removed node), part (the smallest node of what it now hangs on to) and part_size (how
    many neighbours that part has); two neighbours are cut off from each other if their parts differ. isolated_nodes and
    affected_nodes: node. pairs_cut is the number of pairs of neighbours cut off from each other.
    """

    node_removed: Any
    components_before: int
    components_after: int
    component_increase: int
    parts: DataFrame
    pairs_cut: int
    isolated_nodes: DataFrame
    affected_nodes: DataFrame
    affected_node_count: int
    is_critical: bool

    @property
    def disconnected_pairs(self) -> DataFrame:
        """(a, b), a < b, of all neighbours cut off from each other: as many rows as pairs_cut.

        Every pair has an end outside the largest part. So those nodes, in blocks of PAIR_BLOCK, meet all nodes where
        they lie: each node travels once a block, and pairs come out of the tasks that write them, without a shuffle.
        """
        n = self.parts.count()
        largest = self.parts.groupBy("part").count().orderBy(F.desc("count"), "part").limit(1).select(F.col("part").alias("most"))
        every = self.parts.select(F.col("node").alias("y"), F.col("part").alias("py")).join(F.broadcast(largest))
        every = every.select("y", "py", (F.col("py") == F.col("most")).alias("inside"))
        rest = every.where(~F.col("inside"))
        blocks = max(1, -(-rest.count() // PAIR_BLOCK))
        # Tasks of about PAIR_ROWS pairs, whatever the sizes in bytes say.
        tasks = min(n, MOST_TASKS, max(1, -(-n * min(n, PAIR_BLOCK) // PAIR_ROWS)))
        rest = rest.select(F.col("y").alias("x"), F.col("py").alias("px"), F.pmod(F.xxhash64("y"), F.lit(blocks)).cast("int").alias("block"))
        met = []
        spread = every.repartition(max(1, tasks), "y")
        for k in range(blocks):
            here = F.broadcast(rest.where(F.col("block") == k).select("x", "px"))
            # A node of the largest part meets each other node once; of two others, the pair comes out where x is the smaller.
            met.append(spread.join(here, (F.col("px") != F.col("py")) & (F.col("inside") | (F.col("x") < F.col("y")))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        return reduce(DataFrame.unionAll, met)


def resilience_analysis(spark: SparkSession, nodes: DataFrame | str | None, edges: DataFrame | str, edge_from_col, edge_to_col, node_to_remove: Any, id_column: str | Sequence[str] = "id", soft_delete_column: str | None = None, sql_filter: str | None = None) -> ResilienceResult:
    """What falls apart when a node goes: components before and after, the parts its neighbours fall into, neighbours left
    without any edge. A node that no edge touches raises ValueError. Critical: components increase or a node is left alone.

    Components are labelled once, without the node. Those that hold a neighbour were one component with it; all others
    are what they were.
    """
    g = Graph.of(spark, nodes, edges, edge_from_col, edge_to_col, id_cols=id_column, soft_delete=soft_delete_column, sql_filter=sql_filter)
    links = materialize(g.simple_edges().select("src", "dst")).df
    me = g.typed_id(node_to_remove)
    touching = links.where((F.col("src") == me) | (F.col("dst") == me))
    around = materialize(touching.select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node") != me).distinct())
    if around.rows == 0 and touching.limit(1).count() == 0:
        raise ValueError(f"node {node_to_remove} is not in the graph")
    labels = materialize(connected_labels(links.where((F.col("src") != me) & (F.col("dst") != me))))
    near = materialize(around.df.join(labels.df, "node", "left").select("node", F.coalesce("component", "node").alias("part"), F.col("component").isNull().alias("alone")))
    sizes = near.df.groupBy("part").agg(F.count(F.lit(1)).alias("part_size"))
    held = materialize(near.df.join(sizes, "part").select("node", "part", "part_size", "alone"), lonely=F.count_if("alone"), mates=F.sum("part_size"))
    others = labels.df.select("component").distinct().count()
    lonely, parts = int(held.seen["lonely"]), sizes.count()
    after = others + lonely
    before = after - parts + 1
    alone = held.df.where("alone").select("node")
    split = parts > 1
    # With two parts and more, every neighbour is apart from some other. Of n * n ordered pairs, the sum of part sizes are in one part.
    cut = (held.rows**2 - int(held.seen["mates"] or 0)) // 2
    return ResilienceResult(
        node_to_remove, before, after, after - before, held.df.select("node", "part", "part_size"), cut, alone, held.df.select("node") if split else alone, held.rows if split else lonely, after > before or lonely > 0
    )


__all__ = ["centrality", "connected_components", "graph_density", "neighbors", "resilience_analysis", "isolates", "key_literal", "pagerank", "scores_of", "components_of"]
