"""Searches from many roots in tasks that each hold the whole graph as arrays: only counts come out, no pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.sources.scratch import materialize

#: Roots that are searched together, a bit each, and edges that are gathered together.
ROOTS, PORTION = 1_024, 100_000


class Placed:
    """Edges between places: nodes (node, place from 0 on, in order of nodes), rows of edges (s, d and w if weighted)."""

    def __init__(self, links: DataFrame):
        nodes = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        # One task sorts the nodes; the tasks that search hold arrays of as many places for each root anyway.
        self.nodes = materialize(nodes.select("node", (F.row_number().over(Window.orderBy("node")) - 1).cast("int").alias("place")))
        s = self.nodes.df.select(F.col("node").alias("src"), F.col("place").alias("s"))
        d = self.nodes.df.select(F.col("node").alias("dst"), F.col("place").alias("d"))
        self.weighted = "w" in links.columns
        self.edges = materialize(links.join(s, "src").join(d, "dst").select("s", "d", *(["w"] if self.weighted else [])))

    def in_tasks(self, run: Callable, schema: str) -> DataFrame:
        """run(n, task, tasks, s, d, w) in every task, with all edges as arrays; it yields record batches.

        There is a task a core, or one for 16 nodes if that is fewer. Each gets its copy of the edges by a shuffle, so
        nothing goes by way of the driver; many edges make a row there, each place in as few bytes as the largest takes.
        """
        spark, n, weighted = self.edges.df.sparkSession, self.nodes.rows, self.weighted
        tasks = max(1, min(spark.sparkContext.defaultParallelism, n // 16))

        kinds = {"s": np.min_scalar_type(n), "d": np.min_scalar_type(n)} | ({"w": np.dtype(float)} if weighted else {})

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict({c: [b[c].to_numpy().astype(kind).tobytes()] for c, kind in kinds.items()})

        def unpacked(held: list[pa.RecordBatch]) -> list[np.ndarray | None]:
            out = [np.concatenate([np.frombuffer(x.as_buffer(), kind) for b in held for x in b[c]], dtype=float if c == "w" else np.int32) for c, kind in kinds.items()]
            held.clear()
            return out if weighted else [*out, None]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                yield from run(n, held[0]["copy"][0].as_py(), tasks, *unpacked(held))

        packed = self.edges.df.mapInArrow(pack, ", ".join(f"{c} binary" for c in kinds))
        copies = packed.join(F.broadcast(spark.range(tasks).select(F.col("id").cast("int").alias("copy"))))
        return copies.repartitionById(tasks, "copy").mapInArrow(work, schema)


def _levels(n: int, roots: np.ndarray, s: np.ndarray, first: np.ndarray, ends: np.ndarray, max_depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """(depth, bits) of the breadth-first levels of up to ROOTS roots, a bit a root in the row of each place.

    Edges are sorted by their ends; those from s[first[k]] on enter ends[k].
    """
    words = -(-len(roots) // 64)
    new = np.zeros((n, words), dtype=np.uint64)
    at = np.arange(len(roots))
    new[roots, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    seen = new.copy()
    last = np.r_[first[1:], len(s)]
    depth = 0
    while depth < max_depth and len(ends):
        depth += 1
        met = np.zeros_like(new)
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(last, first[lo] + PORTION, side="right")))
            met[ends[lo:hi]] = np.bitwise_or.reduceat(new[s[first[lo] : last[hi - 1]]], first[lo:hi] - first[lo], axis=0)
            lo = hi
        new = met & ~seen
        if not new.any():
            return
        seen |= new
        yield depth, new


def reach_counts(links: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """How many nodes each node reaches, and by how many it is reached, at each depth from 1 on, over edges (src, dst).

    Two tables: (root, depth, n) and (node, depth, n); nodes that reach none, or that none reaches, have no row. A node
    is met once a root, at its least depth. The searches run in tasks that hold all edges, ROOTS roots at a time as bits,
    so the pairs of nodes are counted and never written.
    """
    placed = Placed(links.select("src", "dst").distinct())

    def run(n: int, task: int, tasks: int, s: np.ndarray, d: np.ndarray, _) -> Iterator[pa.RecordBatch]:
        order = np.argsort(d, kind="stable")
        s = s[order]
        ends, first = np.unique(d[order], return_index=True)
        mine = np.arange(task, n, tasks)
        met: dict[int, np.ndarray] = {}
        for lo in range(0, len(mine), ROOTS):
            roots = mine[lo : lo + ROOTS]
            for depth, new in _levels(n, roots, s, first, ends, max_depth):
                per_root = np.zeros(new.shape[1] * 64, dtype=np.int64)
                for k in range(0, n, 8_192):
                    per_root += np.unpackbits(new[k : k + 8_192].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                per_root = per_root[: len(roots)]
                yield _rows(True, roots, depth, per_root)
                met[depth] = met.get(depth, 0) + np.bitwise_count(new).sum(axis=1, dtype=np.int64)
        for depth, per_node in met.items():
            yield _rows(False, np.arange(n), depth, per_node)

    found = materialize(placed.in_tasks(run, "is_root boolean, place int, depth int, n long")).df
    named = found.join(placed.nodes.df, "place")
    per_root = named.where("is_root").select(F.col("node").alias("root"), "depth", "n")
    return per_root, named.where(~F.col("is_root")).groupBy("node", "depth").agg(F.sum("n").alias("n"))


def _rows(is_root: bool, places: np.ndarray, depth: int, n: np.ndarray) -> pa.RecordBatch:
    kept = np.flatnonzero(n)
    arrays = [pa.array(np.full(len(kept), is_root)), pa.array(places[kept].astype(np.int32)), pa.array(np.full(len(kept), depth, dtype=np.int32)), pa.array(n[kept])]
    return pa.RecordBatch.from_arrays(arrays, names=["is_root", "place", "depth", "n"])
