"""Parent-child links to full hierarchies: cycles, depth, paths, roots and everything below."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.operators.components import LOCAL_EDGES, TASK_EDGES, strong_groups
from relgraph.operators.model import ANY_DEPTH
from relgraph.operators.traverse import search
from relgraph.sources.scratch import materialize, shuffles_of

#: Lengths of ways that one job counts.
LENGTHS = 4


class Hierarchy:
    """The structure of parent-child rows of unknown depth, with shared children and cycles.

    A link with a null end is left out; repeated links count once; a node that is its own parent is a cycle. Nodes are
    the ends of links. Nodes that lie below each other form a group and take one place in the structure, so depth,
    paths and roots are defined although there are cycles. No rows give empty results. Other columns are ignored.

    Cycles are found component by component with a coloured depth-first search (components.strong_groups). Since shared
    children tie almost all parts of a real catalogue into one weak component, which no task could hold, the peeled rest
    is what is split into components, and depth, paths and closure run as joins over all components: searches that enter
    each place once a root, and counts of ways by length, several lengths a job.
    """

    def __init__(self, links: DataFrame, parent: str, child: str, local_edges: int = LOCAL_EDGES):
        edges = links.select(F.col(parent).cast("long").alias("src"), F.col(child).cast("long").alias("dst"))
        held = materialize(edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct())
        self.spark, self.edges, self._edge_rows = links.sparkSession, held.df, held.rows
        groups, back = strong_groups(self.edges, local_edges)
        self.groups, self.back_edges = groups, back
        self._places: DataFrame | None = None

    def cycles(self) -> DataFrame:
        """cycle_id (smallest node of the group), node."""
        return self.groups.select(F.col("component").alias("cycle_id"), "node")

    def _condense(self) -> tuple[DataFrame, DataFrame]:
        """(node, place) of every node, and the links (src, dst, more) between places, an acyclic graph."""
        if self._places is None:
            nodes = self.edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
            places = nodes.join(self.groups, "node", "left").select("node", F.coalesce("component", "node").alias("place"))
            self._places = materialize(places).df
            p = self._places
            links = (
                self.edges.join(p.select(F.col("node").alias("src"), F.col("place").alias("a")), "src")
                .join(p.select(F.col("node").alias("dst"), F.col("place").alias("b")), "dst")
                .where(F.col("a") != F.col("b"))
                .select(F.col("a").alias("src"), F.col("b").alias("dst"))
                .distinct()
            )
            # Whether a link leads on: rows that end at the bottom are written, but not joined again.
            links = materialize(links).df
            on = links.select(F.col("src").alias("dst"), F.lit(True).alias("on")).distinct()
            self._links = materialize(links.join(on, "dst", "left").select("src", "dst", F.coalesce("on", F.lit(False)).alias("more"))).df
        return self._places, self._links

    def _partitions(self) -> int:
        """Partitions of the links: so many that a task takes TASK_EDGES of them."""
        return max(self._edge_rows // TASK_EDGES, 8)

    def _roots(self) -> DataFrame:
        places, links = self._condense()
        return places.select("place").distinct().join(links.select(F.col("dst").alias("place")), "place", "left_anti")

    def _shortest(self) -> DataFrame:
        """place, depth, path: the least of the shortest ways from the roots; every place is entered once."""
        _, links = self._condense()
        level = materialize(self._roots().select("place", F.lit(0).alias("depth"), F.array("place").alias("path"), F.lit(True).alias("more")))
        levels = [level]
        while level.rows:
            met = level.df.where("more").drop("more").join(links, F.col("place") == F.col("src")).groupBy(F.col("dst").alias("place"), "more").agg(F.min("path").alias("path"))
            seen = reduce(DataFrame.unionAll, [x.df.select("place") for x in levels])
            new = met.join(seen, "place", "left_anti").select("place", F.lit(len(levels)).alias("depth"), F.array_append("path", F.col("place")).alias("path"), "more")
            level = materialize(new)
            levels.append(level)
        return reduce(DataFrame.unionAll, [x.df for x in levels]).drop("more")

    def _ways(self) -> DataFrame:
        """place, max_depth, n_paths: the numbers of ways of each length add up. Several lengths make one job."""
        _, links = self._condense()
        held = links.repartition(self._partitions(), "src").persist()  # recomputed from its table where an executor is lost
        level = materialize(self._roots().select("place", F.lit(0).alias("length"), F.lit(1).cast("decimal(38,0)").alias("n"), F.lit(True).alias("more")))
        levels, last = [level], 0
        while True:
            cur, steps = levels[-1].df.where((F.col("length") == last) & F.col("more")), []
            for k in range(last + 1, last + 1 + LENGTHS):
                met = cur.where("more").select("place", "n").join(held, F.col("place") == F.col("src"))
                cur = met.groupBy(F.col("dst").alias("place"), "more").agg(F.sum("n").cast("decimal(38,0)").alias("n")).select("place", F.lit(k).alias("length"), "n", "more")
                steps.append(cur)
            last += LENGTHS
            levels.append(materialize(reduce(DataFrame.unionAll, steps), ends=F.count_if((F.col("length") == last) & F.col("more"))))
            if not levels[-1].seen["ends"]:
                break
        per = materialize(reduce(DataFrame.unionAll, [x.df for x in levels]).groupBy("place").agg(F.max("length").alias("max_depth"), F.sum("n").cast("decimal(38,0)").alias("n_paths")))
        held.unpersist()
        for x in levels:
            x.drop()
        return per.df

    def nodes(self) -> DataFrame:
        """One row per node: node, in_cycle, depth, max_depth, n_paths, root, path.

        depth and max_depth: least and greatest number of links between places from a root; n_paths: number of ways from
        roots through places (decimal); path: the least of the shortest ways, as place ids from root to node, members of
        a cycle standing under the cycle's id; root: its first element.
        """
        places, _ = self._condense()
        with shuffles_of(self.spark, self._partitions()):
            ways, shortest = self._ways(), self._shortest()
        looped = self.groups.select("node", F.lit(True).alias("looped"))
        return places.join(shortest.join(ways, "place"), "place").join(looped, "node", "left").select(
            "node", F.coalesce("looped", F.lit(False)).alias("in_cycle"), "depth", "max_depth", "n_paths", F.col("path")[0].alias("root"), "path"
        )

    def _walked(self, starts: DataFrame):
        """Tables of the places at the ends of walks of 0, 1, 2, ... links from starts (place and, if wanted, root), each
        place once a length. Places make no cycle, so walks come to an end; one small job a length, and no table of one
        length rests on another's."""
        _, links = self._condense()
        keys = [c for c in starts.columns if c != "place"]
        with shuffles_of(self.spark, self._partitions()):
            level = materialize(starts.select(*keys, "place", F.lit(True).alias("more")).distinct())
            while level.rows:
                yield level
                met = level.df.where("more").drop("more").join(links, F.col("place") == F.col("src"))
                level = materialize(met.select(*keys, F.col("dst").alias("place"), links["more"]).distinct())

    def longest(self) -> DataFrame:
        """One row: longest, the number of links on the longest way between places; null without links."""
        length = None
        for length, level in enumerate(self._walked(self._roots())):
            if length:
                before.drop()
            before = level
        return self.spark.range(1).select(F.lit(length).cast("int").alias("longest"))

    def spans(self) -> DataFrame:
        """root, deepest, n: for every root the number of links on its longest way and the number of nodes it reaches,
        itself included. A node below several roots counts for each."""
        places, _ = self._condense()
        levels = [x.df.select("root", "place", F.lit(k).alias("length")) for k, x in enumerate(self._walked(self._roots().select(F.col("place").alias("root"), "place")))]
        if not levels:
            return self.edges.select(F.col("src").alias("root"), F.lit(0).alias("deepest"), F.lit(0).cast("long").alias("n")).limit(0)
        per_place = reduce(DataFrame.unionAll, levels).groupBy("root", "place").agg(F.max("length").alias("length"))
        sizes = places.groupBy("place").agg(F.count(F.lit(1)).alias("size"))
        return per_place.join(sizes, "place").groupBy("root").agg(F.max("length").alias("deepest"), F.sum("size").alias("n"))

    def _reached(self, starts: DataFrame) -> DataFrame:
        """(root, node) of all places that each root (root, node) reaches, itself included; every pair is met once."""
        _, links = self._condense()
        with shuffles_of(self.spark, self._partitions()):
            return search(links.select("src", "dst"), starts, ANY_DEPTH, None, False).df.select("root", "node")

    def below(self) -> DataFrame:
        """All pairs (node, below) where below can be reached from node over one or more links; itself, in a cycle."""
        places, links = self._condense()
        found = self._reached(links.select(F.col("src").alias("root"), F.col("src").alias("node")).distinct()).where(F.col("root") != F.col("node"))
        pairs = found.select(F.col("root").alias("above"), F.col("node").alias("below")).union(self.groups.select("component", "component").distinct())
        a = places.select(F.col("place").alias("above"), "node")
        b = places.select(F.col("place").alias("below"), F.col("node").alias("below_node"))
        return pairs.join(a, "above").join(b, "below").select("node", F.col("below_node").alias("below"))

    def roots(self) -> DataFrame:
        """All pairs (node, root): root is the place of a node that no other place leads to; a root is its own."""
        places, _ = self._condense()
        found = self._reached(self._roots().select(F.col("place").alias("root"), F.col("place").alias("node")))
        return found.select("root", F.col("node").alias("place")).join(places, "place").select("node", "root")
