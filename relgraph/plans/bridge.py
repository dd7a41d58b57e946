"""From a role of an ontology to a graph operator, with every argument filled in."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relgraph.operators import aggregate, network, paths, traverse
from relgraph.operators.model import Graph
from relgraph.plans.ontology import Ontology


class RoleGraph:
    """Graphs over tables that an ontology names. ``read`` gives the DataFrame of a table name; views by default."""

    def __init__(self, spark: SparkSession, ontology: Ontology, read: Callable[[str], DataFrame] | None = None):
        self.spark, self.ontology = spark, ontology
        self.read = read or spark.table

    def ends(self, role: str) -> tuple[DataFrame, list[str], list[str]]:
        """(edge rows, domain id columns, range id columns) of a role.

        Where the edge table is the domain class's own table, its key identifies the domain and the foreign key the
        range; where it is the range class's own, the other way round; else both foreign keys lie in a junction table.
        In the first two cases the one foreign key may be named under either key.
        """
        r = self.ontology.role(role)
        df = self.read(r.edge_table)
        own = lambda cls: self.ontology.entity(cls)
        domain, range_ = r.domain_classes[0], r.range_classes[0]
        if own(domain).table == r.edge_table and own(range_).table != r.edge_table:
            pk = own(domain).primary_key
            a, b = pk, next((k for k in (r.range_key, r.domain_key) if set(k) != set(pk)), r.range_key)
        elif own(range_).table == r.edge_table and own(domain).table != r.edge_table:
            pk = own(range_).primary_key
            a, b = next((k for k in (r.domain_key, r.range_key) if set(k) != set(pk)), r.domain_key), pk
        else:
            a, b = r.domain_key, r.range_key
        missing = [c for c in (*a, *b) if c not in df.columns]
        if missing:
            raise ValueError(f"role {r.name}: {r.edge_table} has no column {', '.join(missing)}")
        return df, a, b

    def graph(self, role: str, weight: str | None = None, valid_at: Any = None, side: str = "range") -> Graph:
        """The role as a Graph, its filter, validity and soft deletion included; side: whose node table goes with it.

        A polymorphic role's node table is the union of its classes' ids; its rows then hold the ids and their class.
        """
        o, r = self.ontology, self.ontology.role(role)
        df, a, b = self.ends(role)
        classes = r.range_classes if side == "range" else r.domain_classes
        if len(classes) == 1:
            e = o.entity(classes[0])
            nodes, ids, deleted = self.read(e.table), e.primary_key, e.soft_delete_column
        else:
            per = []
            for c in classes:
                e = o.entity(c)
                rows = self.read(e.table)
                rows = rows.where(F.col(e.soft_delete_column).isNull()) if e.soft_delete_column else rows
                per.append(rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(e.primary_key)], F.lit(c).alias("class")))
            nodes, ids, deleted = reduce(DataFrame.unionByName, per), [f"k{i}" for i in range(len(o.entity(classes[0]).primary_key))], None
        bounds = o.get_temporal_bounds(role) or (None, None)
        return Graph(self.spark, nodes, df, a if len(a) > 1 else a[0], b if len(b) > 1 else b[0], ids if len(ids) > 1 else ids[0], weight, r.sql_filter, deleted, bounds[0], bounds[1], valid_at)

    def typed_targets(self, role: str) -> DataFrame:
        """Edge rows of a polymorphic role with the class of their target in target_class."""
        found = self.ontology.get_role_discriminator(role)
        df, _, _ = self.ends(role)
        if found is None:
            return df.withColumn("target_class", F.lit(self.ontology.get_role_range(role)))
        column, mapping = found
        pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return df.withColumn("target_class", F.try_element_at(pairs, F.col(column).cast("string")))

    def traverse(self, role: str, start: Any, direction: str = "outbound", valid_at: Any = None, **options) -> traverse.TraverseResult:
        return traverse.traverse_graph(self.graph(role, valid_at=valid_at), start, direction, **options)

    def path_aggregate(self, role: str, start: Any, value_col: str, operation: str = "sum", **options) -> DataFrame:
        return aggregate.aggregate_paths(self.graph(role), start, value_col, operation, **options)

    def distances(self, role: str, start: Any, weight: str | None = None, **options) -> DataFrame:
        weights = self.ontology.get_role_weights(role)
        return paths.path_distances(self.graph(role, weight or (weights[0]["name"] if weights else None)), start, **options)

    def centrality(self, role: str, kind: str = "degree", weight: str | None = None) -> DataFrame:
        return network.scores_of(self.graph(role, weight), kind)

    def components(self, role: str, min_size: int = 1) -> DataFrame:
        return network.components_of(self.graph(role), min_size)

    def handler_for(self, role: str) -> list[str]:
        """Names of the operators that a role's operation types ask for."""
        by_type = {
            "direct_join": "join", "recursive_traversal": "traverse", "temporal_traversal": "traverse", "path_aggregation": "path_aggregate", "hierarchical_aggregation": "path_aggregate",
            "shortest_path": "shortest_path", "centrality": "centrality", "connected_components": "connected_components", "resilience_analysis": "resilience_analysis",
        }
        return list(dict.fromkeys(by_type.get(t, "join") for t in self.ontology.get_operation_types(role)))
