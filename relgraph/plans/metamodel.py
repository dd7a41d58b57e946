"""What an ontology may say about classes and roles. Fixed values, as the annotation vocabulary defines them."""

from __future__ import annotations

PREFIX = "vg:"
ENTITY, RELATIONSHIP = "SQLMappedClass", "SQLMappedRelationship"

ENTITY_REQUIRED = ("table", "primary_key")
RELATIONSHIP_REQUIRED = ("edge_table", "domain_key", "range_key", "domain_class", "range_class")

#: Operation type -> category.
OPERATION_TYPES = {
    "direct_join": "direct",
    "recursive_traversal": "traversal",
    "temporal_traversal": "temporal",
    "path_aggregation": "aggregation",
    "hierarchical_aggregation": "aggregation",
    "shortest_path": "algorithm",
    "centrality": "algorithm",
    "connected_components": "algorithm",
    "resilience_analysis": "algorithm",
}
CATEGORIES = ("direct", "traversal", "temporal", "aggregation", "algorithm", "pattern")
CARDINALITIES = ("0..1", "1..1", "0..*", "1..*")
AXIOMS = ("transitive", "symmetric", "asymmetric", "reflexive", "irreflexive", "functional", "inverse_functional", "acyclic", "is_hierarchical", "is_weighted")
#: Text that no edge filter may hold.
FORBIDDEN_IN_FILTER = ("--", ";", "/*", "*/", "xp_", "exec ", "execute ")
