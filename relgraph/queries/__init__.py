"""Registry of named queries and their SQL."""

from relgraph.queries import catalogue, graph, ontology, problems

MODULES = [problems, graph, ontology, catalogue]


def registry() -> tuple[dict, dict]:
    """(name -> callable(spark, folder), name -> SQL)."""
    queries: dict = {}
    oracle: dict = {}
    for m in MODULES:
        queries.update(m.QUERIES)
        oracle.update(m.ORACLE)
    return queries, oracle
