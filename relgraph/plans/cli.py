"""python -m relgraph.plans.cli show|validate FILE: list an ontology, or every problem of it."""

from __future__ import annotations

import json
import sys

from relgraph.plans.ontology import load_ontology


def listing(path: str) -> dict:
    """Classes and roles with what maps them to tables."""
    o = load_ontology(path, validate=False)
    return {
        "name": o.name,
        "version": o.version,
        "database": o.database,
        "classes": {e.name: {"table": e.table, "primary_key": e.primary_key, "soft_delete_column": e.soft_delete_column, "row_count": e.row_count} for e in o.entities.values()},
        "roles": {n: o.get_role_sql(n) | {"operations": o.get_operation_types(n), "axioms": [a for a, on in o.get_role_properties(n).items() if on]} for n in o.relationships},
    }


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in ("show", "validate"):
        print(__doc__)
        return 2
    if args[0] == "show":
        print(json.dumps(listing(args[1]), indent=2, default=str))
        return 0
    problems = load_ontology(args[1], validate=False).validate()
    for p in problems:
        print(p)
    print(f"{len(problems)} problems")
    return int(bool(problems))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
