"""Ontologies: which tables are classes of things and which are relationships between them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from relgraph.plans import metamodel as M


@dataclass(frozen=True)
class ValidationError:
    """One problem: what kind of element, which one, which field of it, and what is wrong."""

    element_type: str
    element_name: str
    field: str
    message: str

    def __str__(self) -> str:
        return f"{self.element_type} {self.element_name}: {self.field}: {self.message}"


class OntologyValidationError(ValueError):
    """Carries every problem of an ontology."""

    def __init__(self, errors: Sequence[ValidationError]):
        self.errors = list(errors)
        super().__init__(f"{len(self.errors)} problems:\n" + "\n".join(f"- {e}" for e in self.errors))


def _value(raw: Any) -> Any:
    """A plain value of an annotation: wrapped values are unwrapped, lists and mappings in a string are read.

    Bracketed text is read as YAML flow syntax, which also takes JSON, so a list of bare words is a list.
    """
    if isinstance(raw, Mapping) and "value" in raw:
        raw = raw["value"]
    if isinstance(raw, str) and raw.strip()[:1] in ("[", "{"):
        import yaml

        try:
            return yaml.safe_load(raw)
        except yaml.YAMLError:
            return raw
    return raw


def _list(value: Any) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _bool(value: Any) -> bool:
    return value.strip().lower() == "true" if isinstance(value, str) else bool(value)


def snake_case(name: str) -> str:
    out = ""
    for i, c in enumerate(name):
        if c.isupper() and i and (not name[i - 1].isupper() or (i + 1 < len(name) and name[i + 1].islower())):
            out += "_"
        out += c.lower()
    return out


@dataclass(frozen=True)
class EntityClass:
    name: str
    description: str | None
    table: str | None
    primary_key: list[str]
    identifier: list[str]
    soft_delete_column: str | None
    row_count: int | None
    context: dict | None
    slots: dict


@dataclass(frozen=True)
class Relationship:
    name: str
    description: str | None
    edge_table: str | None
    domain_key: list[str]
    range_key: list[str]
    domain_classes: list[str]
    range_classes: list[str]
    operation_types: list[str]
    temporal_bounds: dict | None
    axioms: dict[str, bool]
    inverse_of: str | None
    cardinality_domain: str
    cardinality_range: str
    row_count: int | None
    context: dict | None
    sql_filter: str | None
    weight_columns: list[dict]
    edge_attributes: list[dict]
    type_discriminator: dict | None


class Ontology:
    """Classes and roles read from a mapping in the annotation vocabulary of metamodel; roles also go by snake_case names."""

    def __init__(self, raw: Mapping, validate: bool = True):
        self.raw = dict(raw)
        self._notes: dict[str, dict] = {}
        self.entities: dict[str, EntityClass] = {}
        self.relationships: dict[str, Relationship] = {}
        self._alias: dict[str, str] = {}
        for name, body in (self.raw.get("classes") or {}).items():
            body = body or {}
            kinds = {k.rpartition(":")[2] for k in _list(body.get("instantiates"))}
            notes = {k.removeprefix(M.PREFIX): _value(v) for k, v in (body.get("annotations") or {}).items()}
            if M.ENTITY in kinds:
                self._notes[name] = notes
                self.entities[name] = self._entity(name, body, notes)
            elif M.RELATIONSHIP in kinds:
                self._notes[name] = notes
                self.relationships[name] = self._relationship(name, body, notes)
                self._alias[snake_case(name)] = name
        if validate and (errors := self.validate()):
            raise OntologyValidationError(errors)

    @staticmethod
    def _entity(name: str, body: Mapping, n: Mapping) -> EntityClass:
        count = n.get("row_count")
        return EntityClass(
            name, body.get("description"), n.get("table"), _list(n.get("primary_key")), _list(n.get("identifier")), n.get("soft_delete_column") or None,
            int(count) if count is not None else None, n.get("context"), dict(body.get("attributes") or {}),
        )

    @staticmethod
    def _relationship(name: str, body: Mapping, n: Mapping) -> Relationship:
        count = n.get("row_count")
        return Relationship(
            name, body.get("description"), n.get("edge_table"), _list(n.get("domain_key")), _list(n.get("range_key")), _list(n.get("domain_class")), _list(n.get("range_class")),
            _list(n.get("operation_types")), n.get("temporal_bounds"), {a: _bool(n.get(a, False)) for a in M.AXIOMS}, n.get("inverse_of"),
            str(n.get("cardinality_domain", "0..*")), str(n.get("cardinality_range", "0..*")), int(count) if count is not None else None, n.get("context"), n.get("sql_filter"),
            _list(n.get("weight_columns")), _list(n.get("edge_attributes")), n.get("type_discriminator"),
        )

    # Loading and validation ---------------------------------------------------------------------------------------

    @classmethod
    def from_text(cls, text: str, validate: bool = True) -> Ontology:
        import yaml

        return cls(yaml.safe_load(text) or {}, validate)

    @classmethod
    def from_file(cls, path: str, validate: bool = True) -> Ontology:
        with open(path, encoding="utf-8") as f:
            return cls.from_text(f.read(), validate)

    def validate(self) -> list[ValidationError]:
        """Every problem, entities first."""
        out = [ValidationError("entity", n, f, "required annotation is missing") for n in self.entities for f in M.ENTITY_REQUIRED if self._notes[n].get(f) in (None, "", [])]
        for name, r in self.relationships.items():
            notes = self._notes[name]

            def bad(field: str, message: str, name: str = name) -> None:
                out.append(ValidationError("relationship", name, field, message))

            for f in M.RELATIONSHIP_REQUIRED:
                if notes.get(f) in (None, "", []):
                    bad(f, "required annotation is missing")
            for op in r.operation_types:
                if op not in M.OPERATION_TYPES:
                    bad("operation_types", f"unknown operation type {op!r}")
            if r.temporal_bounds is not None:
                bounds = r.temporal_bounds if isinstance(r.temporal_bounds, Mapping) else {}
                for f in ("start_col", "end_col"):
                    if not bounds.get(f):
                        bad("temporal_bounds", f"{f} is missing")
            for f, classes in (("domain_class", r.domain_classes), ("range_class", r.range_classes)):
                for c in classes:
                    if c not in self.entities:
                        bad(f, f"unknown class {c!r}")
            if r.type_discriminator is not None:
                d = r.type_discriminator if isinstance(r.type_discriminator, Mapping) else {}
                if not d.get("column"):
                    bad("type_discriminator", "column is missing")
                targets = self._targets(d)
                if not targets:
                    bad("type_discriminator", "mapping is missing")
                for t in targets.values():
                    if t not in r.range_classes:
                        bad("type_discriminator", f"{t!r} is not among the range classes")
            if r.sql_filter:
                for text in M.FORBIDDEN_IN_FILTER:
                    if text in r.sql_filter.lower():
                        bad("sql_filter", f"holds {text!r}")
        return out

    @staticmethod
    def _targets(discriminator: Mapping) -> dict[str, str]:
        mapping = discriminator.get("mapping") or {}
        return {str(k): (v.get("target_class") if isinstance(v, Mapping) else v) for k, v in mapping.items()}

    # Getters ------------------------------------------------------------------------------------------------------

    def entity(self, name: str) -> EntityClass:
        if name not in self.entities:
            raise KeyError(f"unknown class {name!r}")
        return self.entities[name]

    def role(self, name: str) -> Relationship:
        name = self._alias.get(name, name)
        if name not in self.relationships:
            raise KeyError(f"unknown role {name!r}")
        return self.relationships[name]

    def get_class_table(self, name: str) -> str | None:
        return self.entity(name).table

    def get_class_pk(self, name: str) -> list[str]:
        return self.entity(name).primary_key

    def get_class_identifier(self, name: str) -> list[str]:
        return self.entity(name).identifier

    def get_class_soft_delete(self, name: str) -> tuple[bool, str | None]:
        c = self.entity(name).soft_delete_column
        return c is not None, c

    def get_class_slots(self, name: str) -> dict:
        return self.entity(name).slots

    def get_class_row_count(self, name: str) -> int | None:
        return self.entity(name).row_count

    def get_class_context(self, name: str) -> dict | None:
        return self.entity(name).context

    def get_role_table(self, name: str) -> str | None:
        return self.role(name).edge_table

    def get_role_keys(self, name: str) -> tuple[list[str], list[str]]:
        r = self.role(name)
        return r.domain_key, r.range_key

    def get_role_sql(self, name: str) -> dict:
        r = self.role(name)
        return {"table": r.edge_table, "domain_key": r.domain_key, "range_key": r.range_key, "domain_class": r.domain_classes, "range_class": r.range_classes}

    def get_role_domain(self, name: str) -> str | None:
        return next(iter(self.role(name).domain_classes), None)

    def get_role_range(self, name: str) -> str | None:
        return next(iter(self.role(name).range_classes), None)

    def get_operation_types(self, name: str) -> list[str]:
        return self.role(name).operation_types

    def get_operation_categories(self, name: str) -> list[str]:
        """Categories of a role's operations, in order of first mention; unknown types count as direct."""
        return list(dict.fromkeys(M.OPERATION_TYPES.get(t, "direct") for t in self.role(name).operation_types))

    def get_temporal_bounds(self, name: str) -> tuple[str, str] | None:
        b = self.role(name).temporal_bounds
        return (b["start_col"], b["end_col"]) if b else None

    def get_role_filter(self, name: str) -> str | None:
        return self.role(name).sql_filter

    def get_role_properties(self, name: str) -> dict[str, bool]:
        return self.role(name).axioms

    def get_role_inverse(self, name: str) -> str | None:
        return self.role(name).inverse_of

    def get_role_cardinality(self, name: str) -> tuple[str, str]:
        r = self.role(name)
        return r.cardinality_domain, r.cardinality_range

    def get_role_weights(self, name: str) -> list[dict]:
        return self.role(name).weight_columns

    def get_role_edge_attributes(self, name: str) -> list[dict]:
        return self.role(name).edge_attributes

    def get_role_context(self, name: str) -> dict | None:
        return self.role(name).context

    def get_role_discriminator(self, name: str) -> tuple[str, dict[str, str]] | None:
        d = self.role(name).type_discriminator
        return (d["column"], self._targets(d)) if d else None

    def is_polymorphic(self, name: str) -> bool:
        return len(self.role(name).range_classes) > 1 or self.role(name).type_discriminator is not None

    def has_composite_key(self, name: str) -> bool:
        return len(self.entity(name).primary_key) > 1

    @property
    def name(self) -> str | None:
        return self.raw.get("name")

    @property
    def version(self) -> str | None:
        return self.raw.get("version")

    @property
    def database(self) -> dict | None:
        note = (self.raw.get("annotations") or {}).get(M.PREFIX + "database")
        return _value(note)

    # Listings -----------------------------------------------------------------------------------------------------

    def classes_table(self, spark: SparkSession) -> DataFrame:
        rows = [(e.name, e.table, e.primary_key, e.identifier, e.soft_delete_column, e.row_count, e.description) for e in self.entities.values()]
        return spark.createDataFrame(rows, "name string, table_name string, primary_key array<string>, identifier array<string>, soft_delete_column string, row_count long, description string")

    def roles_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (r.name, r.edge_table, r.domain_key, r.range_key, r.domain_classes, r.range_classes, r.operation_types, [a for a, on in r.axioms.items() if on], r.inverse_of, r.sql_filter, r.row_count, json.dumps(r.temporal_bounds))
            for r in self.relationships.values()
        ]
        schema = "name string, edge_table string, domain_key array<string>, range_key array<string>, domain_class array<string>, range_class array<string>, operation_types array<string>, axioms array<string>, inverse_of string, sql_filter string, row_count long, temporal_bounds string"
        return spark.createDataFrame(rows, schema)


def load_ontology(path: str, validate: bool = True) -> Ontology:
    return Ontology.from_file(path, validate)
