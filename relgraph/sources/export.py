"""Write what an ontology describes as one table of nodes and one of relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgraph.plans.bridge import RoleGraph


def _plain(df: DataFrame, column: str) -> Column:
    """A value as a property graph takes it: decimals as doubles, dates and times as text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        return F.col(column).cast("double").alias(column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(column).cast("string").alias(column)
    return F.col(column)


def _properties(df: DataFrame, columns: list[str]) -> Column:
    return F.to_json(F.struct(*[_plain(df, c) for c in columns])).alias("properties") if columns else F.lit("{}").alias("properties")


def _id(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def vertices(rg: RoleGraph) -> DataFrame:
    """label, id, properties (JSON) of every live row of every class; composite ids are joined with |."""
    per = []
    for e in rg.ontology.entities.values():
        df = rg.read(e.table)
        if e.soft_delete_column:
            df = df.where(F.col(e.soft_delete_column).isNull())
        per.append(df.select(F.lit(e.name).alias("label"), _id(e.primary_key).alias("id"), _properties(df, df.columns)))
    return reduce(DataFrame.unionByName, per)


def relationships(rg: RoleGraph) -> DataFrame:
    """type, src, dst, properties (JSON) of every edge of every role whose ends are not null and not deleted."""
    per = []
    for r in rg.ontology.relationships.values():
        df, a, b = rg.ends(r.name)
        if r.sql_filter:
            df = df.alias("e").where(F.expr(r.sql_filter))
        for c in (*a, *b):
            df = df.where(F.col(c).isNotNull())
        for cls, cols in ((r.domain_classes, a), (r.range_classes, b)):
            e = rg.ontology.entity(cls[0])
            if len(cls) == 1 and e.soft_delete_column:
                live = rg.read(e.table).where(F.col(e.soft_delete_column).isNull())
                df = df.withColumn("__end", _id(cols)).join(live.select(_id(e.primary_key).alias("__end")), "__end", "left_semi").drop("__end")
        shown = [w["name"] for w in r.weight_columns] + [x["name"] for x in r.edge_attributes]
        shown = [c for c in dict.fromkeys(shown) if c in df.columns]
        per.append(df.select(F.lit(r.name).alias("type"), _id(a).alias("src"), _id(b).alias("dst"), _properties(df, shown)))
    return reduce(DataFrame.unionByName, per)


def materialize_graph(rg: RoleGraph, path: str) -> None:
    """Parquet under path/vertices and path/relationships, partitioned by label and type."""
    vertices(rg).write.mode("overwrite").partitionBy("label").parquet(f"{path}/vertices")
    relationships(rg).write.mode("overwrite").partitionBy("type").parquet(f"{path}/relationships")
