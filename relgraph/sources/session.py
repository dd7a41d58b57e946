"""Sessions and tables from elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def connect(app: str = "relgraph", **config: str) -> SparkSession:
    """The running session, or a new one with adaptive execution and UTC times; config keys use _ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in config.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def register(spark: SparkSession, folder: str, names: list[str], kind: str = "parquet") -> None:
    """Views over the files folder/name.kind, so that operators can be called with table names."""
    for n in names:
        spark.read.format(kind).load(f"{folder}/{n}.{kind}").createOrReplaceTempView(n)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A table over JDBC, read in ``parts`` ranges of a numeric key; the driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and parts > 1:
        ends = spark.read.format("jdbc").options(url=url, query=f"SELECT min({key}) AS lo, max({key}) AS hi FROM {table}", **options).load().first()
        reader = reader.options(partitionColumn=key, lowerBound=ends["lo"] or 0, upperBound=ends["hi"] or 0, numPartitions=parts)
    return reader.load()


def catalogue(spark: SparkSession) -> DataFrame:
    """table_name, column_name, data_type, nullable of every table and view of the session."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")
