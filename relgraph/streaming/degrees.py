"""Degrees and windowed edge counts over a stream of edges."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgraph.sources.scratch import scratch_root


def streaming_degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """node, out_degree, in_degree over all edges so far, for output mode update or complete. Null ends are no edges."""
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(
        F.inline(F.array(F.struct(F.col(src).cast("string").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).cast("string").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    )
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def windowed_edges(edges: DataFrame, at: str, dst: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window start, dst and number of edges, final once the watermark has passed a window; later edges are dropped."""
    rows = edges.withWatermark(at, late).groupBy(F.window(at, width), F.col(dst)).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), dst, "n")


def run_available(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run a stream over all input that is there; the last row of each key, as a table in the shared folder.

    Every batch appends the rows that it changed, with its number, so that nothing is held on the driver and a batch that
    is written twice changes nothing.
    """
    spark = stream.sparkSession
    path = f"{scratch_root(spark)}/relgraph-stream-{uuid.uuid4().hex}"
    kind = T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])
    spark.createDataFrame([], kind).write.parquet(f"{path}/rows")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("__batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{path}/rows")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    others = [c for c in stream.columns if c not in keys]
    last = spark.read.schema(kind).parquet(f"{path}/rows").groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("__last"))
    return last.select(*keys, *[F.col("__last")[c].alias(c) for c in others])
