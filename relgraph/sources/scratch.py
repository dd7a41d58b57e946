"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``.

Iterative operators cut their lineage here instead of holding blocks on executors, so a lost executor costs only the
tasks it was running.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session. Only a local master, as in tests, may fall back on a temporary folder."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="relgraph-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


class Scratch:
    """A written DataFrame: ``df`` reads it, ``rows`` is its row count, ``seen`` what else was observed, ``drop`` deletes it."""

    def __init__(self, spark: SparkSession, df: DataFrame, path: str, seen: dict):
        self.spark, self.df, self.path, self.rows, self.seen = spark, df, path, int(seen["n"]), seen

    def drop(self) -> None:
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


_cleaned: set[str] = set()
_scopes: list[list[Scratch]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Intermediate tables made inside are deleted at its end, so that the disk of a long-lived driver does not fill.

    Results that rest on them must be written or collected inside.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for x in _scopes.pop():
            x.drop()


def _folder(spark: SparkSession) -> str:
    """This application's own folder under the shared one; deleted when the driver ends."""
    path = f"{scratch_root(spark)}/relgraph-{spark.sparkContext.applicationId}"
    if path not in _cleaned:
        _cleaned.add(path)

        def clean() -> None:
            try:
                Scratch(spark, None, path, {"n": 0}).drop()
            except Exception:  # the session is gone; whoever owns the shared folder cleans it
                pass

        atexit.register(clean)
    return path


def materialize(df: DataFrame, **observed: Column) -> Scratch:
    """Write df once to the shared folder and return a handle that reads it back with a one-step lineage.

    observed: aggregates to take of the rows as they are written.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    wanted = [F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in observed.items()]]
    df.observe(seen, *wanted).write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    got = dict(seen.get)
    if "n" not in got:  # a plan that proves empty may drop what watches it
        got = back.agg(*wanted).first().asDict()
    out = Scratch(spark, back, path, got)
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def shuffles_of(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Shuffles planned inside have so many partitions, for loops whose tables are held in as many."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder: unlike materialize, partitions and row order stay as they are."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)
