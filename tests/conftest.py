import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config(
            map={
                "spark.sql.shuffle.partitions": "2",
                "spark.ui.enabled": "false",
                "spark.ui.showConsoleProgress": "false",
                "spark.sql.session.timeZone": "UTC",
                "spark.driver.memory": "4g",
                "spark.default.parallelism": "2",
            }
        )
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def many_partitions(spark):
    """Seven shuffle partitions that stay apart, however small, so that states cross their borders."""
    keys = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield 7
    for k, v in before.items():
        spark.conf.set(k, v)
