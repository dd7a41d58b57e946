"""Global range sort with carried state: the base of the per-key and per-entity ordered operators.

Rows are range-partitioned on the key *and* a secondary order, with Spark's sampled quantiles, so a key that holds a
third of all rows is spread over a third of the partitions. What a partition cannot know by itself is a state per
boundary, and there are only as many boundaries as partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PID = "__pid"


def range_sorted(df: DataFrame, *cols: str) -> DataFrame:
    """df range-partitioned and sorted on cols, with the partition's number in the column PID.

    Partition numbers follow the global order of cols. The number of partitions is spark.sql.shuffle.partitions,
    lowered by adaptive execution where partitions are small.
    """
    return df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(PID, F.spark_partition_id())
