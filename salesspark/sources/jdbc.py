"""The sales tables from a database server instead of parquet.

A partitioned JDBC read: ``numPartitions`` range scans over ``partition_column``
between ``lower`` and ``upper`` run in parallel on the executors (one
connection each), instead of one connection streaming the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              fetch_size: int = 10_000, properties: dict | None = None) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds of the partition column")
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    return reader.load()
