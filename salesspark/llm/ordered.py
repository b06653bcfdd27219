"""Places and running sums within a key, for keys of any number of rows: no window ever holds more than one range of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesspark.llm.common import settled


def running_by_key(df: DataFrame, key: str, order: list[Column], sums: dict[str, str], place: str | None = None) -> DataFrame:
    """Add the running sum of each column of ``sums`` (new name: old name) over the rows of the same ``key`` up to each row in ``order``, and
    its 1-based ``place`` among them. ``key`` is not null.

    Rows are range-partitioned by (key, order) and settled, so a key of many rows spreads over many ranges. Only a key that goes on from
    one range to the next needs the sums of its earlier ranges, at most one a range: these are broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(n, F.col(key), *order).withColumn("_range", F.spark_partition_id()))
    totals = {f"_t{i}": F.sum(old) for i, old in enumerate(sums.values())} | {"_tn": F.count(F.lit(1))}
    parts = ranged.groupBy(key, "_range").agg(*(c.alias(name) for name, c in totals.items()))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.select(key, "_range", *(F.sum(t).over(earlier).alias(t) for t in totals)).filter("_tn IS NOT NULL")
    own = Window.partitionBy("_range", key).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(F.broadcast(spans), [key, "_range"], "left")
    before = {new: F.col(f"_t{i}") for i, new in enumerate(sums)}
    out = [(F.sum(old).over(so_far) + F.coalesce(before[new], F.lit(0))).alias(new) for new, old in sums.items()]
    if place:
        out.append((F.row_number().over(own) + F.coalesce("_tn", F.lit(0))).alias(place))
    return joined.select(*df.columns, *out)
