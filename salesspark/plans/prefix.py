"""Running totals in a global order without funnelling rows into one task.

``Window.orderBy(...)`` with no partition moves every row to a single task. Instead:

1. range-partition the rows on the sort key (Spark samples the key, so a value
   shared by a third of the rows is still split by the tie-break columns);
2. checkpoint, which fixes the range assignment and cuts the lineage (a lost
   executor re-reads the checkpoint instead of re-sampling into other ranges);
3. sum and count every range - one row per range - and turn those into
   exclusive offsets (bounded by the number of ranges, so safe to broadcast);
4. a window *partitioned by range* adds the offset to the local running sum.

The running sum is taken over ``rowsBetween(unboundedPreceding, currentRow)`` so
ties are summed row by row, like a cumulative sum over a sorted list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesspark.session import ensure_checkpoint_dir


def running_total(df: DataFrame, value: str, order: list[Column], out: str = "Running_Total",
                  rank: str | None = None, ranges: int | None = None, total: str | None = None,
                  count: str | None = None) -> DataFrame:
    """Add ``out`` (running sum of ``value`` in ``order``) and optionally ``rank`` (1-based row
    number), ``total`` (grand total) and ``count`` (number of rows) - the last two come from
    the per-range sums, so they cost no extra pass over the data.

    ``order`` must be a total order (include a unique tie-break column) for the
    result to be deterministic.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = (df.repartitionByRange(n, *order)
              .withColumn("_range", F.spark_partition_id())
              .checkpoint(eager=True))
    per_range = ranged.groupBy("_range").agg(F.sum(value).alias("_range_sum"),
                                             F.count(F.lit(1)).alias("_range_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(per_range.schema["_range_sum"].dataType)
    offsets = per_range.select(
        "_range",
        F.coalesce(F.sum("_range_sum").over(before), zero).alias("_sum_offset"),
        F.coalesce(F.sum("_range_rows").over(before), F.lit(0)).alias("_row_offset"))
    local = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    res = (ranged.join(F.broadcast(offsets), "_range")
           .withColumn(out, F.col("_sum_offset") + F.sum(value).over(local)))
    if rank:
        res = res.withColumn(rank, F.col("_row_offset") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    if total or count:
        grand = per_range.select(F.struct(F.sum("_range_sum").alias("t"), F.sum("_range_rows").alias("n"))).scalar()
        if total:
            res = res.withColumn(total, grand.getField("t"))
        if count:
            res = res.withColumn(count, grand.getField("n"))
    return res.drop("_range", "_sum_offset", "_row_offset")
