import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from salesspark.plans.prefix import running_total


def on_one_window(df, value, order, out, rank):
    w = Window.orderBy(*order)
    return df.withColumn(out, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(rank, F.row_number().over(w))


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_distributed_running_total_equals_single_window(spark, ranges):
    rnd = random.Random(7)
    # a third of the rows share one value: ties must be summed row by row in tie-break order
    data = [(i, 5 if i % 3 == 0 else rnd.randint(0, 50)) for i in range(600)]
    df = spark.createDataFrame(data, "k long, v long")
    order = [F.col("v").desc(), F.col("k").asc()]
    got = {r["k"]: (r["run"], r["rank"]) for r in running_total(df, "v", order, "run", "rank", ranges).collect()}
    want = {r["k"]: (r["run"], r["rank"]) for r in on_one_window(df, "v", order, "run", "rank").collect()}
    assert got == want


def test_running_total_empty(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert running_total(df, "v", [F.col("v").desc(), F.col("k")], "run", "rank").count() == 0
