"""Result reuse and the bucketed layout: freshness, expiry, writers at once, plans."""

import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from salesspark.sources.layout import stored_layout
from salesspark.sources.results import ResultStore, plan_name
from salesspark.sources.tables import sales_view

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark):
    path = tempfile.mkdtemp(prefix="salesspark-test-stored-")
    spark.range(100).withColumn("v", F.col("id") % 7).write.parquet(f"{path}/source")
    return path


def total(spark, folder, least=0):
    return spark.read.parquet(f"{folder}/source").filter(F.col("v") >= least).groupBy("v").agg(F.sum("id").alias("s"))


def test_second_read_comes_from_the_store(spark, folder):
    store = ResultStore(spark, f"{folder}/results")
    first = sorted(map(tuple, store.reuse(total(spark, folder)).collect()))
    again = store.reuse(total(spark, folder))
    assert (store.misses, store.hits) == (1, 1) and sorted(map(tuple, again.collect())) == first
    assert all("/results/" in f for f in again.inputFiles())
    store.reuse(total(spark, folder, 3))
    store.reuse(total(spark, folder), {"p": 1})
    assert (store.misses, store.hits) == (3, 1)
    store.clear()
    store.reuse(total(spark, folder))
    assert store.misses == 4


def test_results_expire(spark, folder):
    now = [1000.0]
    store = ResultStore(spark, f"{folder}/results", ttl=3600, clock=lambda: now[0])
    for t, misses in ((1000.0, 1), (4599.0, 1), (4600.0, 2), (8199.0, 2), (9000.0, 3)):
        now[0] = t
        store.reuse(total(spark, folder))
        assert store.misses == misses, t
    assert len(store._versions(plan_name(total(spark, folder)))) == 2  # the first is gone


def test_changed_files_are_another_result(spark, folder):
    store = ResultStore(spark, f"{folder}/results")
    before = store.reuse(total(spark, folder)).agg(F.sum("s")).first()[0]
    spark.range(100, 110).withColumn("v", F.col("id") % 7).write.mode("append").parquet(f"{folder}/source")
    assert store.reuse(total(spark, folder)).agg(F.sum("s")).first()[0] == before + sum(range(100, 110)) and store.misses == 2


def test_two_writers_both_publish_whole_results(spark, folder):
    stores = [ResultStore(spark, f"{folder}/results") for _ in range(4)]
    out = [None] * 4

    def run(i):
        out[i] = sorted(map(tuple, stores[i].reuse(total(spark, folder)).collect()))

    threads = [threading.Thread(target=run, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(o == sorted(map(tuple, total(spark, folder).collect())) for o in out)


def test_plans_without_a_name_are_refused(spark, folder):
    store = ResultStore(spark, f"{folder}/results")
    source = spark.read.parquet(f"{folder}/source")
    for df in (source.withColumn("r", F.rand()), source.select(F.udf(lambda x: x)("v")), spark.createDataFrame([(1,)], "a int"),
               source.checkpoint()):
        with pytest.raises(ValueError, match="reused"):
            store.reuse(df)


def test_names_tell_sources_apart(spark, folder):
    spark.range(100).withColumn("v", F.col("id") % 7).write.parquet(f"{folder}/other")
    a, b = spark.read.parquet(f"{folder}/source"), spark.read.parquet(f"{folder}/other")
    names = {plan_name(x.alias("x").join(y.alias("y"), F.expr("x.id = y.id")).select("x.v", F.col("y.id").alias("i"))) for x, y in ((a, b), (b, a))}
    assert len(names) == 2 and plan_name(a.select("v")) != plan_name(a.select("id")) != plan_name(a.select(F.col("id").alias("v")))
    assert plan_name(a.filter("v = 1")) == plan_name(spark.read.parquet(f"{folder}/source").filter("v = 1"))


def test_layout_joins_without_a_shuffle_of_the_lines(spark, folder):
    stored = stored_layout(spark, SF, f"{folder}/layout")
    view = sales_view(spark, SF, ["Order_ID", "Year", "Channel", "Net_Revenue"], keys_complete=True, stored=stored)
    per_order = view.groupBy("Order_ID").agg(F.sum("Net_Revenue").alias("r"), F.max("Year").alias("y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = per_order._jdf.queryExecution().executedPlan().toString()
        plain = sales_view(spark, SF, ["Order_ID", "Year", "Net_Revenue"], keys_complete=True)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = sales_view(spark, SF, ["Order_ID", "Year", "Channel", "Net_Revenue"], keys_complete=True)
    assert view.exceptAll(want).count() == 0 and view.count() == want.count()


def test_layout_is_written_once_and_follows_its_sources(spark, folder):
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/t/{name}.parquet")
    files = {i: sorted(stored_layout(spark, f"{folder}/t", f"{folder}/layout")["orders"].inputFiles()) for i in range(2)}
    assert files[0] == files[1]
    n = stored_layout(spark, f"{folder}/t", f"{folder}/layout")["orders"].count()
    spark.read.parquet(f"{SF}/orders.parquet").limit(5).write.mode("append").parquet(f"{folder}/t/orders.parquet")
    assert stored_layout(spark, f"{folder}/t", f"{folder}/layout")["orders"].count() == n + 5
