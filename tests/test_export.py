import os
import tempfile

import pytest

from pyspark.sql import functions as F

from salesspark.plans.export import export_catalog, kept_view, pivot_wide, safe_name, write_csv, write_views


def test_csv_round_trip(spark, view):
    from salesspark.operators.metrics import sales_by_dimension
    out = tempfile.mkdtemp(prefix="salesspark-test-csv-")
    df = sales_by_dimension(view, "Region")
    write_csv(df, f"{out}/regions")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/regions")
    assert sorted((r["Region"], r["Net_Revenue"]) for r in back.collect()) == [("North", 270.0), ("South", 555.0)]


def test_export_catalog_writes_every_view(spark, view):
    out = tempfile.mkdtemp(prefix="salesspark-test-views-")
    views = {name: build() for name, build in export_catalog(view).items()}
    assert len(views) == 7
    paths = write_views(views, out)
    for name, path in paths.items():
        assert os.path.isdir(path)
        assert spark.read.parquet(path).count() == views[name].count()


def test_safe_name():
    assert safe_name("Sales by Region") == "Sales_by_Region"
    assert safe_name("x" * 40) == "x" * 40


def test_names_for_one_folder_are_refused(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="share the folder"):
        write_views({"A/B": df, "A B": df}, tempfile.mkdtemp(prefix="salesspark-test-names-"))


def test_pivot_wide(spark):
    df = spark.createDataFrame([("N", "2023", 1.0), ("N", "2024", 2.0), ("S", "2024", 3.0)], "r string, y string, v double")
    rows = pivot_wide(df, "r", "y", "v").collect()
    assert [tuple(r) for r in rows] == [("N", 1.0, 2.0), ("S", None, 3.0)]
    with pytest.raises(Exception, match="duplicate"):
        pivot_wide(df.unionByName(df.limit(1)), "r", "y", "v").collect()


def test_pivot_refuses_values_outside_its_columns(spark):
    df = spark.createDataFrame([("N", "2023", 1.0), ("S", "2005", 3.0)], "r string, y string, v double")
    with pytest.raises(Exception, match="outside the columns of the pivot: 2005"):
        pivot_wide(df, "r", "y", "v", keys=["2023", "2024"]).collect()
    rows = pivot_wide(df, "r", "y", "v", keys=["2005", "2023", "2024"]).collect()
    assert [tuple(r) for r in rows] == [("N", None, 1.0, None), ("S", 3.0, None, None)]


def test_kept_view_has_its_joins_behind_it(spark, tmp_path):
    rows = spark.range(5).select("id", (F.col("id") / 2).cast("decimal(16,4)").alias("d"), F.when(F.col("id") > 2, "x").alias("s"))
    view = rows.join(spark.range(3, 9), "id")
    kept = kept_view(view, str(tmp_path / "view"))
    assert "Join" not in kept._jdf.queryExecution().toString() and kept.dtypes == view.dtypes
    assert sorted(kept.collect()) == sorted(view.collect())
    assert kept_view(view.limit(0), str(tmp_path / "none")).count() == 0
