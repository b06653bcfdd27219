"""Star files, rows of the view, parameterised SQL and the kept view."""

import decimal
import tempfile

from salesspark.operators.metrics import kpi_summary
from salesspark.sources.star import read_star, view_from_star
from salesspark.sources.tables import check_integrity, sales_view
from salesspark.sources.view import cache_view, raw_sales, refresh_view, register_view, run_query

SF = "/root/testdata/sf0.001"


def test_read_star_round_trip(spark, star):
    root = tempfile.mkdtemp(prefix="salesspark-test-star-")
    for name, df in star.items():
        df.write.parquet(f"{root}/{name}")
    view = view_from_star(read_star(spark, root))
    kpi = kpi_summary(view).collect()[0]
    assert (kpi["total_revenue"], kpi["total_profit"], kpi["total_orders"]) == (825.0, 355.0, 4)
    assert isinstance(view.first()["Net_Revenue"], decimal.Decimal)


def test_raw_sales_filters_and_projects(view):
    rows = raw_sales(view, {"Region": "North"}, ["Order_ID", "Region"]).collect()
    assert sorted(map(tuple, rows)) == [(1001, "North"), (1003, "North")]
    assert raw_sales(view).count() == 4


def test_parameterised_sql(spark, view):
    name = register_view(view)
    rows = run_query(spark, f"SELECT Order_ID FROM {name} WHERE Region = :r ORDER BY Order_ID", {"r": "South' OR '1'='1"})
    assert rows.count() == 0
    assert [r[0] for r in run_query(spark, f"SELECT Order_ID FROM {name} WHERE Region = :r ORDER BY 1", {"r": "South"}).collect()] \
        == [1002, 1004]


def test_kept_view_until_refresh(spark, star):
    kept = cache_view(view_from_star(star).filter("Quantity > 1"))
    assert kept.count() == 2 and kept.is_cached
    refresh_view(kept)
    assert not kept.is_cached and kept.count() == 2


def test_keys_of_the_test_tables_are_complete(spark):
    rows = check_integrity(spark, SF).collect()
    assert len(rows) == 6 and all(r["Orphans"] == 0 and r["Repeated_Keys"] == 0 for r in rows)


def test_line_keys_are_unique(spark):
    keys = sales_view(spark, SF, ["Sales_Key"], keys_complete=True)
    assert keys.distinct().count() == keys.count()


def test_filter_frames_hold_the_values_of_the_view(spark):
    """Rows of dimensions that no line leads to are left out, and no column is made 14 times out of the lines."""
    from salesspark.operators.metrics import filter_options
    from salesspark.sources.tables import filter_frames

    folder = tempfile.mkdtemp(prefix="salesspark-test-frames-")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.filter("l_orderkey % 50 = 0") if name == "lineitem" else rows).write.parquet(f"{folder}/{name}.parquet")
    got = sorted(map(tuple, filter_options(filter_frames(spark, folder)).collect()), key=str)
    assert got == sorted(map(tuple, filter_options(sales_view(spark, folder)).collect()), key=str)
    assert 0 < len(got) < filter_options(sales_view(spark, SF)).count()
