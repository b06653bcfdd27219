import pytest

from salesspark.functions.filters import apply_filters, filter_columns, normalize_filters


@pytest.mark.parametrize("value", [None, "All", "", [], (), ["All", None, ""]])
def test_sentinels_mean_no_filter(view, value):
    assert normalize_filters({"Region": value}) == {}
    assert apply_filters(view, {"Region": value}).count() == 4


def test_none_and_empty_dict():
    assert normalize_filters(None) == {} and normalize_filters({}) == {}


def test_equality_in_and_conjunction(view):
    assert apply_filters(view, {"Region": "North"}).count() == 2
    assert apply_filters(view, {"Customer": ["Alice", "Bob", "All"]}).count() == 4
    assert apply_filters(view, {"Region": "South", "Product": {"Widget B"}}).count() == 2
    assert apply_filters(view, {"Region": "South", "Product": "Widget A"}).count() == 0


def test_unknown_names_ignored(view):
    assert normalize_filters({"Nope": "x", "Region": "North"}) == {"Region": ["North"]}
    assert apply_filters(view, {"Nope": "x"}).count() == 4


def test_string_literals_cast_to_column_type(view):
    assert apply_filters(view, {"Year": "2024"}).count() == 4
    assert apply_filters(view, {"Month": ["3", 1]}).count() == 3
    # a value that cannot be an integer matches nothing instead of failing under ANSI
    assert apply_filters(view, {"Year": "Q1"}).count() == 0
    assert apply_filters(view, {"Quarter": "Q1"}).count() == 4


def test_filter_columns():
    assert filter_columns({"Region": "North", "Year": None, "Bad": 1}) == ["Region"]
    assert filter_columns({"Year": "2024"}) == ["Year", "Order_Date"]


def test_year_filter_adds_pushable_date_range(spark, view):
    assert apply_filters(view, {"Year": ["2024", 2023]}).count() == 4
    assert apply_filters(view, {"Year": 2023}).count() == 0
    from salesspark.plans.catalog import view_for
    v = view_for(spark, "/root/testdata/sf0.001", ["Net_Revenue"], {"Year": "1997"})
    plan = apply_filters(v, {"Year": "1997"})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1997-01-01T00:00)" in plan


def test_predicate_reaches_parquet_scan(spark):
    from salesspark.plans.catalog import KPI_FILTERED, view_for
    from salesspark.operators.metrics import KPI_COLUMNS, kpi_summary
    df = kpi_summary(view_for(spark, "/root/testdata/sf0.001", KPI_COLUMNS, KPI_FILTERED), KPI_FILTERED)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(r_name,EUROPE)" in plan  # the Region filter reaches the region scan


def test_parameterised_query_on_registered_view(spark, view):
    from salesspark.sources.view import register_view, run_query
    name = register_view(view)
    rows = run_query(spark, f"SELECT SUM(Net_Revenue) AS r FROM {name} WHERE Region = :region",
                     {"region": "North"}).collect()
    assert rows[0]["r"] == 270
    # a hostile value stays a literal
    assert run_query(spark, f"SELECT COUNT(*) AS n FROM {name} WHERE Region = :region",
                     {"region": "North' OR '1'='1"}).collect()[0]["n"] == 0


def test_foreign_keys_resolve_so_dimension_pruning_is_exact(spark):
    from salesspark.sources.tables import check_integrity, sales_view
    rows = {r["Foreign_Key"]: r["Orphans"] for r in check_integrity(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == 6 and set(rows.values()) == {0}
    pruned = sales_view(spark, "/root/testdata/sf0.001", ["Net_Revenue"], keys_complete=True).count()
    full = sales_view(spark, "/root/testdata/sf0.001", ["Net_Revenue"]).count()
    assert pruned == full
