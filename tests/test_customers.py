import datetime as dt

import pytest

from salesspark.operators.customers import churn_dataset, customer_features, holdout_split


def test_customer_features_recency_and_tenure(view):
    rows = {r["Customer"]: r for r in customer_features(view).collect()}
    assert (rows["Alice"]["Recency_Days"], rows["Alice"]["Tenure_Days"]) == (0.0, 70.0)
    assert (rows["Bob"]["Recency_Days"], rows["Bob"]["Tenure_Days"]) == (14.0, 20.0)
    assert rows["Bob"]["Frequency"] == 2 and rows["Bob"]["Monetary"] == 555
    assert rows["Alice"]["Customer_Rating"] == pytest.approx(4.5)


def test_customer_features_empty_keeps_columns(view):
    out = customer_features(view, {"Region": "Nonexistent"})
    assert out.count() == 0
    assert {"Recency_Days", "Tenure_Days"} <= set(out.columns)


@pytest.fixture(scope="module")
def raw_sales(spark):
    rows = []
    for c in range(10):  # one order in 2023-01 -> churned
        rows.append((c, 1000 + c, dt.date(2023, 1, 1), 80.0, 3.0))
    for c in range(10, 20):  # three early orders and one recent -> active
        for i, d in enumerate([dt.date(2023, 1, 1), dt.date(2023, 2, 1), dt.date(2023, 3, 1), dt.date(2024, 6, 1)]):
            rows.append((c, 2000 + 10 * c + i, d, 150.0 if i < 3 else 90.0, 4.5))
    return spark.createDataFrame(rows, "Customer_Key long, Order_ID long, Order_Date date, Net_Revenue double, "
                                       "Customer_Rating double")


def test_churn_labels(raw_sales):
    rows = {r["Customer_Key"]: r for r in churn_dataset(raw_sales).collect()}
    assert len(rows) == 20
    assert all(rows[c]["Churned"] == 1 for c in range(10))
    assert all(rows[c]["Churned"] == 0 for c in range(10, 20))
    # features only see orders before the cutoff (2024-06-01 - 180 days)
    assert rows[15]["Frequency"] == 3 and rows[15]["Monetary"] == 450
    assert rows[15]["Tenure_Days"] == 59 and rows[15]["Avg_Order_Value"] == 150


def test_churn_excludes_customers_first_seen_after_cutoff(spark, raw_sales):
    late = spark.createDataFrame([(99, 9999, dt.date(2024, 5, 30), 10.0, 1.0)], raw_sales.schema)
    keys = {r["Customer_Key"] for r in churn_dataset(raw_sales.unionByName(late)).collect()}
    assert 99 not in keys


def test_holdout_split_is_deterministic(raw_sales):
    a = holdout_split(churn_dataset(raw_sales)).orderBy("Customer_Key").collect()
    b = holdout_split(churn_dataset(raw_sales)).orderBy("Customer_Key").collect()
    assert [r["Split"] for r in a] == [r["Split"] for r in b]
    assert {r["Split"] for r in a} <= {"train", "test"}


def test_holdout_split_keeps_class_shares(spark):
    rows = [(i, 1 if i < 37 else 0) for i in range(150)]
    split = holdout_split(spark.createDataFrame(rows, "Customer_Key long, Churned int"))
    test = {r["Churned"]: r["n"] for r in split.filter("Split = 'test'").groupBy("Churned").agg({"*": "count"})
            .withColumnRenamed("count(1)", "n").collect()}
    # 25 % of 150 rounded up is 38; 37 of 150 churned get 38 * 37 / 150 = 9.37 -> 9, the others 28.63 -> 29
    assert test == {1: 9, 0: 29} and split.count() == 150
