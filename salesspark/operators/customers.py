"""Customer features and the leakage-free churn table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesspark.functions.filters import apply_filters
from salesspark.functions.scalars import zero_to_one
from salesspark.operators.common import money_sum
from salesspark.plans.prefix import running_total
from salesspark.session import ensure_checkpoint_dir

FEATURE_COLUMNS = ["Customer_Key", "Customer", "Segment", "Order_ID", "Net_Revenue", "Profit_Amount",
                   "Order_Date", "Customer_Rating"]
CHURN_COLUMNS = ["Customer_Key", "Order_ID", "Order_Date", "Net_Revenue", "Customer_Rating"]

# Churn window in days (the label looks this far past the cutoff).
CHURN_WINDOW_DAYS = 180


def order_days(lines: DataFrame, attributes: list[str]) -> DataFrame:
    """One row per customer, order and day with its sums, out of one pass over the lines and kept: the last day of all, the cutoff and every
    figure of a customer come from it."""
    ensure_checkpoint_dir(lines.sparkSession)
    money = [c for c in ("Net_Revenue", "Profit_Amount") if c in lines.columns]
    return lines.groupBy("Customer_Key", *attributes, "Order_ID", "Order_Date").agg(
        *(F.sum(c).alias(c) for c in money), F.sum(F.col("Customer_Rating").cast("decimal(20,10)")).alias("_rating"),
        F.count("Customer_Rating").alias("_rated")).checkpoint(eager=True)


def _rating(keep=lambda c: c) -> Column:
    return F.try_divide(F.sum(keep(F.col("_rating"))).cast("double"), F.sum(keep(F.col("_rated"))).cast("double"))


def customer_features(view: DataFrame, filters: dict | None = None) -> DataFrame:
    """One row per customer: frequency, monetary, profit, line-weighted rating,
    recency (days before the dataset's last order date) and tenure (first to last order)."""
    days = order_days(apply_filters(view, filters), ["Customer", "Segment"])
    per_customer = (days
                    .groupBy("Customer_Key", "Customer", "Segment")
                    .agg(F.count_distinct("Order_ID").alias("Frequency"),
                         money_sum("Net_Revenue").alias("Monetary"),
                         money_sum("Profit_Amount").alias("Total_Profit"),
                         F.min("Order_Date").alias("_first"),
                         F.max("Order_Date").alias("_last"),
                         _rating().alias("Customer_Rating")))
    dataset_last = days.select(F.max("Order_Date")).scalar()
    return per_customer.select(
        "Customer_Key", "Customer", "Segment", "Frequency", "Monetary", "Total_Profit", "Customer_Rating",
        F.datediff(dataset_last, F.col("_last")).cast("double").alias("Recency_Days"),
        F.datediff(F.col("_last"), F.col("_first")).cast("double").alias("Tenure_Days"))


def churn_dataset(view: DataFrame, window_days: int = CHURN_WINDOW_DAYS) -> DataFrame:
    """M6: features from orders on or before ``max(Order_Date) - window_days``; label 1 when
    the customer has no order after that cutoff.

    Customers whose first order is after the cutoff are not in the table. Features
    and label are conditional aggregates over ``order_days``.
    """
    days = order_days(view, [])
    cutoff = F.date_sub(days.select(F.max("Order_Date")).scalar(), int(window_days))
    early = F.col("Order_Date") <= cutoff

    def before(c: str | Column) -> Column:
        return F.when(early, F.col(c) if isinstance(c, str) else c)

    features = (days.groupBy("Customer_Key")
                .agg(F.count_distinct(before("Order_ID")).alias("Frequency"),
                     F.sum(before("Net_Revenue")).cast("double").alias("Monetary"),
                     _rating(before).alias("Customer_Rating"),
                     F.min(before("Order_Date")).alias("_first"),
                     F.max(before("Order_Date")).alias("_last"),
                     F.max("Order_Date").alias("_latest"))
                .filter(F.col("_last").isNotNull()))
    return features.select(
        "Customer_Key", "Frequency", "Monetary", "Customer_Rating",
        (F.col("Monetary") / zero_to_one("Frequency").cast("double")).alias("Avg_Order_Value"),
        F.datediff(F.col("_last"), F.col("_first")).alias("Tenure_Days"),
        F.when(F.col("_latest") > cutoff, F.lit(0)).otherwise(F.lit(1)).alias("Churned"))


def holdout_split(df: DataFrame, key: str = "Customer_Key", test_pct: int = 25, label: str = "Churned") -> DataFrame:
    """M7: stratified hold-out. ``ceil(test_pct % of the rows)`` go to test, shared among the classes in proportion
    (whole parts first, then one each by largest remainder, smaller label first); in each class the rows with the
    smallest MD5 of the key go. Ranks come from a running total over ranges, so no task holds a whole class."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)  # read for the counts and for the ranks
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()}  # a row per class
    total = sum(counts.values())
    test = -(-total * int(test_pct) // 100)
    quota = {c: test * n // total for c, n in counts.items()}
    for c in sorted(counts, key=lambda c: (-(test * counts[c] % total), c))[:test - sum(quota.values())]:
        quota[c] += 1
    hashed = df.withColumn("_one", F.lit(1)).withColumn("_md5", F.md5(F.col(key).cast("string")))
    ranked = running_total(hashed, "_one", [F.col(label), F.col("_md5"), F.col(key)], out="_sum", rank="_rank")
    limit, before = F.lit(0), 0
    for c in sorted(counts):
        limit = F.when(F.col(label) == c, F.lit(before + quota[c])).otherwise(limit)
        before += counts[c]
    return ranked.withColumn("Split", F.when(F.col("_rank") <= limit, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("_one", "_md5", "_sum", "_rank")
