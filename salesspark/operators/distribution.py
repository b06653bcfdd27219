"""ABC classes, Pareto concentration, discount bands, shares, YoY."""

from __future__ import annotations

import decimal as _decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesspark.functions.filters import apply_filters
from salesspark.operators.common import check_column, money_sum, pct, safe_ratio
from salesspark.operators.metrics import sales_by_dimension, trend
from salesspark.plans.prefix import running_total

ABC_COLUMNS = ["Product", "Category", "Net_Revenue"]
PARETO_COLUMNS = ["Customer_Key", "Customer", "Net_Revenue"]
BAND_COLUMNS = ["Sales_Amount", "Discount_Amount", "Profit_Amount", "Is_Returned"]

# ABC class upper bounds on cumulative % (right-closed bins from -0.01).
ABC_BINS = ((70.0, "A"), (90.0, "B"), (100.01, "C"))
# Default discount band upper bounds in % (right-closed bins from -0.01).
DISCOUNT_BAND_EDGES = (10, 20, 30, 100)


def _total(df: DataFrame, col: str):
    """Grand total as a scalar subquery (evaluated once, no data through the driver)."""
    return df.select(F.sum(col)).scalar()


def abc_analysis(view: DataFrame, filters: dict | None = None) -> DataFrame:
    """Products by net revenue with running revenue, cumulative % and ABC class.

    The class uses the cumulative value *including* the product, so the product
    that crosses 70 % is already B. Total revenue 0 gives 0 % everywhere (class A);
    no rows in, no rows out.
    """
    products = (apply_filters(view, filters).groupBy("Product")
                .agg(F.min("Category").alias("Category"), F.sum("Net_Revenue").alias("_revenue")))
    ranked = running_total(products, "_revenue", [F.col("_revenue").desc_nulls_last(), F.col("Product").asc()],
                           out="_cumulative", rank="Rank", total="_total")
    total = F.col("_total").cast("double")
    cum_pct = F.when(total != 0, (F.lit(100.0) * F.col("_cumulative").cast("double")) / total).otherwise(F.lit(0.0))
    return (ranked.select(
        "Rank", "Product", "Category",
        F.col("_revenue").cast("double").alias("Net_Revenue"),
        F.col("_cumulative").cast("double").alias("Cumulative_Revenue"),
        cum_pct.alias("Cumulative_Pct"))
        .withColumn("ABC_Class", _right_closed_bins(F.col("Cumulative_Pct"), -0.01, ABC_BINS))
        .orderBy("Rank"))


def _right_closed_bins(x, lower: float, bins) -> F.Column:
    """``pd.cut`` with right-closed bins: (lower, b1] -> l1, (b1, b2] -> l2 ...; outside -> NULL."""
    expr = None
    lo = lower
    for hi, label in bins:
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
        lo = hi
    return expr


def abc_summary(abc: DataFrame) -> DataFrame:
    """Products and revenue per class, with % of revenue to 1 dp."""
    per_class = (abc.filter(F.col("ABC_Class").isNotNull()).groupBy("ABC_Class")
                 .agg(F.count("Product").alias("Num_Products"), F.sum("Net_Revenue").alias("Total_Revenue")))
    total = _total(per_class, "Total_Revenue")
    return (per_class.withColumn("Pct_Of_Revenue", F.round(pct(F.col("Total_Revenue"), total), 1))
            .orderBy("ABC_Class"))


def pareto_curve(view: DataFrame, filters: dict | None = None, top_n: int | None = None) -> DataFrame:
    """Customers by revenue with cumulative % of revenue and rank % of customers.

    ``top_n`` reproduces the reference's cap on the customer list; the default
    (None) keeps every customer.
    """
    customers = (apply_filters(view, filters).groupBy("Customer_Key")
                 .agg(F.min("Customer").alias("Customer"), F.sum("Net_Revenue").alias("_revenue")))
    order = [F.col("_revenue").desc_nulls_last(), F.col("Customer_Key").asc()]
    if top_n:
        customers = customers.orderBy(*order).limit(int(top_n))
    ranked = running_total(customers, "_revenue", order, out="_cumulative", rank="Rank", total="_total",
                           count="_count")
    total = F.col("_total").cast("double")
    count = F.col("_count")
    return ranked.select(
        "Rank", "Customer_Key", "Customer",
        F.col("_revenue").cast("double").alias("Net_Revenue"),
        F.try_divide(F.lit(100.0) * F.col("_cumulative").cast("double"), total).alias("Cumulative_Pct"),
        (F.lit(100.0) * F.col("Rank") / count).alias("Customer_Rank_Pct"),
    ).orderBy("Rank")


def pareto_top_share(curve: DataFrame, share: float = 0.2) -> DataFrame:
    """Revenue share (%) of the first ``int(n * share)`` customers of the curve."""
    n = curve.select(F.count(F.lit(1))).scalar()
    cutoff = F.floor(n * F.lit(share)).cast("long")
    return curve.agg(
        F.count(F.lit(1)).alias("Customers"),
        F.coalesce(F.max(cutoff), F.lit(0)).alias("Top_Customers"),
        F.sum("Net_Revenue").alias("_total"),
        F.sum(F.when(F.col("Rank") <= cutoff, F.col("Net_Revenue")).otherwise(F.lit(0.0))).alias("_top"),
    ).select("Customers", "Top_Customers",
             safe_ratio(F.lit(100.0) * F.col("_top"), F.col("_total")).alias("Top_Share_Pct"))


def _dec_lit(v):
    """Decimal literal, so band edges compare exactly with decimal money."""
    return F.lit(_decimal.Decimal(str(v)))


def band_labels(edges) -> list[str]:
    """'0-10%', '10-20%', ..., last band '30%+' for edges (10, 20, 30, 100)."""
    fmt = lambda v: f"{v:g}"
    labels, lo = [], 0
    for i, hi in enumerate(edges):
        labels.append(f"{fmt(edges[i - 1])}%+" if i == len(edges) - 1 and i > 0 else f"{fmt(lo)}-{fmt(hi)}%")
        lo = hi
    return labels


def discount_bands(view: DataFrame, filters: dict | None = None, edges=DISCOUNT_BAND_EDGES) -> DataFrame:
    """A10: line items, discount, profit, return rate and profit per discounted unit by band.

    The discount % is ``100 * Discount / Sales`` (Sales 0 -> 1); the band test is
    done as an exact decimal comparison ``100 * Discount <= edge * Sales`` so no
    rounding moves a line across a band edge. Lines outside every band are dropped.
    """
    sales = F.col("Sales_Amount")
    denom = F.when(sales == 0, F.lit(1).cast("decimal(1,0)")).otherwise(sales)
    scaled = F.col("Discount_Amount") * F.lit(100)
    labels = band_labels(edges)
    band, lo = None, -0.01
    for hi, label in zip(edges, labels):
        cond = (scaled > _dec_lit(lo) * denom) & (scaled <= _dec_lit(hi) * denom)
        band = F.when(cond, F.lit(label)) if band is None else band.when(cond, F.lit(label))
        lo = hi
    lined = apply_filters(view, filters).withColumn("Discount_Band", band)
    summary = (lined.filter(F.col("Discount_Band").isNotNull()).groupBy("Discount_Band")
               .agg(F.count("Sales_Amount").alias("Line_Items"),
                    money_sum("Discount_Amount").alias("Total_Discount"),
                    money_sum("Profit_Amount").alias("Total_Profit"),
                    F.avg("Is_Returned").alias("_return_rate")))
    discount = F.col("Total_Discount")
    return (summary.select(
        "Discount_Band", "Line_Items", "Total_Discount", "Total_Profit",
        F.round(F.col("_return_rate") * F.lit(100.0), 2).alias("Return_Rate"),
        F.round(F.col("Total_Profit") / F.when(discount == 0, F.lit(1.0)).otherwise(discount), 2)
        .alias("Profit_Per_Discount_Rupee"))
        .orderBy("Discount_Band"))


def category_margin(view: DataFrame, filters: dict | None = None, dimension: str = "Category") -> DataFrame:
    """Breakdown with ``Margin_Pct = 100 * Profit / Net_Revenue`` (2 dp; NULL on zero revenue)."""
    out = sales_by_dimension(view, dimension, filters)
    return out.withColumn("Margin_Pct", F.round(pct(F.col("Profit"), F.col("Net_Revenue")), 2))


def share_by_dimension(view: DataFrame, dimension: str, filters: dict | None = None, out: str = "Share_Pct") -> DataFrame:
    """The breakdown of ``sales_by_dimension`` with each group's % of the total revenue.

    Groups and grand total are two grouping sets of one aggregate; both branches of the join below read the same exchange.
    """
    check_column(dimension)
    sets = (apply_filters(view, filters).groupingSets([[F.col(dimension)], []], dimension)
            .agg(F.grouping_id().alias("_all"), money_sum("Net_Revenue").alias("Net_Revenue"),
                 money_sum("Profit_Amount").alias("Profit"), F.count_distinct("Order_ID").alias("Orders"),
                 F.sum("Quantity").alias("Units")))
    total = sets.filter("_all = 1").select(F.col("Net_Revenue").alias("_total"))  # one row
    return (sets.filter("_all = 0").join(total).withColumn(out, pct(F.col("Net_Revenue"), F.col("_total")))
            .drop("_all", "_total").orderBy(F.col("Net_Revenue").desc_nulls_last(), F.col(dimension).asc_nulls_first()))


def year_over_year(view: DataFrame, filters: dict | None = None) -> DataFrame:
    """Yearly revenue with the previous year and growth %; 0 % when the previous year is 0.

    The yearly table has one row per calendar year, so the un-partitioned window
    runs over a handful of rows.
    """
    yearly = trend(view, "Year", filters)
    w = Window.orderBy("Year")
    prev = F.lag("Net_Revenue").over(w)
    growth = F.when(prev.isNull(), F.lit(None).cast("double")) \
        .otherwise(safe_ratio(F.col("Net_Revenue") - prev, prev) * F.lit(100.0))
    return (yearly.select("Year", "Net_Revenue", "Profit", "Orders",
                          F.lag("Year").over(w).alias("Prev_Year"),
                          prev.alias("Prev_Net_Revenue"), growth.alias("YoY_Growth_Pct"))
            .withColumn("Direction", F.when(F.col("YoY_Growth_Pct").isNull(), F.lit(None))
                        .when(F.col("YoY_Growth_Pct") >= 0, F.lit("grew")).otherwise(F.lit("declined")))
            .orderBy("Year"))
