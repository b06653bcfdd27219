"""KPIs, breakdowns, trends and top/bottom lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesspark.functions.filters import apply_filters
from salesspark.operators.common import check_column, money_sum, pct, safe_ratio
from salesspark.schema import BREAKDOWN_METRICS, FILTER_COLUMNS

KPI_COLUMNS = ["Net_Revenue", "Profit_Amount", "Sales_Amount", "Order_ID", "Customer_Key",
               "Product", "Is_Returned"]
BREAKDOWN_COLUMNS = ["Net_Revenue", "Profit_Amount", "Order_ID", "Quantity"]
TREND_COLUMNS = ["Year", "Quarter", "Month", "Month_Name", "Net_Revenue", "Profit_Amount", "Order_ID"]
CUSTOMER_COLUMNS = ["Customer_Key", "Customer", "Segment", "Net_Revenue", "Profit_Amount", "Order_ID"]
PRODUCT_COLUMNS = ["Product", "Category", "Net_Revenue", "Profit_Amount", "Quantity", "Sales_Amount"]
LEADERBOARD_COLUMNS = ["Salesperson", "Salesperson_Key", "Net_Revenue", "Profit_Amount", "Order_ID"]


def kpi_summary(view: DataFrame, filters: dict | None = None) -> DataFrame:
    """One row: sums (0 when nothing matches), distinct counts, returned lines and ratios.

    ``returned_orders`` counts returned *lines*, and the margin is profit over net
    revenue, as in the reference.

    Each distinct count has a plan of its own over the one column that it needs: three of them in one aggregate would make Spark copy every
    line once per count. The copies, and the values of all columns in their shuffle, cost more than reading two more columns again.
    """
    lines = apply_filters(view, filters)

    def distinct(c: str):
        return lines.filter(F.col(c).isNotNull()).select(c).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()

    totals = lines.agg(
        F.coalesce(money_sum("Net_Revenue"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(money_sum("Profit_Amount"), F.lit(0.0)).alias("total_profit"),
        F.coalesce(money_sum("Sales_Amount"), F.lit(0.0)).alias("gross_revenue"),
        F.count_distinct("Order_ID").alias("total_orders"),
        F.coalesce(F.sum("Is_Returned"), F.lit(0)).cast("long").alias("returned_orders"),
        F.count(F.lit(1)).alias("total_line_items"),
    )
    totals = totals.select("total_revenue", "total_profit", "gross_revenue", "total_orders", distinct("Customer_Key").alias("total_customers"),
                           distinct("Product").alias("total_products"), "returned_orders", "total_line_items")
    return with_ratios(totals)


def with_ratios(totals: DataFrame) -> DataFrame:
    """A2: margin, average order value and return rate of a row of totals, 0 where there is nothing to divide by."""
    return totals.select(
        "*",
        (safe_ratio(F.lit(100.0) * F.col("total_profit"), F.col("total_revenue"))).alias("profit_margin_pct"),
        safe_ratio(F.col("total_revenue"), F.col("total_orders")).alias("avg_order_value"),
        safe_ratio(F.lit(100.0) * F.col("returned_orders"), F.col("total_line_items")).alias("return_rate_pct"),
    )


def sales_by_dimension(view: DataFrame, dimension: str, filters: dict | None = None,
                       metric: str = "Net_Revenue", limit: int | None = None) -> DataFrame:
    """Revenue, profit, distinct orders and units per value of any view column.

    Ordered by ``metric`` descending with the dimension as tie-break; the NULL
    group (e.g. lines without a salesperson) is kept.
    """
    check_column(dimension)
    check_column(metric, BREAKDOWN_METRICS)
    out = (apply_filters(view, filters)
           .groupBy(dimension)
           .agg(money_sum("Net_Revenue").alias("Net_Revenue"),
                money_sum("Profit_Amount").alias("Profit"),
                F.count_distinct("Order_ID").alias("Orders"),
                F.sum("Quantity").alias("Units"))
           .orderBy(F.col(metric).desc_nulls_last(), F.col(dimension).asc_nulls_first()))
    return out.limit(int(limit)) if limit else out


def trend(view: DataFrame, grain: str = "Month", filters: dict | None = None) -> DataFrame:
    """Revenue, profit and orders per Year, (Year, Quarter) or (Year, Month, Month_Name)."""
    if grain == "Year":
        keys, order = ["Year"], ["Year"]
    elif grain == "Quarter":
        keys, order = ["Year", "Quarter"], ["Year", "Quarter"]
    else:
        keys, order = ["Year", "Month", "Month_Name"], ["Year", "Month"]
    return (apply_filters(view, filters)
            .groupBy(*keys)
            .agg(money_sum("Net_Revenue").alias("Net_Revenue"),
                 money_sum("Profit_Amount").alias("Profit"),
                 F.count_distinct("Order_ID").alias("Orders"))
            .orderBy(*order))


def with_period(df: DataFrame, grain: str = "Month") -> DataFrame:
    """A sortable period label, ``YYYY-MM`` or ``YYYY-Qn`` (Year grain: the year)."""
    if grain == "Month":
        label = F.concat_ws("-", F.col("Year").cast("string"), F.lpad(F.col("Month").cast("string"), 2, "0"))
    elif grain == "Quarter":
        label = F.concat_ws("-", F.col("Year").cast("string"), F.col("Quarter"))
    else:
        label = F.col("Year").cast("string")
    return df.withColumn("Period", label)


def top_customers(view: DataFrame, n: int = 10, filters: dict | None = None) -> DataFrame:
    """Top-n customers by net revenue, grouped by key (name/segment via ``min``)."""
    return (apply_filters(view, filters)
            .groupBy("Customer_Key")
            .agg(F.min("Customer").alias("Customer"), F.min("Segment").alias("Segment"),
                 money_sum("Net_Revenue").alias("Net_Revenue"),
                 money_sum("Profit_Amount").alias("Profit"),
                 F.count_distinct("Order_ID").alias("Orders"))
            .orderBy(F.col("Net_Revenue").desc_nulls_last(), F.col("Customer_Key").asc())
            .limit(int(n)))


def top_products(view: DataFrame, n: int = 10, filters: dict | None = None,
                 ascending: bool = False) -> DataFrame:
    """Top (or, ascending, bottom) n products by net revenue, with margin on gross sales."""
    order = F.col("Net_Revenue").asc_nulls_first() if ascending else F.col("Net_Revenue").desc_nulls_last()
    return (apply_filters(view, filters)
            .groupBy("Product")
            .agg(F.min("Category").alias("Category"),
                 money_sum("Net_Revenue").alias("Net_Revenue"),
                 money_sum("Profit_Amount").alias("Profit"),
                 F.sum("Quantity").alias("Units"),
                 pct(F.sum("Profit_Amount"), F.sum("Sales_Amount")).alias("Margin_Pct"))
            .orderBy(order, F.col("Product").asc_nulls_first())
            .limit(int(n)))


def salesperson_leaderboard(view: DataFrame, filters: dict | None = None) -> DataFrame:
    """All salespeople by net revenue; lines without a salesperson are left out."""
    return (apply_filters(view.filter(F.col("Salesperson").isNotNull()), filters)
            .groupBy("Salesperson_Key")
            .agg(F.min("Salesperson").alias("Salesperson"),
                 money_sum("Net_Revenue").alias("Net_Revenue"),
                 money_sum("Profit_Amount").alias("Profit"),
                 F.count_distinct("Order_ID").alias("Deals"))
            .orderBy(F.col("Net_Revenue").desc_nulls_last(), F.col("Salesperson_Key").asc()))


def top_selling_products(view: DataFrame, n: int = 20, filters: dict | None = None) -> DataFrame:
    """Product names by gross sales (feeds the co-purchase picker)."""
    return (apply_filters(view, filters)
            .groupBy("Product")
            .agg(money_sum("Sales_Amount").alias("Sales_Amount"))
            .orderBy(F.col("Sales_Amount").desc_nulls_last(), F.col("Product").asc())
            .limit(int(n)))


def breakdown_aov(breakdown: DataFrame) -> DataFrame:
    """Average order value per group, rounded to 0 dp."""
    return breakdown.withColumn(
        "Avg_Order_Value", F.round(F.try_divide(F.col("Net_Revenue"), F.col("Orders").cast("double")), 0))


def per_unit_kpis(kpis: DataFrame) -> DataFrame:
    """Revenue per customer and per product (0 when there are none)."""
    return kpis.select(
        "*",
        safe_ratio(F.col("total_revenue"), F.col("total_customers")).alias("revenue_per_customer"),
        safe_ratio(F.col("total_revenue"), F.col("total_products")).alias("revenue_per_product"),
    )


def distinct_values(frames: DataFrame | list[DataFrame], names: list[str]) -> DataFrame:
    """(Filter, Value): the distinct non-null values, as strings, of the filter columns ``names``. ``frames`` is the view, or frames of which
    each has some of the columns (``sources.tables.filter_frames``); it is their rows that become one row per column."""
    parts = []
    for frame in frames if isinstance(frames, list) else [frames]:
        own = [n for n in names if FILTER_COLUMNS[n] in frame.columns]
        if own:
            parts.append(frame.select(*[F.col(FILTER_COLUMNS[n]).cast("string").alias(n) for n in own]).unpivot([], own, "Filter", "Value"))
    return reduce(DataFrame.unionByName, parts).filter(F.col("Value").isNotNull()).distinct()


def filter_options(frames: DataFrame | list[DataFrame], names: list[str] | None = None) -> DataFrame:
    """Distinct non-null values of every filter column, in one job; ``Sort_Key`` orders numeric filters numerically."""
    return (distinct_values(frames, names or list(FILTER_COLUMNS))
            .withColumn("Sort_Key", F.expr("try_cast(Value AS DOUBLE)"))
            .orderBy("Filter", F.col("Sort_Key").asc_nulls_last(), "Value"))
