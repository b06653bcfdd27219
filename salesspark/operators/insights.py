"""Five rule-based insight facts as rows (Insight_ID, Metric, Value, Text).

The lines are read once: one aggregate with two grouping sets, (Year, Region) and Product, is kept, and the totals, the years, the regions
and the ABC classes all come from its rows. Each fact is one row of a plan over them; nothing but the final five rows reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesspark.functions.scalars import fill_template, format_inr, format_pct, safe_divide
from salesspark.operators.distribution import abc_analysis
from salesspark.functions.filters import apply_filters
from salesspark.operators.common import money_sum, safe_ratio
from salesspark.operators.metrics import KPI_COLUMNS, TREND_COLUMNS, kpi_summary, trend
from salesspark.session import ensure_checkpoint_dir

INSIGHT_COLUMNS = ["Year", "Region", "Product", "Category", "Net_Revenue", "Profit_Amount", "Is_Returned"]
DELTA_COLUMNS = list(dict.fromkeys(KPI_COLUMNS + TREND_COLUMNS))

# Thresholds of the narrative rules.
HEALTHY_MARGIN_PCT = 15
ELEVATED_RETURN_PCT = 8

# The insight sentences.
YOY_TEXT = "Net revenue {direction} {pct}% in {year} versus {previous}, closing the year at {amount}."
MARGIN_TEXT = "Overall profit margin stands at {margin} on {revenue} in net revenue -- {comment}."
MARGIN_GOOD = "a healthy margin"
MARGIN_WATCH = "a margin worth monitoring closely"
REGION_TEXT = "{region} is the leading region, contributing {share} of total revenue ({amount})."
ABC_TEXT = ("Just {products}% of products (Class A) generate {revenue}% of revenue -- a concentration worth "
            "protecting with supply-chain priority.")
RETURN_HIGH_TEXT = ("Return rate is elevated at {rate} -- worth cross-checking against discount depth, a pattern "
                    "previously linked to return spikes in this dataset.")
RETURN_OK_TEXT = "Return rate is within a normal range at {rate}."


def _fact(df: DataFrame, insight_id: int, metric: str, value, text) -> DataFrame:
    return df.select(F.lit(insight_id).alias("Insight_ID"), F.lit(metric).alias("Metric"),
                     value.cast("double").alias("Value"), text.alias("Text"))


def line_totals(view: DataFrame, filters: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(Year, Region) and Product rows with Net_Revenue, Profit_Amount (exact), _returned and _lines, out of one pass."""
    ensure_checkpoint_dir(view.sparkSession)
    lines = apply_filters(view, filters).select("Year", "Region", "Product", "Category", "Net_Revenue", "Profit_Amount", "Is_Returned")
    sets = lines.groupingSets([["Year", "Region"], ["Product"]], "Year", "Region", "Product").agg(
        F.grouping("Product").alias("_whole"), F.min("Category").alias("Category"), F.sum("Net_Revenue").alias("Net_Revenue"),
        F.sum("Profit_Amount").alias("Profit_Amount"), F.sum("Is_Returned").alias("_returned"), F.count(F.lit(1)).alias("_lines")) \
        .checkpoint(eager=True)
    return sets.filter("_whole = 1").drop("Product", "Category"), sets.filter("_whole = 0").drop("Year", "Region")


def executive_summary(view: DataFrame, filters: dict | None = None) -> DataFrame:
    by_year, by_product = line_totals(view, filters)
    totals = by_year.agg(F.coalesce(money_sum("Net_Revenue"), F.lit(0.0)).alias("total_revenue"),
                         F.coalesce(money_sum("Profit_Amount"), F.lit(0.0)).alias("total_profit"),
                         F.coalesce(F.sum("_returned"), F.lit(0)).alias("returned_orders"), F.coalesce(F.sum("_lines"), F.lit(0)).alias("total_line_items"))
    kpis = totals.select("total_revenue", safe_ratio(F.lit(100.0) * F.col("total_profit"), F.col("total_revenue")).alias("profit_margin_pct"),
                         safe_ratio(F.lit(100.0) * F.col("returned_orders"), F.col("total_line_items")).alias("return_rate_pct"))
    yearly = by_year.groupBy("Year").agg(money_sum("Net_Revenue").alias("Net_Revenue"))

    # 1. growth of the last year over the one before (needs two years)
    w = Window.orderBy(F.col("Year").desc())
    ranked = yearly.select("Year", "Net_Revenue", F.row_number().over(w).alias("_r")).filter(F.col("_r") <= 2)
    pair = ranked.agg(
        F.max(F.when(F.col("_r") == 1, F.col("Year"))).alias("_y"),
        F.max(F.when(F.col("_r") == 1, F.col("Net_Revenue"))).alias("_c"),
        F.max(F.when(F.col("_r") == 2, F.col("Year"))).alias("_py"),
        F.max(F.when(F.col("_r") == 2, F.col("Net_Revenue"))).alias("_p"),
        F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == 2)
    growth = safe_divide(F.col("_c") - F.col("_p"), F.col("_p")) * F.lit(100.0)
    yoy = _fact(pair, 1, "yoy_growth_pct", growth, fill_template(
        YOY_TEXT, direction=F.when(growth >= 0, F.lit("grew")).otherwise(F.lit("declined")),
        pct=F.regexp_replace(F.format_number(F.abs(growth), 1), ",", ""), year=F.col("_y").cast("string"),
        previous=F.col("_py").cast("string"), amount=format_inr(F.col("_c"))))

    # 2. margin health
    margin = F.col("profit_margin_pct")
    margin_fact = _fact(kpis, 2, "profit_margin_pct", margin, fill_template(
        MARGIN_TEXT, margin=format_pct(margin), revenue=format_inr(F.col("total_revenue")),
        comment=F.when(margin >= HEALTHY_MARGIN_PCT, F.lit(MARGIN_GOOD)).otherwise(F.lit(MARGIN_WATCH))))

    # 3. leading region and its share of the regional total
    regions = by_year.groupBy("Region").agg(money_sum("Net_Revenue").alias("Net_Revenue")) \
        .orderBy(F.col("Net_Revenue").desc_nulls_last(), F.col("Region").asc_nulls_first())  # doubles are added in this order
    lead = regions.agg(
        F.min_by("Region", F.struct(-F.col("Net_Revenue"), F.col("Region").isNotNull(), F.col("Region")))
        .alias("_region"),
        F.max("Net_Revenue").alias("_top"), F.sum("Net_Revenue").alias("_all"), F.count(F.lit(1)).alias("_n"),
    ).filter(F.col("_n") > 0)
    share = safe_divide(F.col("_top"), F.col("_all")) * F.lit(100.0)
    region_fact = _fact(lead, 3, "leading_region_share_pct", share, fill_template(
        REGION_TEXT, region=F.coalesce(F.col("_region"), F.lit("None")), share=format_pct(share),
        amount=format_inr(F.col("_top"))))

    # 4. class-A concentration
    abc = abc_analysis(by_product)
    conc = abc.agg(F.count(F.lit(1)).alias("_n"),
                   F.count(F.when(F.col("ABC_Class") == "A", True)).alias("_na"),
                   F.sum("Net_Revenue").alias("_rev"),
                   F.sum(F.when(F.col("ABC_Class") == "A", F.col("Net_Revenue")).otherwise(F.lit(0.0))).alias("_reva"),
                   ).filter(F.col("_n") > 0)
    pct_products = safe_divide(F.col("_na"), F.col("_n")) * F.lit(100.0)
    pct_revenue = safe_divide(F.col("_reva"), F.col("_rev")) * F.lit(100.0)
    abc_fact = _fact(conc, 4, "class_a_revenue_pct", pct_revenue, fill_template(
        ABC_TEXT, products=F.regexp_replace(F.format_number(pct_products, 0), ",", ""),
        revenue=F.regexp_replace(F.format_number(pct_revenue, 0), ",", "")))

    # 5. return-rate flag
    rr = F.col("return_rate_pct")
    return_fact = _fact(kpis, 5, "return_rate_pct", rr, F.when(
        rr > ELEVATED_RETURN_PCT, fill_template(RETURN_HIGH_TEXT, rate=format_pct(rr)))
        .otherwise(fill_template(RETURN_OK_TEXT, rate=format_pct(rr))))

    return (yoy.unionByName(margin_fact).unionByName(region_fact).unionByName(abc_fact)
            .unionByName(return_fact).orderBy("Insight_ID"))


def dashboard_delta(view: DataFrame, filters: dict | None = None) -> DataFrame:
    """The dashboard's KPI delta compares the total of *all* filtered years with
    the second-to-last year (kept apart from the insights' last-two-years growth)."""
    from salesspark.functions.scalars import delta_string
    kpis = kpi_summary(view, filters)
    yearly = trend(view, "Year", filters)
    ranked = yearly.select("Net_Revenue", "Profit",
                           F.row_number().over(Window.orderBy(F.col("Year").desc())).alias("_r"))
    second_last = ranked.filter(F.col("_r") == 2)
    joined = kpis.select("total_revenue", "total_profit",
                         second_last.select("Net_Revenue").scalar().alias("Net_Revenue"),
                         second_last.select("Profit").scalar().alias("Profit"))
    rev = delta_string(F.col("total_revenue"), F.col("Net_Revenue"), "YoY")
    prof = delta_string(F.col("total_profit"), F.col("Profit"), "YoY")
    return joined.select(rev["Delta_Text"].alias("Revenue_Delta"), rev["Sentiment"].alias("Revenue_Sentiment"),
                         prof["Delta_Text"].alias("Profit_Delta"), prof["Sentiment"].alias("Profit_Sentiment"))
