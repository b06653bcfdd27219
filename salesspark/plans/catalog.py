"""The named query catalogue: each entry reads the tables under ``sf_dir`` and
returns a lazy DataFrame; ``ORACLE`` holds the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salesspark.functions.filters import filter_columns
from salesspark.operators import metrics as M
from salesspark.plans.oracle import with_view
from salesspark.session import freed_shuffles
from salesspark.sources.coded import coded_lines, line_names
from salesspark.sources.tables import filter_frames, sales_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def view_for(spark: SparkSession, sf_dir: str, columns: list[str], filters: dict | None = None) -> DataFrame:
    """The sales view with only the columns an operator and its filters read."""
    return sales_view(spark, sf_dir, list(columns) + filter_columns(filters), keys_complete=True)


# ---------------------------------------------------------------- KPIs

_KPI_SQL_SELECT = """
SELECT *,
  CASE WHEN total_revenue = 0 THEN 0.0 ELSE (100.0 * total_profit) / total_revenue END AS profit_margin_pct,
  CASE WHEN total_orders = 0 THEN 0.0 ELSE total_revenue / CAST(total_orders AS DOUBLE) END AS avg_order_value,
  CASE WHEN total_line_items = 0 THEN 0.0
       ELSE (100.0 * CAST(returned_orders AS DOUBLE)) / CAST(total_line_items AS DOUBLE) END AS return_rate_pct
FROM (
  SELECT
    CAST(COALESCE(SUM(Net_Revenue), 0) AS DOUBLE) AS total_revenue,
    CAST(COALESCE(SUM(Profit_Amount), 0) AS DOUBLE) AS total_profit,
    CAST(COALESCE(SUM(Sales_Amount), 0) AS DOUBLE) AS gross_revenue,
    COUNT(DISTINCT Order_ID) AS total_orders,
    COUNT(DISTINCT Customer_Key) AS total_customers,
    COUNT(DISTINCT Product) AS total_products,
    CAST(COALESCE(SUM(Is_Returned), 0) AS BIGINT) AS returned_orders,
    COUNT(*) AS total_line_items
  FROM sales {where}
) t
"""

KPI_FILTERED = {"Region": "EUROPE", "Year": "1997", "Category": "All", "Unknown_Field": "x"}
KPI_IN_LIST = {"Channel": ["URGENT", "HIGH", "All"], "Segment": ("BUILDING", "MACHINERY"), "Quarter": []}


@register("kpi_summary", with_view(_KPI_SQL_SELECT.format(where="")))
def q_kpi_summary(spark, sf_dir):
    return M.kpi_summary(view_for(spark, sf_dir, M.KPI_COLUMNS))


@register("kpi_filtered", with_view(_KPI_SQL_SELECT.format(where="WHERE Region = 'EUROPE' AND Year = 1997")))
def q_kpi_filtered(spark, sf_dir):
    return M.kpi_summary(view_for(spark, sf_dir, M.KPI_COLUMNS, KPI_FILTERED), KPI_FILTERED)


@register("kpi_in_list", with_view(_KPI_SQL_SELECT.format(
    where="WHERE Channel IN ('URGENT', 'HIGH') AND Segment IN ('BUILDING', 'MACHINERY')")))
def q_kpi_in_list(spark, sf_dir):
    return M.kpi_summary(view_for(spark, sf_dir, M.KPI_COLUMNS, KPI_IN_LIST), KPI_IN_LIST)


# ---------------------------------------------------------------- breakdowns

def _breakdown_sql(dim: str, where: str = "", order: str = "Net_Revenue DESC", limit: int | None = None) -> str:
    lim = f"LIMIT {limit}" if limit else ""
    return with_view(f"""
SELECT {dim},
  CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue,
  CAST(SUM(Profit_Amount) AS DOUBLE) AS Profit,
  COUNT(DISTINCT Order_ID) AS Orders,
  SUM(Quantity) AS Units
FROM sales {where}
GROUP BY {dim}
ORDER BY {order} NULLS LAST, {dim} ASC NULLS FIRST
{lim}""")


@register("sales_by_region", _breakdown_sql("Region"))
def q_sales_by_region(spark, sf_dir):
    return M.sales_by_dimension(view_for(spark, sf_dir, ["Region"] + M.BREAKDOWN_COLUMNS), "Region")


@register("sales_by_state_top15", _breakdown_sql("State", limit=15))
def q_sales_by_state_top15(spark, sf_dir):
    return M.sales_by_dimension(view_for(spark, sf_dir, ["State"] + M.BREAKDOWN_COLUMNS), "State", limit=15)


@register("sales_by_salesperson", _breakdown_sql("Salesperson", order="Orders DESC"))
def q_sales_by_salesperson(spark, sf_dir):
    return M.sales_by_dimension(view_for(spark, sf_dir, ["Salesperson"] + M.BREAKDOWN_COLUMNS),
                                "Salesperson", metric="Orders")


@register("sales_by_channel_filtered", _breakdown_sql("Channel", where="WHERE Year = 1998 AND Region IN ('ASIA', 'EUROPE')"))
def q_sales_by_channel_filtered(spark, sf_dir):
    f = {"Year": 1998, "Region": ["ASIA", "EUROPE"]}
    return M.sales_by_dimension(view_for(spark, sf_dir, ["Channel"] + M.BREAKDOWN_COLUMNS, f), "Channel", f)


# ---------------------------------------------------------------- trends

_TREND_AGG = """
  CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue,
  CAST(SUM(Profit_Amount) AS DOUBLE) AS Profit,
  COUNT(DISTINCT Order_ID) AS Orders"""


@register("trend_month", with_view(f"""
SELECT Year, Month, Month_Name, {_TREND_AGG},
  CAST(Year AS VARCHAR) || '-' || lpad(CAST(Month AS VARCHAR), 2, '0') AS Period
FROM sales GROUP BY Year, Month, Month_Name ORDER BY Year, Month"""))
def q_trend_month(spark, sf_dir):
    return M.with_period(M.trend(view_for(spark, sf_dir, M.TREND_COLUMNS), "Month"), "Month")


@register("trend_quarter", with_view(f"""
SELECT Year, Quarter, {_TREND_AGG}, CAST(Year AS VARCHAR) || '-' || Quarter AS Period
FROM sales GROUP BY Year, Quarter ORDER BY Year, Quarter"""))
def q_trend_quarter(spark, sf_dir):
    return M.with_period(M.trend(view_for(spark, sf_dir, M.TREND_COLUMNS), "Quarter"), "Quarter")


@register("trend_year", with_view(f"""
SELECT Year, {_TREND_AGG} FROM sales GROUP BY Year ORDER BY Year"""))
def q_trend_year(spark, sf_dir):
    return M.trend(view_for(spark, sf_dir, M.TREND_COLUMNS), "Year")


# ---------------------------------------------------------------- top / bottom

@register("top_customers", with_view("""
SELECT Customer_Key, MIN(Customer) AS Customer, MIN(Segment) AS Segment,
  CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue,
  CAST(SUM(Profit_Amount) AS DOUBLE) AS Profit,
  COUNT(DISTINCT Order_ID) AS Orders
FROM sales GROUP BY Customer_Key
ORDER BY Net_Revenue DESC NULLS LAST, Customer_Key ASC LIMIT 20"""))
def q_top_customers(spark, sf_dir):
    return M.top_customers(view_for(spark, sf_dir, M.CUSTOMER_COLUMNS), 20)


_PRODUCT_SQL = """
SELECT Product, MIN(Category) AS Category,
  CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue,
  CAST(SUM(Profit_Amount) AS DOUBLE) AS Profit,
  SUM(Quantity) AS Units,
  (100.0 * CAST(SUM(Profit_Amount) AS DOUBLE)) / NULLIF(CAST(SUM(Sales_Amount) AS DOUBLE), 0) AS Margin_Pct
FROM sales GROUP BY Product
ORDER BY Net_Revenue {direction}, Product ASC LIMIT {n}"""


@register("top_products", with_view(_PRODUCT_SQL.format(direction="DESC NULLS LAST", n=20)))
def q_top_products(spark, sf_dir):
    return M.top_products(view_for(spark, sf_dir, M.PRODUCT_COLUMNS), 20)


@register("bottom_products", with_view(_PRODUCT_SQL.format(direction="ASC NULLS FIRST", n=10)))
def q_bottom_products(spark, sf_dir):
    return M.top_products(view_for(spark, sf_dir, M.PRODUCT_COLUMNS), 10, ascending=True)


@register("leaderboard", with_view("""
SELECT Salesperson_Key, MIN(Salesperson) AS Salesperson,
  CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue,
  CAST(SUM(Profit_Amount) AS DOUBLE) AS Profit,
  COUNT(DISTINCT Order_ID) AS Deals
FROM sales WHERE Salesperson IS NOT NULL GROUP BY Salesperson_Key
ORDER BY Net_Revenue DESC NULLS LAST, Salesperson_Key"""))
def q_leaderboard(spark, sf_dir):
    return M.salesperson_leaderboard(view_for(spark, sf_dir, M.LEADERBOARD_COLUMNS))


@register("top_selling_products", with_view("""
SELECT Product, CAST(SUM(Sales_Amount) AS DOUBLE) AS Sales_Amount
FROM sales GROUP BY Product ORDER BY Sales_Amount DESC NULLS LAST, Product LIMIT 50"""))
def q_top_selling_products(spark, sf_dir):
    return M.top_selling_products(view_for(spark, sf_dir, ["Product", "Sales_Amount"]), 50)


@register("filter_options", with_view("""
SELECT Filter, Value, TRY_CAST(Value AS DOUBLE) AS Sort_Key FROM (
  SELECT DISTINCT Filter, Value FROM (
    UNPIVOT (SELECT CAST(Region AS VARCHAR) AS Region, CAST(Country AS VARCHAR) AS Country,
                    CAST(State AS VARCHAR) AS State, CAST(City AS VARCHAR) AS City,
                    CAST(Year AS VARCHAR) AS Year, CAST(Quarter AS VARCHAR) AS Quarter,
                    CAST(Month AS VARCHAR) AS Month, CAST(Category AS VARCHAR) AS Category,
                    CAST(Sub_Category AS VARCHAR) AS Sub_Category, CAST(Customer AS VARCHAR) AS Customer,
                    CAST(Salesperson AS VARCHAR) AS Salesperson, CAST(Product AS VARCHAR) AS Product,
                    CAST(Channel AS VARCHAR) AS Channel, CAST(Segment AS VARCHAR) AS Segment
             FROM sales)
    ON COLUMNS(*) INTO NAME Filter VALUE Value)
  WHERE Value IS NOT NULL) t"""))
def q_filter_options(spark, sf_dir):
    return M.filter_options(filter_frames(spark, sf_dir))


# ---------------------------------------------------------------- ABC, Pareto, bands, shares

from salesspark.operators import distribution as D  # noqa: E402

_ABC_SQL = with_view("""
SELECT Rank, Product, Category, Net_Revenue, Cumulative_Revenue, Cumulative_Pct,
  CASE WHEN Cumulative_Pct > -0.01 AND Cumulative_Pct <= 70 THEN 'A'
       WHEN Cumulative_Pct > 70 AND Cumulative_Pct <= 90 THEN 'B'
       WHEN Cumulative_Pct > 90 AND Cumulative_Pct <= 100.01 THEN 'C' END AS ABC_Class
FROM (
  SELECT Rank, Product, Category, CAST(rev AS DOUBLE) AS Net_Revenue, CAST(cum AS DOUBLE) AS Cumulative_Revenue,
    CASE WHEN CAST(total AS DOUBLE) <> 0 THEN (100.0 * CAST(cum AS DOUBLE)) / CAST(total AS DOUBLE) ELSE 0.0 END
      AS Cumulative_Pct
  FROM (
    SELECT Product, Category, rev,
      SUM(rev) OVER (ORDER BY rev DESC NULLS LAST, Product ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
      ROW_NUMBER() OVER (ORDER BY rev DESC NULLS LAST, Product) AS Rank,
      SUM(rev) OVER () AS total
    FROM prod) r) c
ORDER BY Rank""", """
prod AS (SELECT Product, MIN(Category) AS Category, SUM(Net_Revenue) AS rev FROM sales GROUP BY Product)""")


@register("abc", _ABC_SQL)
def q_abc(spark, sf_dir):
    return D.abc_analysis(view_for(spark, sf_dir, D.ABC_COLUMNS))


@register("abc_summary", _ABC_SQL.replace("ORDER BY Rank", "").replace("WITH sales AS", "WITH sales AS", 1)
          .replace("\nSELECT Rank, Product, Category, Net_Revenue, Cumulative_Revenue, Cumulative_Pct,",
                   ", abc AS (SELECT Rank, Product, Category, Net_Revenue, Cumulative_Revenue, Cumulative_Pct,", 1)
          + """)
SELECT ABC_Class, COUNT(Product) AS Num_Products, SUM(Net_Revenue) AS Total_Revenue,
  round((100.0 * SUM(Net_Revenue)) / NULLIF(SUM(SUM(Net_Revenue)) OVER (), 0), 1) AS Pct_Of_Revenue
FROM abc WHERE ABC_Class IS NOT NULL GROUP BY ABC_Class ORDER BY ABC_Class""")
def q_abc_summary(spark, sf_dir):
    return D.abc_summary(D.abc_analysis(view_for(spark, sf_dir, D.ABC_COLUMNS)))


_PARETO_CTE = """
cust AS (SELECT Customer_Key, MIN(Customer) AS Customer, SUM(Net_Revenue) AS rev FROM sales GROUP BY Customer_Key),
curve AS (
  SELECT Rank, Customer_Key, Customer, CAST(rev AS DOUBLE) AS Net_Revenue,
    (100.0 * CAST(cum AS DOUBLE)) / NULLIF(CAST(total AS DOUBLE), 0) AS Cumulative_Pct,
    (100.0 * Rank) / n AS Customer_Rank_Pct
  FROM (
    SELECT Customer_Key, Customer, rev,
      SUM(rev) OVER (ORDER BY rev DESC NULLS LAST, Customer_Key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
      ROW_NUMBER() OVER (ORDER BY rev DESC NULLS LAST, Customer_Key) AS Rank,
      SUM(rev) OVER () AS total,
      COUNT(*) OVER () AS n
    FROM cust) r)"""


@register("pareto_curve", with_view("SELECT * FROM curve ORDER BY Rank", _PARETO_CTE))
def q_pareto_curve(spark, sf_dir):
    return D.pareto_curve(view_for(spark, sf_dir, D.PARETO_COLUMNS))


@register("pareto_top20", with_view("""
SELECT COUNT(*) AS Customers, CAST(floor(COUNT(*) * 0.2) AS BIGINT) AS Top_Customers,
  CASE WHEN SUM(Net_Revenue) IS NULL OR SUM(Net_Revenue) = 0 THEN 0.0
       ELSE (100.0 * SUM(CASE WHEN Rank <= floor(n * 0.2) THEN Net_Revenue ELSE 0.0 END)) / SUM(Net_Revenue) END
    AS Top_Share_Pct
FROM (SELECT *, COUNT(*) OVER () AS n FROM curve) c""", _PARETO_CTE))
def q_pareto_top20(spark, sf_dir):
    return D.pareto_top_share(D.pareto_curve(view_for(spark, sf_dir, D.PARETO_COLUMNS)), 0.2)


def _bands_sql(edges, labels, where=""):
    lo, whens = "-0.01", []
    for hi, label in zip(edges, labels):
        whens.append(f"WHEN Discount_Amount * 100 > CAST({lo} AS DECIMAL(10,4)) * d "
                     f"AND Discount_Amount * 100 <= CAST({hi} AS DECIMAL(10,4)) * d THEN '{label}'")
        lo = str(hi)
    band = "CASE " + " ".join(whens) + " END"
    return with_view(f"""
SELECT Discount_Band, Line_Items, Total_Discount, Total_Profit,
  round(rr * 100.0, 2) AS Return_Rate,
  round(Total_Profit / CASE WHEN Total_Discount = 0 THEN 1.0 ELSE Total_Discount END, 2) AS Profit_Per_Discount_Rupee
FROM (
  SELECT Discount_Band, COUNT(Sales_Amount) AS Line_Items,
    CAST(SUM(Discount_Amount) AS DOUBLE) AS Total_Discount, CAST(SUM(Profit_Amount) AS DOUBLE) AS Total_Profit,
    AVG(Is_Returned) AS rr
  FROM (SELECT *, {band} AS Discount_Band
        FROM (SELECT *, CASE WHEN Sales_Amount = 0 THEN 1 ELSE Sales_Amount END AS d FROM sales {where}) s) b
  WHERE Discount_Band IS NOT NULL GROUP BY Discount_Band) t
ORDER BY Discount_Band""")


BAND_TEST_EDGES = (2.5, 5, 7.5, 100)


@register("discount_bands", _bands_sql(BAND_TEST_EDGES, D.band_labels(BAND_TEST_EDGES)))
def q_discount_bands(spark, sf_dir):
    return D.discount_bands(view_for(spark, sf_dir, D.BAND_COLUMNS), edges=BAND_TEST_EDGES)


@register("discount_bands_default", _bands_sql(D.DISCOUNT_BAND_EDGES, D.band_labels(D.DISCOUNT_BAND_EDGES)))
def q_discount_bands_default(spark, sf_dir):
    return D.discount_bands(view_for(spark, sf_dir, D.BAND_COLUMNS))


_BREAKDOWN_CTE = """
bd AS (SELECT {dim}, CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue, CAST(SUM(Profit_Amount) AS DOUBLE) AS Profit,
         COUNT(DISTINCT Order_ID) AS Orders, SUM(Quantity) AS Units FROM sales GROUP BY {dim})"""


@register("category_margin", with_view("""
SELECT *, round((100.0 * Profit) / NULLIF(Net_Revenue, 0), 2) AS Margin_Pct FROM bd
ORDER BY Net_Revenue DESC NULLS LAST, Category""", _BREAKDOWN_CTE.format(dim="Category")))
def q_category_margin(spark, sf_dir):
    return D.category_margin(view_for(spark, sf_dir, ["Category"] + M.BREAKDOWN_COLUMNS))


@register("region_share", with_view("""
SELECT *, (100.0 * Net_Revenue) / NULLIF(SUM(Net_Revenue) OVER (), 0) AS Share_Pct FROM bd
ORDER BY Net_Revenue DESC NULLS LAST, Region""", _BREAKDOWN_CTE.format(dim="Region")))
def q_region_share(spark, sf_dir):
    return D.share_by_dimension(view_for(spark, sf_dir, ["Region"] + M.BREAKDOWN_COLUMNS), "Region")


@register("segment_aov", with_view("""
SELECT *, round(Net_Revenue / CAST(NULLIF(Orders, 0) AS DOUBLE), 0) AS Avg_Order_Value FROM bd
ORDER BY Net_Revenue DESC NULLS LAST, Segment""", _BREAKDOWN_CTE.format(dim="Segment")))
def q_segment_aov(spark, sf_dir):
    return M.breakdown_aov(M.sales_by_dimension(view_for(spark, sf_dir, ["Segment"] + M.BREAKDOWN_COLUMNS), "Segment"))


@register("yoy", with_view("""
SELECT Year, Net_Revenue, Profit, Orders, Prev_Year, Prev_Net_Revenue,
  CASE WHEN Prev_Net_Revenue IS NULL THEN NULL WHEN Prev_Net_Revenue = 0 THEN 0.0
       ELSE ((Net_Revenue - Prev_Net_Revenue) / Prev_Net_Revenue) * 100.0 END AS YoY_Growth_Pct,
  CASE WHEN Prev_Net_Revenue IS NULL THEN NULL
       WHEN (CASE WHEN Prev_Net_Revenue = 0 THEN 0.0
                  ELSE ((Net_Revenue - Prev_Net_Revenue) / Prev_Net_Revenue) * 100.0 END) >= 0 THEN 'grew'
       ELSE 'declined' END AS Direction
FROM (
  SELECT Year, Net_Revenue, Profit, Orders, LAG(Year) OVER (ORDER BY Year) AS Prev_Year,
    LAG(Net_Revenue) OVER (ORDER BY Year) AS Prev_Net_Revenue
  FROM (SELECT Year, CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue, CAST(SUM(Profit_Amount) AS DOUBLE) AS Profit,
          COUNT(DISTINCT Order_ID) AS Orders FROM sales GROUP BY Year) y) t
ORDER BY Year"""))
def q_yoy(spark, sf_dir):
    return D.year_over_year(view_for(spark, sf_dir, M.TREND_COLUMNS))


# ---------------------------------------------------------------- customers and churn

from salesspark.operators import customers as C  # noqa: E402
from salesspark.operators import basket as B  # noqa: E402


@register("customer_features", with_view("""
SELECT Customer_Key, Customer, Segment, Frequency, Monetary, Total_Profit, Customer_Rating,
  CAST(date_diff('day', _last, MAX(_last) OVER ()) AS DOUBLE) AS Recency_Days,
  CAST(date_diff('day', _first, _last) AS DOUBLE) AS Tenure_Days
FROM (
  SELECT Customer_Key, Customer, Segment, COUNT(DISTINCT Order_ID) AS Frequency,
    CAST(SUM(Net_Revenue) AS DOUBLE) AS Monetary, CAST(SUM(Profit_Amount) AS DOUBLE) AS Total_Profit,
    MIN(Order_Date) AS _first, MAX(Order_Date) AS _last, CAST(SUM(CAST(Customer_Rating AS DECIMAL(20,10))) AS DOUBLE) / CAST(COUNT(Customer_Rating) AS DOUBLE) AS Customer_Rating
  FROM sales GROUP BY Customer_Key, Customer, Segment) t"""))
def q_customer_features(spark, sf_dir):
    return C.customer_features(view_for(spark, sf_dir, C.FEATURE_COLUMNS))


_CHURN_CTE = """
cut AS (SELECT MAX(Order_Date) - INTERVAL 180 DAY AS cutoff FROM sales),
pre AS (SELECT Customer_Key, COUNT(DISTINCT Order_ID) AS Frequency, CAST(SUM(Net_Revenue) AS DOUBLE) AS Monetary,
          CAST(SUM(CAST(Customer_Rating AS DECIMAL(20,10))) AS DOUBLE) / CAST(COUNT(Customer_Rating) AS DOUBLE) AS Customer_Rating, MIN(Order_Date) AS _first, MAX(Order_Date) AS _last
        FROM sales, cut WHERE Order_Date <= cutoff GROUP BY Customer_Key),
post AS (SELECT DISTINCT Customer_Key FROM sales, cut WHERE Order_Date > cutoff),
churn AS (
  SELECT pre.Customer_Key, Frequency, Monetary, Customer_Rating,
    Monetary / CAST(CASE WHEN Frequency = 0 THEN 1 ELSE Frequency END AS DOUBLE) AS Avg_Order_Value,
    CAST(date_diff('day', _first, _last) AS INTEGER) AS Tenure_Days,
    CASE WHEN post.Customer_Key IS NULL THEN 1 ELSE 0 END AS Churned
  FROM pre LEFT JOIN post ON pre.Customer_Key = post.Customer_Key)"""


@register("churn_dataset", with_view("SELECT * FROM churn", _CHURN_CTE))
def q_churn_dataset(spark, sf_dir):
    return C.churn_dataset(view_for(spark, sf_dir, C.CHURN_COLUMNS))


_SPLIT_CTE = """
cls AS (SELECT Churned, COUNT(*) AS n FROM churn GROUP BY Churned),
tot AS (SELECT CAST(SUM(n) AS BIGINT) AS total, (CAST(SUM(n) AS BIGINT) * 25 + 99) // 100 AS test FROM cls),
share AS (SELECT Churned, test * n // total AS whole, test * n % total AS rest, test FROM cls, tot),
quota AS (SELECT Churned, whole + CASE WHEN ROW_NUMBER() OVER (ORDER BY rest DESC, Churned) <= test - SUM(whole) OVER ()
                                       THEN 1 ELSE 0 END AS q FROM share),
split AS (SELECT churn.*, CASE WHEN ROW_NUMBER() OVER (PARTITION BY churn.Churned
            ORDER BY md5(CAST(Customer_Key AS VARCHAR)), Customer_Key) <= q THEN 'test' ELSE 'train' END AS Split
          FROM churn JOIN quota ON quota.Churned = churn.Churned)"""


@register("churn_split", with_view("SELECT Customer_Key, Churned, Split FROM split", _CHURN_CTE, _SPLIT_CTE))
def q_churn_split(spark, sf_dir):
    return C.holdout_split(C.churn_dataset(view_for(spark, sf_dir, C.CHURN_COLUMNS))).select("Customer_Key", "Churned", "Split")


# ---------------------------------------------------------------- co-purchase

@register("copurchase_top5", with_view("""
SELECT Product, CAST(Rank AS INTEGER) AS Rank, Recommended_Product, Co_Orders, round(s, 3) AS Similarity_Score FROM (
  SELECT p AS Product, q AS Recommended_Product, co AS Co_Orders, s,
    ROW_NUMBER() OVER (PARTITION BY p ORDER BY s DESC, q) AS Rank
  FROM (SELECT p, q, co, co / sqrt(CAST(ca.n AS DOUBLE) * cb.n) AS s
        FROM pairs JOIN cnt ca ON ca.Product = p JOIN cnt cb ON cb.Product = q) x) r
WHERE Rank <= 5
UNION ALL
SELECT Product, CAST(k + i AS INTEGER) AS Rank, Recommended_Product, 0 AS Co_Orders, 0.0 AS Similarity_Score FROM (
  SELECT s.Product, s.k, f.Product AS Recommended_Product,
    ROW_NUMBER() OVER (PARTITION BY s.Product ORDER BY f.Product) AS i
  FROM (SELECT c.Product, COALESCE(LEAST(d.deg, 5), 0) AS k FROM cnt c
        LEFT JOIN (SELECT p, COUNT(*) AS deg FROM pairs GROUP BY p) d ON d.p = c.Product) s
  JOIN (SELECT Product FROM cnt ORDER BY Product LIMIT 10) f ON f.Product <> s.Product
  WHERE s.k < 5 AND NOT EXISTS (SELECT 1 FROM pairs WHERE p = s.Product AND q = f.Product)) t
WHERE i <= 5 - k""", """
basket AS (SELECT DISTINCT Order_ID, Product FROM sales)""", """
cnt AS (SELECT Product, COUNT(*) AS n FROM basket GROUP BY Product)""", """
pairs AS (SELECT a.Product AS p, b.Product AS q, COUNT(*) AS co
          FROM basket a JOIN basket b ON a.Order_ID = b.Order_ID AND a.Product <> b.Product GROUP BY 1, 2)"""))
def q_copurchase_top5(spark, sf_dir):
    return B.copurchase_top(view_for(spark, sf_dir, B.BASKET_COLUMNS), 5)


# ---------------------------------------------------------------- forecast

from salesspark.operators import forecast as FC  # noqa: E402


def _forecast_ctes(series_expr: str, horizon: int = 6) -> tuple[str, ...]:
    return (f"""
monthly AS (SELECT {series_expr} AS Series, Year, Month, CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue
            FROM sales GROUP BY 1, 2, 3)""", """
base AS (
  SELECT *, AVG(t) OVER (PARTITION BY Series, Month) AS tm, AVG(Net_Revenue) OVER (PARTITION BY Series, Month) AS ym,
         AVG(t) OVER (PARTITION BY Series) AS tbar, AVG(Net_Revenue) OVER (PARTITION BY Series) AS ybar
  FROM (SELECT *, (Year - fy) * 12 + Month AS t
        FROM (SELECT *, MIN(Year) OVER (PARTITION BY Series) AS fy, COUNT(*) OVER (PARTITION BY Series) AS nrows
              FROM monthly) a WHERE nrows >= 12) b)""", """
ser AS (
  SELECT Series,
    CASE WHEN SUM((t - tm) * (t - tm)) > 0 THEN SUM((t - tm) * (Net_Revenue - ym)) / SUM((t - tm) * (t - tm))
         ELSE SUM((t - tbar) * (Net_Revenue - ybar)) / (1.0 + SUM((t - tbar) * (t - tbar))) END AS Slope,
    MIN(fy) AS fy, MAX(t) AS last_t
  FROM base GROUP BY Series)""", """
lev AS (SELECT l.Series, l.Month, l.ym - s.Slope * l.tm AS level
        FROM (SELECT DISTINCT Series, Month, tm, ym FROM base) l JOIN ser s ON s.Series = l.Series)""", """
ml AS (SELECT Series, AVG(level) AS mean_level FROM lev GROUP BY Series)""", f"""
fut AS (
  SELECT Series, Slope, fy, mean_level, t, CAST(((t - 1) % 12) + 1 AS INTEGER) AS Month
  FROM (SELECT s.Series, s.Slope, s.fy, m.mean_level, unnest(generate_series(s.last_t + 1, s.last_t + {horizon})) AS t
        FROM ser s JOIN ml m ON m.Series = s.Series) g)""", """
combined AS (
  SELECT Series, Year, Month, Net_Revenue, 'Actual' AS Type FROM base
  UNION ALL
  SELECT f.Series, CAST(f.fy + (f.t - f.Month) // 12 AS INTEGER) AS Year, f.Month,
    round(GREATEST(COALESCE(l.level, f.mean_level) + f.Slope * f.t, 0.0), 2) AS Net_Revenue, 'Forecast' AS Type
  FROM fut f LEFT JOIN lev l ON l.Series = f.Series AND l.Month = f.Month)""")


_FORECAST_SELECT = """
SELECT Series, Year, Month, CAST(Year AS VARCHAR) || '-' || lpad(CAST(Month AS VARCHAR), 2, '0') AS Period,
  Net_Revenue, Type FROM combined ORDER BY Series, Type, Year, Month"""


def _rounded(series):
    """Forecast values to 2 places; history as it is."""
    value = _F.when(_F.col("Type") == "Forecast", _F.round("Net_Revenue", 2)).otherwise(_F.col("Net_Revenue"))
    return series.withColumn("Net_Revenue", value)


@register("forecast_total", with_view(_FORECAST_SELECT, *_forecast_ctes("'All'")))
def q_forecast_total(spark, sf_dir):
    return _rounded(FC.forecast(FC.monthly_series(view_for(spark, sf_dir, FC.SERIES_COLUMNS)), 6)[0])


@register("forecast_by_region", with_view(_FORECAST_SELECT, *_forecast_ctes("Region")))
def q_forecast_by_region(spark, sf_dir):
    return _rounded(FC.forecast(FC.monthly_series(view_for(spark, sf_dir, FC.SERIES_COLUMNS + ["Region"]), "Region"), 6)[0])


@register("forecast_error", with_view(f"""
SELECT Series, COUNT(*) AS Months, round(MIN(Slope), 2) AS Slope, round(AVG(e), 2) AS MAE,
  round(AVG(e / GREATEST(ABS(Net_Revenue), {FC.EPS!r})) * 100.0, 4) AS MAPE
FROM (SELECT b.Series, b.Net_Revenue, s.Slope, ABS(b.Net_Revenue - (l.level + s.Slope * b.t)) AS e
      FROM base b JOIN lev l ON l.Series = b.Series AND l.Month = b.Month JOIN ser s ON s.Series = b.Series) x
GROUP BY Series ORDER BY Series""", *_forecast_ctes("Region")))
def q_forecast_error(spark, sf_dir):
    errors = FC.forecast(FC.monthly_series(view_for(spark, sf_dir, FC.SERIES_COLUMNS + ["Region"]), "Region"), 6)[1]
    return errors.select("Series", "Months", _F.round("Slope", 2).alias("Slope"), _F.round("MAE", 2).alias("MAE"),
                         _F.round("MAPE", 4).alias("MAPE"))


# ---------------------------------------------------------------- formatting and narrative

from pyspark.sql import Window as _W  # noqa: E402
from pyspark.sql import functions as _F  # noqa: E402

from salesspark.functions import scalars as X  # noqa: E402
from salesspark.operators import insights as N  # noqa: E402
from salesspark.plans.oracle import sql_count, sql_inr, sql_pct, sql_safe_div  # noqa: E402


@register("money_text", with_view(f"""
SELECT Region, Net_Revenue, {sql_inr('Net_Revenue')} AS Revenue_Text, {sql_inr('Net_Revenue', 'Rs. ')} AS Revenue_Text_Ascii,
  {sql_inr('Profit')} AS Profit_Text, {sql_count('Orders')} AS Orders_Text,
  {sql_pct('m')} AS Margin_Text
FROM (SELECT *, (100.0 * Profit) / NULLIF(Net_Revenue, 0) AS m FROM bd) t""",
                                  _BREAKDOWN_CTE.format(dim="Region")))
def q_money_text(spark, sf_dir):
    bd = M.sales_by_dimension(view_for(spark, sf_dir, ["Region"] + M.BREAKDOWN_COLUMNS), "Region")
    margin = _F.try_divide(_F.lit(100.0) * _F.col("Profit"), _F.col("Net_Revenue"))
    return bd.select("Region", "Net_Revenue", X.format_inr("Net_Revenue").alias("Revenue_Text"),
                     X.format_inr_ascii("Net_Revenue").alias("Revenue_Text_Ascii"),
                     X.format_inr("Profit").alias("Profit_Text"), X.format_count("Orders").alias("Orders_Text"),
                     X.format_pct(margin).alias("Margin_Text"))


@register("delta_text", with_view("""
SELECT Year, Month_Name, Short_Name,
  CASE WHEN p IS NULL OR isnan(p) OR p = 0 OR c IS NULL THEN 'n/a'
       ELSE trim((CASE WHEN 100.0 * (c - p) / p >= 0 THEN '▲' ELSE '▼' END) || ' ' || printf('%.1f', abs(100.0 * (c - p) / p)) || '% YoY') END
    AS Delta_Text,
  CASE WHEN p IS NULL OR isnan(p) OR p = 0 OR c IS NULL THEN 'neutral'
       WHEN 100.0 * (c - p) / p >= 0 THEN 'pos' ELSE 'neg' END AS Sentiment
FROM (SELECT Year, Month AS m, Month_Name, ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][Month] AS Short_Name,
        c, LAG(c) OVER (ORDER BY Year, Month) AS p
      FROM (SELECT Year, Month, Month_Name, CAST(SUM(Net_Revenue) AS DOUBLE) AS c FROM sales GROUP BY 1, 2, 3) a) t"""))
def q_delta_text(spark, sf_dir):
    monthly = M.trend(view_for(spark, sf_dir, M.TREND_COLUMNS), "Month")
    prev = _F.lag("Net_Revenue").over(_W.orderBy("Year", "Month"))
    d = X.delta_string(_F.col("Net_Revenue"), prev, "YoY")
    return monthly.select("Year", "Month_Name", X.month_short_name("Month").alias("Short_Name"),
                          d["Delta_Text"].alias("Delta_Text"), d["Sentiment"].alias("Sentiment"))


_INSIGHT_SQL = with_view(f"""
SELECT 1 AS Insight_ID, 'yoy_growth_pct' AS Metric, growth AS Value,
  'Net revenue ' || CASE WHEN growth >= 0 THEN 'grew' ELSE 'declined' END || ' ' || printf('%.1f', abs(growth))
  || '% in ' || CAST(y AS VARCHAR) || ' versus ' || CAST(py AS VARCHAR) || ', closing the year at ' || {sql_inr('c')} || '.'
  AS Text
FROM (SELECT *, ({sql_safe_div('c - p', 'p')}) * 100.0 AS growth FROM pair WHERE n = 2) g
UNION ALL
SELECT 2, 'profit_margin_pct', profit_margin_pct,
  'Overall profit margin stands at ' || {sql_pct('profit_margin_pct')} || ' on ' || {sql_inr('total_revenue')}
  || ' in net revenue -- ' || CASE WHEN profit_margin_pct >= 15 THEN 'a healthy margin'
                                   ELSE 'a margin worth monitoring closely' END || '.'
FROM kpi
UNION ALL
SELECT 3, 'leading_region_share_pct', share,
  COALESCE(region, 'None') || ' is the leading region, contributing ' || {sql_pct('share')} || ' of total revenue ('
  || {sql_inr('top')} || ').'
FROM (SELECT *, ({sql_safe_div('top', 'total')}) * 100.0 AS share FROM lead WHERE n > 0) l
UNION ALL
SELECT 4, 'class_a_revenue_pct', pr,
  'Just ' || printf('%.0f', pp) || '% of products (Class A) generate ' || printf('%.0f', pr)
  || '% of revenue -- a concentration worth protecting with supply-chain priority.'
FROM (SELECT ({sql_safe_div('na', 'n')}) * 100.0 AS pp, ({sql_safe_div('reva', 'rev')}) * 100.0 AS pr
      FROM conc WHERE n > 0) c
UNION ALL
SELECT 5, 'return_rate_pct', return_rate_pct,
  CASE WHEN return_rate_pct > 8 THEN 'Return rate is elevated at ' || {sql_pct('return_rate_pct')}
         || ' -- worth cross-checking against discount depth, a pattern previously linked to return spikes in this dataset.'
       ELSE 'Return rate is within a normal range at ' || {sql_pct('return_rate_pct')} || '.' END
FROM kpi
ORDER BY Insight_ID""", f"kpi AS ({_KPI_SQL_SELECT.format(where='')})", """
pair AS (
  SELECT MAX(CASE WHEN r = 1 THEN Year END) AS y, MAX(CASE WHEN r = 1 THEN Net_Revenue END) AS c,
         MAX(CASE WHEN r = 2 THEN Year END) AS py, MAX(CASE WHEN r = 2 THEN Net_Revenue END) AS p, COUNT(*) AS n
  FROM (SELECT Year, Net_Revenue, ROW_NUMBER() OVER (ORDER BY Year DESC) AS r
        FROM (SELECT Year, CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue FROM sales GROUP BY Year) y) t
  WHERE r <= 2)""", """
rg AS (SELECT Region, CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue FROM sales GROUP BY Region)""", """
lead AS (
  SELECT (SELECT Region FROM rg ORDER BY Net_Revenue DESC NULLS LAST, Region ASC NULLS FIRST LIMIT 1) AS region,
         MAX(Net_Revenue) AS top, SUM(Net_Revenue) AS total, COUNT(*) AS n
  FROM rg)""", """
prod AS (SELECT Product, MIN(Category) AS Category, SUM(Net_Revenue) AS rev FROM sales GROUP BY Product)""", """
abc AS (
  SELECT CAST(rev AS DOUBLE) AS Net_Revenue,
    CASE WHEN pc > -0.01 AND pc <= 70 THEN 'A' WHEN pc > 70 AND pc <= 90 THEN 'B'
         WHEN pc > 90 AND pc <= 100.01 THEN 'C' END AS ABC_Class
  FROM (SELECT rev, CASE WHEN CAST(total AS DOUBLE) <> 0 THEN (100.0 * CAST(cum AS DOUBLE)) / CAST(total AS DOUBLE)
                         ELSE 0.0 END AS pc
        FROM (SELECT rev, SUM(rev) OVER (ORDER BY rev DESC NULLS LAST, Product
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
                     SUM(rev) OVER () AS total FROM prod) a) b)""", """
conc AS (
  SELECT COUNT(*) AS n, COUNT(CASE WHEN ABC_Class = 'A' THEN 1 END) AS na, SUM(Net_Revenue) AS rev,
         SUM(CASE WHEN ABC_Class = 'A' THEN Net_Revenue ELSE 0.0 END) AS reva
  FROM abc)""")


@register("insights", _INSIGHT_SQL)
def q_insights(spark, sf_dir):
    return N.executive_summary(view_for(spark, sf_dir, N.INSIGHT_COLUMNS))


# ---------------------------------------------------------------- questions

from salesspark.operators import questions as Q  # noqa: E402
from salesspark.schema import MONTH_NAMES  # noqa: E402
from salesspark.sources.tables import read_table  # noqa: E402


def _user_questions(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").filter(_F.col("role") == "user").select("conv_id", "turn", "text")


def _parsed(spark, sf_dir):
    vocab = Q.vocabulary(filter_frames(spark, sf_dir))
    return Q.parse_questions(_user_questions(spark, sf_dir), vocab)


def _sql_any(words):
    return " OR ".join(f"contains(low, '{w}')" for w in words)


def _parse_ctes(source: str, keys: list[str]) -> tuple[str, ...]:
    """CTEs ``voc`` and ``parsed`` (keys, Metric, Dimension, 7 filters, Recognized_Terms) over a
    CTE ``source`` with the key columns and ``low`` (lower-cased text)."""
    metric = "CASE " + " ".join(f"WHEN {_sql_any(ws)} THEN '{m}'" for m, ws in Q.METRIC_KEYWORDS.items()) + " END"
    dim = "CASE " + " ".join(f"WHEN {_sql_any(ws)} THEN '{d}'" for d, ws in Q.DIMENSION_PHRASES.items()) + " END"
    months = [m.lower() for m in MONTH_NAMES]
    month = "CASE " + " ".join(f"WHEN contains(low, '{m}') THEN {i + 1}" for i, m in enumerate(months)) + " END"
    vocab = " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS f, CAST({f} AS VARCHAR) AS v FROM sales WHERE {f} IS NOT NULL"
                               for f in Q.VOCAB_FIELDS)
    picks = ",\n  ".join(f"(SELECT MIN(v) FROM voc WHERE f = '{f}' AND contains(q.low, lower(v))) AS {f}"
                         for f in Q.VOCAB_FIELDS)
    k = ", ".join(keys)
    parsed = f"""
parsed AS (
SELECT {k}, COALESCE(mh, 'Net_Revenue') AS Metric, Dimension, Region, Category, Channel, Segment,
  Quarter, Year, Month,
  concat_ws(', ', mh, 'Region=' || Region, 'Category=' || Category, 'Channel=' || Channel, 'Segment=' || Segment,
            'Quarter=' || Quarter, 'Year=' || CAST(Year AS VARCHAR),
            'Month=' || upper(substr(mname, 1, 1)) || substr(mname, 2)) AS Recognized_Terms
FROM (
  SELECT {k}, {metric} AS mh, {dim} AS Dimension,
  {picks},
  CASE WHEN regexp_extract(low, '{Q.QUARTER_PATTERN}', 1) <> ''
       THEN 'Q' || regexp_extract(low, '{Q.QUARTER_PATTERN}', 1) END AS Quarter,
  CASE WHEN regexp_extract(low, '{Q.YEAR_PATTERN}', 1) <> ''
       THEN CAST(regexp_extract(low, '{Q.YEAR_PATTERN}', 1) AS INTEGER) END AS Year,
  CAST({month} AS INTEGER) AS Month,
  ['{"', '".join(months)}'][{month}] AS mname
  FROM {source} q) p)"""
    return f"voc AS ({vocab})", parsed


def _question_parse_sql() -> str:
    return with_view("SELECT * FROM parsed",
                     "q AS (SELECT conv_id, turn, lower(text) AS low FROM conversations WHERE role = 'user')",
                     *_parse_ctes("q", ["conv_id", "turn"]))


@register("question_parse", _question_parse_sql())
def q_question_parse(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    return p.select("conv_id", "turn", "Metric", "Dimension", *Q.FILTER_FIELDS,
                    _F.concat_ws(", ", "Recognized_Terms").alias("Recognized_Terms"))


@register("question_answers")
def q_question_answers(spark, sf_dir):
    with freed_shuffles(spark):
        parsed, names = _parsed(spark, sf_dir), line_names(spark, sf_dir)
    with coded_lines(spark, sf_dir, Q.ANSWER_COLUMNS, names) as view:
        return Q.answer_questions(parsed, view, ["conv_id", "turn"], names)


# ---------------------------------------------------------------- models

from salesspark.operators import anomaly as AN  # noqa: E402
from salesspark.operators import churn as CH  # noqa: E402
from salesspark.plans import churn_sql  # noqa: E402
from salesspark.operators import segments as SG  # noqa: E402

_FEATURES_CTE = """
feat AS (
  SELECT Customer_Key, Customer, Segment, Frequency, Monetary,
    CAST(date_diff('day', _last, MAX(_last) OVER ()) AS DOUBLE) AS Recency_Days
  FROM (SELECT Customer_Key, Customer, Segment, COUNT(DISTINCT Order_ID) AS Frequency,
          CAST(SUM(Net_Revenue) AS DOUBLE) AS Monetary, MAX(Order_Date) AS _last
        FROM sales GROUP BY Customer_Key, Customer, Segment) t)"""


@register("rfm_scores", with_view("""
SELECT Customer_Key, Recency_Days, Frequency, Monetary, round(zr, 6) AS Z_Recency, round(zf, 6) AS Z_Frequency,
  round(zm, 6) AS Z_Monetary, round((zr + zf + zm) / 3, 6) AS Composite_Score
FROM (
  SELECT Customer_Key, Recency_Days, Frequency, Monetary,
    (-Recency_Days - AVG(-Recency_Days) OVER ()) / COALESCE(NULLIF(STDDEV_POP(-Recency_Days) OVER (), 0), 1.0) AS zr,
    (Frequency - AVG(CAST(Frequency AS DOUBLE)) OVER ())
      / COALESCE(NULLIF(STDDEV_POP(CAST(Frequency AS DOUBLE)) OVER (), 0), 1.0) AS zf,
    (Monetary - AVG(Monetary) OVER ()) / COALESCE(NULLIF(STDDEV_POP(Monetary) OVER (), 0), 1.0) AS zm
  FROM feat) z""", _FEATURES_CTE))
def q_rfm_scores(spark, sf_dir):
    s = SG.rfm_scores(C.customer_features(view_for(spark, sf_dir, C.FEATURE_COLUMNS)))
    return s.select("Customer_Key", "Recency_Days", "Frequency", "Monetary",
                    *[_F.round(c, 6).alias(c) for c in SG.Z + ["Composite_Score"]])


def _segments_ctes(k: int = 4, restarts: int = 10, seed: int = 42, max_iter: int = 300) -> list[str]:
    """k-means as a recursive CTE over all restarts; ``seg`` has each customer's cluster and label."""
    def z(x):
        return f"({x} - AVG({x}) OVER ()) / COALESCE(NULLIF(STDDEV_POP({x}) OVER (), 0), 1.0)"
    unit = "CAST(round({} * 1000000) AS BIGINT) + 1000000000"
    d = "(p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y) + (p.z - w.z) * (p.z - w.z)"
    moved = ", ".join(f"COALESCE((2 * s.{v} + s.n) // (2 * s.n), w.{v}) AS n{v}" for v in "xyz")
    draw = "CAST('0x' || substr(md5('{seed}|' || r || '|{step}'), 1, 13) AS HUGEINT)"
    seeds = [f"""
s1 AS MATERIALIZED (SELECT r, 1 AS c, x, y, z FROM (SELECT t.r, p.x, p.y, p.z,
    ROW_NUMBER() OVER (PARTITION BY t.r ORDER BY md5('{seed}|' || t.r || '|' || Customer_Key), Customer_Key) AS nth
  FROM pts p, range(0, {restarts}) AS t(r)) a WHERE nth = 1)"""]
    for step in range(1, k):  # each further centre: the first customer at which the running total of distances passes the draw
        seeds.append(f"""
s{step + 1} AS MATERIALIZED (SELECT * FROM s{step} UNION ALL
  SELECT f.r, {step + 1} AS c, COALESCE(h.x, f.x), COALESCE(h.y, f.y), COALESCE(h.z, f.z) FROM s1 f LEFT JOIN (
    SELECT r, arg_min(x, Customer_Key) AS x, arg_min(y, Customer_Key) AS y, arg_min(z, Customer_Key) AS z FROM (
      SELECT *, SUM(d) OVER (PARTITION BY r ORDER BY Customer_Key ROWS UNBOUNDED PRECEDING) AS upto,
        ({draw.format(seed=seed, step=step)} * SUM(d) OVER (PARTITION BY r)) // 4503599627370496 AS left_of
      FROM (SELECT w.r, p.Customer_Key, p.x, p.y, p.z, MIN(CAST({d} AS HUGEINT)) AS d FROM s{step} w, pts p GROUP BY ALL) e) u
    WHERE upto > left_of GROUP BY r) h ON h.r = f.r WHERE {step} < (SELECT COUNT(*) FROM pts))""")
    seeds.append(f"starts AS MATERIALIZED (SELECT * FROM s{k})")
    return [f"""
zs AS (SELECT *, {z('-Recency_Days')} AS zr, {z('CAST(Frequency AS DOUBLE)')} AS zf, {z('Monetary')} AS zm FROM feat)""", f"""
pts AS MATERIALIZED (SELECT Customer_Key, (zr + zf + zm) / 3 AS comp, {unit.format('zr')} AS x, {unit.format('zf')} AS y, {unit.format('zm')} AS z
  FROM zs)""", *seeds, f"""
it(i, r, c, x, y, z, moved) AS (
  SELECT 0, r, c, x, y, z, true FROM starts
  UNION ALL
  SELECT i + 1, r, c, nx, ny, nz, bool_or(nx <> x OR ny <> y OR nz <> z) OVER (PARTITION BY r) FROM (
    SELECT w.i, w.r, w.c, w.x, w.y, w.z, {moved}
    FROM it w LEFT JOIN (
      SELECT r, c, COUNT(*) AS n, CAST(SUM(px) AS BIGINT) AS x, CAST(SUM(py) AS BIGINT) AS y, CAST(SUM(pz) AS BIGINT) AS z FROM (
        SELECT w.r, w.c, p.x AS px, p.y AS py, p.z AS pz, ROW_NUMBER() OVER (PARTITION BY w.r, p.Customer_Key ORDER BY {d}, w.c) AS nth
        FROM it w, pts p WHERE w.moved AND w.i < {max_iter}) b WHERE nth = 1 GROUP BY r, c) s ON s.r = w.r AND s.c = w.c
    WHERE w.moved AND w.i < {max_iter}) m)""", """
ends AS (SELECT r, c, arg_max(x, i) AS x, arg_max(y, i) AS y, arg_max(z, i) AS z FROM it GROUP BY r, c)""", f"""
near AS (SELECT * FROM (SELECT w.r, w.c, p.Customer_Key, p.comp, {d} AS d,
           ROW_NUMBER() OVER (PARTITION BY w.r, p.Customer_Key ORDER BY {d}, w.c) AS nth FROM ends w, pts p) n WHERE nth = 1)""", """
best AS (SELECT r FROM near GROUP BY r ORDER BY SUM(d), r LIMIT 1)""", """
ranks AS (SELECT c, ROW_NUMBER() OVER (ORDER BY AVG(comp) DESC, c) - 1 AS Cluster FROM near JOIN best USING (r) GROUP BY c)""", f"""
seg AS (SELECT f.Customer_Key, Customer, Segment, Recency_Days, Frequency, Monetary, CAST(Cluster AS INTEGER) AS Cluster,
  (['{"', '".join(SG.SEGMENT_LABELS)}'])[Cluster + 1] AS RFM_Segment
  FROM feat f JOIN near ON near.Customer_Key = f.Customer_Key JOIN best USING (r) JOIN ranks ON ranks.c = near.c)"""]


def _segments_sql(body: str) -> str:
    return with_view(body, _FEATURES_CTE, *_segments_ctes()).replace("WITH sales", "WITH RECURSIVE sales", 1).replace(
        "WITH \nsales", "WITH RECURSIVE sales", 1)


@register("rfm_segments", _segments_sql("SELECT * FROM seg"))
def q_rfm_segments(spark, sf_dir):
    seg = SG.segment_customers(C.customer_features(view_for(spark, sf_dir, C.FEATURE_COLUMNS)))
    return seg.select("Customer_Key", "Customer", "Segment", "Recency_Days", "Frequency", "Monetary",
                      "Cluster", "RFM_Segment")


@register("segment_profile", _segments_sql("""
SELECT RFM_Segment, COUNT(Customer_Key) AS Customers, round(AVG(Recency_Days), 1) AS Avg_Recency_Days,
  round(AVG(Frequency), 1) AS Avg_Frequency, round(AVG(Monetary), 1) AS Avg_Monetary FROM seg GROUP BY RFM_Segment"""))
def q_segment_profile(spark, sf_dir):
    return SG.segment_profile(SG.segment_customers(C.customer_features(view_for(spark, sf_dir, C.FEATURE_COLUMNS))))


def _churn(spark, sf_dir):
    labeled = C.churn_dataset(view_for(spark, sf_dir, C.CHURN_COLUMNS))
    return labeled, CH.train_churn(labeled)


_CHURN_FOREST = (_CHURN_CTE, _SPLIT_CTE, *churn_sql.forest_ctes())


@register("churn_risk", with_view(churn_sql.RISK, *_CHURN_FOREST))
def q_churn_risk(spark, sf_dir):
    labeled, model = _churn(spark, sf_dir)
    return CH.predict_risk(model, labeled)


@register("churn_metrics", with_view(churn_sql.METRICS, *_CHURN_FOREST))
def q_churn_metrics(spark, sf_dir):
    return _churn(spark, sf_dir)[1].metrics


@register("churn_importance", with_view(churn_sql.IMPORTANCE, *_CHURN_FOREST))
def q_churn_importance(spark, sf_dir):
    return _churn(spark, sf_dir)[1].importance


@register("risk_tiers", with_view("SELECT tier AS Risk_Tier, COUNT(*) AS Customers FROM risk GROUP BY tier ORDER BY tier", *_CHURN_FOREST))
def q_risk_tiers(spark, sf_dir):
    labeled, model = _churn(spark, sf_dir)
    return CH.risk_tier_counts(CH.predict_risk(model, labeled))


def _forest_ctes(trees: int = 200, seed: int = 42, q: float = 0.02) -> list[str]:
    """The isolation forest as chained CTEs: draws, samples, eight levels of splits, then every line's way down."""
    uniform = "(CAST('0x' || substr(md5('{seed}|' || tree || '|' || node || '|{what}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
    feature, split = uniform.format(seed=seed, what="feature"), uniform.format(seed=seed, what="split")
    fs = [f"f{i}" for i in range(4)]
    out = [f"""
m AS (SELECT Sales_Key AS k, {', '.join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS f{i}" for i, c in enumerate(AN.FEATURES))} FROM sales)""",
           "numbered AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER (PARTITION BY k) AS nth FROM m)",
           f"size AS (SELECT least({AN.SAMPLE_SIZE}, COUNT(*)) AS psi, ceil(log2(greatest(2, least({AN.SAMPLE_SIZE}, COUNT(*))))) AS deep, "
           f"least(65535, ceil((least({AN.SAMPLE_SIZE}, COUNT(*)) + 8 * sqrt(least({AN.SAMPLE_SIZE}, COUNT(*))) + 8) / COUNT(*) * 65536)) AS bound FROM m)",
           f"""
digests AS MATERIALIZED (SELECT numbered.*, h.i, md5('{seed}|draw|' || h.i || '|' || k || '|' || nth) AS digest
  FROM numbered, range(0, {-(-trees // AN.PER_HASH)}) AS h(i))""",
           f"""
draws AS MATERIALIZED (SELECT * FROM (SELECT {AN.PER_HASH} * i + j AS tree, k, nth, {', '.join(fs)}, substr(digest, CAST(4 * j + 1 AS BIGINT), 4) AS draw
    FROM digests, range(0, {AN.PER_HASH}) AS o(j)) x WHERE tree < {trees} AND CAST('0x' || draw AS INTEGER) <= (SELECT bound FROM size))""",
           f"""
l0 AS MATERIALIZED (SELECT tree, 1 AS node, {', '.join(fs)} FROM (
  SELECT draws.*, ROW_NUMBER() OVER (PARTITION BY tree ORDER BY draw, md5('{seed}|' || tree || '|' || k || '|' || nth)) AS place
  FROM draws) x, size WHERE place <= psi)"""]
    usable = "[" + ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in range(4)) + "]"
    for d in range(9):
        out.append(f"""
n{d} AS MATERIALIZED (SELECT tree, node, n, f, CASE f {' '.join(f'WHEN {i} THEN lo{i} + u * (hi{i} - lo{i})' for i in range(4))} END AS thr
  FROM (SELECT tree, node, n, u, CASE WHEN n > 1 AND {d} < deep AND len(us) > 0 THEN us[CAST(floor(v * len(us)) AS BIGINT) + 1] END AS f,
          {', '.join(f'lo{i}, hi{i}' for i in range(4))}
        FROM (SELECT *, [x for x in {usable} if x IS NOT NULL] AS us, {feature} AS v, {split} AS u
              FROM (SELECT tree, node, COUNT(*) AS n, {', '.join(f'MIN(f{i}) AS lo{i}, MAX(f{i}) AS hi{i}' for i in range(4))}
                    FROM l{d} GROUP BY tree, node) a) b, size) c)""")
        if d < 8:
            value = "CASE f " + " ".join(f"WHEN {i} THEN f{i}" for i in range(4)) + " END"
            out.append(f"""
l{d + 1} AS MATERIALIZED (SELECT l.tree, 2 * l.node + CASE WHEN {value} < thr THEN 0 ELSE 1 END AS node, {', '.join(fs)}
  FROM l{d} l JOIN n{d} n ON l.tree = n.tree AND l.node = n.node WHERE n.f IS NOT NULL)""")
    c_n = f"CASE WHEN n <= 1 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2.0 * (ln(n - 1.0) + {AN.EULER!r}) - 2.0 * (n - 1.0) / n END"
    c_psi = c_n.replace("n - 1.0", "psi - 1.0").replace("/ n END", "/ psi END").replace("WHEN n ", "WHEN psi ")
    out.append("w0 AS (SELECT k, f0, f1, f2, f3, t.tree, 1 AS node FROM numbered, range(0, %d) AS t(tree) WHERE nth = 1)" % trees)
    for d in range(9):
        value = "CASE f " + " ".join(f"WHEN {i} THEN f{i}" for i in range(4)) + " END"
        out.append(f"""
e{d} AS (SELECT w.k, CAST(round(({d} + {c_n}) * {AN.PATH_UNITS}.0) AS BIGINT) AS path
  FROM w{d} w JOIN n{d} n ON w.tree = n.tree AND w.node = n.node WHERE n.f IS NULL)""")
        if d < 8:
            out.append(f"""
w{d + 1} AS MATERIALIZED (SELECT w.k, f0, f1, f2, f3, w.tree, 2 * w.node + CASE WHEN {value} < thr THEN 0 ELSE 1 END AS node
  FROM w{d} w JOIN n{d} n ON w.tree = n.tree AND w.node = n.node WHERE n.f IS NOT NULL)""")
    every = " UNION ALL ".join(f"SELECT * FROM e{d}" for d in range(9))
    out.append(f"""
raw AS (SELECT k, round(-pow(2.0, -(CAST(SUM(path) AS DOUBLE) / {AN.PATH_UNITS * trees}.0) / ({c_psi})), {AN.SCORE_PLACES}) AS s
  FROM ({every}) e, size GROUP BY k, psi)""")
    out.append(f"scored AS MATERIALIZED (SELECT k, s - (SELECT quantile_cont(s, {q}) FROM raw JOIN m ON m.k = raw.k) AS Anomaly_Score FROM raw)")
    return out


_ANOMALIES_SQL = """SELECT Sales_Key, Order_ID, Product, Category, {measures}, round(Anomaly_Score, 6) AS Anomaly_Score
FROM scored JOIN sales ON k = Sales_Key WHERE Anomaly_Score < 0""".format(
    measures=", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in AN.FEATURES))


def _flagged(spark, sf_dir):
    return AN.detect_anomalies(view_for(spark, sf_dir, AN.ANOMALY_COLUMNS), flagged_only=True).drop("Is_Anomaly")


@register("anomalies", with_view(_ANOMALIES_SQL, *_forest_ctes()))
def q_anomalies(spark, sf_dir):
    flagged = _flagged(spark, sf_dir).checkpoint(eager=True)  # a sort reads its rows twice, to find the ranges and to deal them out
    return flagged.orderBy("Anomaly_Score", "Sales_Key").withColumn("Anomaly_Score", _F.round("Anomaly_Score", 6))


@register("anomalies_top25", with_view(_ANOMALIES_SQL + " ORDER BY scored.Anomaly_Score, Sales_Key LIMIT 25", *_forest_ctes()))
def q_anomalies_top25(spark, sf_dir):
    flagged = _flagged(spark, sf_dir).orderBy("Anomaly_Score", "Sales_Key").limit(25)
    return flagged.withColumn("Anomaly_Score", _F.round("Anomaly_Score", 6))


@register("anomaly_summary", with_view("""
SELECT COUNT(*) FILTER (WHERE Anomaly_Score < 0) AS Flagged, COUNT(*) AS Lines,
  100.0 * COUNT(*) FILTER (WHERE Anomaly_Score < 0) / COUNT(*) AS Flagged_Pct FROM scored JOIN m ON m.k = scored.k""", *_forest_ctes()))
def q_anomaly_summary(spark, sf_dir):
    return AN.anomaly_summary(AN.scored_lines(view_for(spark, sf_dir, ["Sales_Key", *AN.FEATURES])))


# ---------------------------------------------------------------- reshapes and per-unit KPIs

from salesspark.plans.export import pivot_wide  # noqa: E402


_YEARS = [str(y) for y in range(1992, 2002)]


@register("revenue_region_by_year", with_view("SELECT Region, " + ", ".join(
    f"CAST(SUM(Net_Revenue) FILTER (WHERE Year = {y}) AS DOUBLE) AS \"{y}\"" for y in _YEARS) + f""" FROM sales
GROUP BY Region HAVING CASE WHEN COUNT(*) FILTER (WHERE Year IS NULL OR Year NOT IN ({', '.join(_YEARS)})) > 0
  THEN error('a year outside the columns of the pivot') IS NULL ELSE true END"""))
def q_revenue_region_by_year(spark, sf_dir):
    long = (view_for(spark, sf_dir, ["Region", "Year", "Net_Revenue"]).groupBy("Region", "Year")
            .agg(_F.sum("Net_Revenue").cast("double").alias("Net_Revenue"))
            .withColumn("Year", _F.col("Year").cast("string")))
    return pivot_wide(long, "Region", "Year", "Net_Revenue", keys=_YEARS)


@register("kpi_per_unit", with_view(f"""
SELECT total_revenue, total_customers, total_products,
  {sql_safe_div('total_revenue', 'total_customers')} AS revenue_per_customer,
  {sql_safe_div('total_revenue', 'total_products')} AS revenue_per_product
FROM ({_KPI_SQL_SELECT.format(where="WHERE Segment = 'AUTOMOBILE'")}) k"""))
def q_kpi_per_unit(spark, sf_dir):
    f = {"Segment": "AUTOMOBILE"}
    k = M.per_unit_kpis(M.kpi_summary(view_for(spark, sf_dir, M.KPI_COLUMNS, f), f))
    return k.select("total_revenue", "total_customers", "total_products", "revenue_per_customer", "revenue_per_product")


@register("dashboard_delta", with_view("""
SELECT
  CASE WHEN p IS NULL OR p = 0 THEN 'n/a'
       ELSE trim((CASE WHEN 100.0 * (tr - p) / p >= 0 THEN '▲' ELSE '▼' END) || ' '
                 || printf('%.1f', abs(100.0 * (tr - p) / p)) || '% YoY') END AS Revenue_Delta,
  CASE WHEN p IS NULL OR p = 0 THEN 'neutral' WHEN 100.0 * (tr - p) / p >= 0 THEN 'pos' ELSE 'neg' END
    AS Revenue_Sentiment,
  CASE WHEN pp IS NULL OR pp = 0 THEN 'n/a'
       ELSE trim((CASE WHEN 100.0 * (tp - pp) / pp >= 0 THEN '▲' ELSE '▼' END) || ' '
                 || printf('%.1f', abs(100.0 * (tp - pp) / pp)) || '% YoY') END AS Profit_Delta,
  CASE WHEN pp IS NULL OR pp = 0 THEN 'neutral' WHEN 100.0 * (tp - pp) / pp >= 0 THEN 'pos' ELSE 'neg' END
    AS Profit_Sentiment
FROM (SELECT CAST(SUM(Net_Revenue) AS DOUBLE) AS tr, CAST(SUM(Profit_Amount) AS DOUBLE) AS tp FROM sales
      WHERE Region = 'AMERICA') k,
     (SELECT MAX(CASE WHEN r = 2 THEN nr END) AS p, MAX(CASE WHEN r = 2 THEN pr END) AS pp
      FROM (SELECT CAST(SUM(Net_Revenue) AS DOUBLE) AS nr, CAST(SUM(Profit_Amount) AS DOUBLE) AS pr,
                   ROW_NUMBER() OVER (ORDER BY Year DESC) AS r
            FROM sales WHERE Region = 'AMERICA' GROUP BY Year) y) s"""))
def q_dashboard_delta(spark, sf_dir):
    f = {"Region": "AMERICA"}
    return N.dashboard_delta(view_for(spark, sf_dir, N.DELTA_COLUMNS, f), f)


@register("abc_class_a_top20", _ABC_SQL.replace("ORDER BY Rank", "WHERE ABC_Class = 'A' ORDER BY Rank LIMIT 20")
          .replace("\nSELECT Rank, Product, Category, Net_Revenue, Cumulative_Revenue, Cumulative_Pct,\n  CASE",
                   "\nSELECT * FROM (SELECT Rank, Product, Category, Net_Revenue, Cumulative_Revenue, Cumulative_Pct,\n  CASE", 1)
          .replace("    FROM prod) r) c\n", "    FROM prod) r) c) x\n", 1))
def q_abc_class_a_top20(spark, sf_dir):
    return D.abc_analysis(view_for(spark, sf_dir, D.ABC_COLUMNS)).filter(_F.col("ABC_Class") == "A") \
        .orderBy("Rank").limit(20)


def _bank_sql() -> str:
    templates = ", ".join("'" + t.replace("'", "''") + "'" for t in Q.QUESTION_TEMPLATES)
    text = f"([{templates}])[((Year * 7 + CAST(substr(Quarter, 2, 1) AS INTEGER) * 3 + length(Region) + length(Segment)) % {len(Q.QUESTION_TEMPLATES)}) + 1]"
    for field in ("Region", "Segment", "Year", "Quarter", "Channel", "Month"):
        text = f"replace({text}, '{{{field}}}', CAST({field} AS VARCHAR))"
    return f"""
bank AS (
  SELECT Region || '|' || Segment || '|' || CAST(Year AS VARCHAR) || '|' || Quarter AS Question_ID, {text} AS text
  FROM (SELECT Region, Segment, Year, Quarter, MIN(Channel) AS Channel, MIN(Month_Name) AS Month
        FROM sales GROUP BY Region, Segment, Year, Quarter) c)"""


_MATCH = " AND ".join(f"(p.{f} IS NULL OR s.{f} = p.{f})" for f in Q.FILTER_FIELDS)
_DESC = ("concat_ws(', ', " + ", ".join(f"'{f}=' || CAST(p.{f} AS VARCHAR)" for f in Q.FILTER_FIELDS) + ")")
_IS_BD = "(p.Dimension IS NOT NULL AND p.Metric IN ('Net_Revenue', 'Profit', 'Orders', 'Units'))"

_ANSWERS_BODY = f"""
SELECT Question_ID, Metric, Dimension, Answer_Value, Leader,
  'The ' || label || ' for ' || CASE WHEN d = '' THEN 'across all data' ELSE d END || ' is **'
  || CASE WHEN Metric = 'Return_Rate' THEN printf('%.2f', Answer_Value) || '%' ELSE format('{{:,.0f}}', Answer_Value) END
  || '**.' || CASE WHEN Dimension IS NOT NULL THEN ' (A per-' || Dimension || ' breakdown isn''t available for '
                   || label || ', so this is the overall figure.)' ELSE '' END AS Answer
FROM (
  SELECT p.Question_ID, p.Metric, p.Dimension, CAST(NULL AS VARCHAR) AS Leader, {_DESC} AS d,
    CASE p.Metric WHEN 'Net_Revenue' THEN 'net revenue' WHEN 'Profit' THEN 'total profit'
      WHEN 'Orders' THEN 'total orders' WHEN 'Units' THEN 'total line items' ELSE 'return rate' END AS label,
    CASE p.Metric
      WHEN 'Net_Revenue' THEN CAST(COALESCE(SUM(s.Net_Revenue), 0) AS DOUBLE)
      WHEN 'Profit' THEN CAST(COALESCE(SUM(s.Profit_Amount), 0) AS DOUBLE)
      WHEN 'Orders' THEN CAST(COUNT(DISTINCT s.Order_ID) AS DOUBLE)
      WHEN 'Units' THEN CAST(COUNT(s.Order_ID) AS DOUBLE)
      ELSE CASE WHEN COUNT(s.Order_ID) > 0 THEN (100.0 * CAST(SUM(s.Is_Returned) AS DOUBLE)) / CAST(COUNT(s.Order_ID) AS DOUBLE)
                ELSE 0.0 END END AS Answer_Value
  FROM parsed p LEFT JOIN sales s ON {_MATCH}
  WHERE NOT {_IS_BD}
  GROUP BY p.Question_ID, p.Metric, p.Dimension, p.Region, p.Category, p.Channel, p.Segment, p.Quarter, p.Year,
    p.Month) k
UNION ALL
SELECT p.Question_ID, p.Metric, p.Dimension, l.m AS Answer_Value, l.dv AS Leader,
  CASE WHEN l.Question_ID IS NULL THEN 'No matching data was found for that question.'
       ELSE 'Breakdown by ' || p.Dimension || ' for ' || CASE WHEN {_DESC} = '' THEN 'all data' ELSE {_DESC} END
            || ': **' || COALESCE(l.dv, 'None') || '** leads with ' || replace(p.Metric, '_', ' ') || ' of '
            || format('{{:,.0f}}', l.m) || '.' END AS Answer
FROM parsed p LEFT JOIN (
  SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY Question_ID ORDER BY m DESC, dv ASC NULLS FIRST) AS r
    FROM (SELECT *, CASE Metric WHEN 'Net_Revenue' THEN Net_Revenue WHEN 'Profit' THEN Profit
                                WHEN 'Orders' THEN Orders ELSE Units END AS m
          FROM (SELECT p.Question_ID, p.Metric,
                  CAST(CASE p.Dimension WHEN 'Region' THEN s.Region WHEN 'Category' THEN s.Category
                    WHEN 'Product' THEN s.Product WHEN 'Customer' THEN s.Customer
                    WHEN 'Salesperson' THEN s.Salesperson END AS VARCHAR) AS dv,
                  CAST(SUM(s.Net_Revenue) AS DOUBLE) AS Net_Revenue, CAST(SUM(s.Profit_Amount) AS DOUBLE) AS Profit,
                  CAST(COUNT(DISTINCT s.Order_ID) AS DOUBLE) AS Orders, CAST(SUM(s.Quantity) AS DOUBLE) AS Units
                FROM parsed p JOIN sales s ON {_MATCH}
                WHERE {_IS_BD}
                GROUP BY 1, 2, 3) g) x) y
  WHERE r = 1) l ON l.Question_ID = p.Question_ID
WHERE {_IS_BD}"""


def _answers_sql(keys: list[str], *source: str) -> str:
    """The answers to the questions of the CTE ``q`` with the given key columns."""
    def listed(prefix):
        return ", ".join(prefix + k for k in keys)
    body = (_ANSWERS_BODY.replace("l.Question_ID = p.Question_ID", " AND ".join(f"l.{k} = p.{k}" for k in keys))
            .replace("l.Question_ID IS NULL", f"l.{keys[0]} IS NULL").replace("p.Question_ID", listed("p."))
            .replace("GROUP BY 1, 2, 3", "GROUP BY ALL").replace("Question_ID", listed("")))
    return with_view(body, *source, *_parse_ctes("q", keys))


_ANSWERS_SQL = _answers_sql(["Question_ID"], _bank_sql(), "q AS (SELECT Question_ID, lower(text) AS low FROM bank)")
ORACLE["question_answers"] = _answers_sql(
    ["conv_id", "turn"], "q AS (SELECT conv_id, turn, lower(text) AS low FROM conversations WHERE role = 'user')")


def _bank_answers(spark, sf_dir):
    names = line_names(spark, sf_dir)
    with coded_lines(spark, sf_dir, sorted(set(Q.ANSWER_COLUMNS + Q.BANK_COLUMNS)), names) as view:
        with freed_shuffles(spark):
            parsed = Q.parse_questions(Q.question_bank(view), Q.vocabulary(filter_frames(spark, sf_dir)))
        return Q.answer_questions(parsed, view, ["Question_ID"], names)


@register("question_bank_answers", _ANSWERS_SQL)
def q_question_bank_answers(spark, sf_dir):
    return _bank_answers(spark, sf_dir)


@register("question_bank_parse", with_view("SELECT * FROM parsed", _bank_sql(),
                                           "q AS (SELECT Question_ID, lower(text) AS low FROM bank)",
                                           *_parse_ctes("q", ["Question_ID"])))
def q_question_bank_parse(spark, sf_dir):
    view = view_for(spark, sf_dir, sorted(set(Q.VOCAB_FIELDS) | set(Q.BANK_COLUMNS)))
    p = Q.parse_questions(Q.question_bank(view), Q.vocabulary(filter_frames(spark, sf_dir)))
    return p.select("Question_ID", "Metric", "Dimension", *Q.FILTER_FIELDS,
                    _F.concat_ws(", ", "Recognized_Terms").alias("Recognized_Terms"))


@register("leaderboard_top15", with_view("""
SELECT Salesperson_Key, MIN(Salesperson) AS Salesperson,
  CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue,
  CAST(SUM(Profit_Amount) AS DOUBLE) AS Profit,
  COUNT(DISTINCT Order_ID) AS Deals
FROM sales WHERE Salesperson IS NOT NULL GROUP BY Salesperson_Key
ORDER BY Net_Revenue DESC NULLS LAST, Salesperson_Key LIMIT 15"""))
def q_leaderboard_top15(spark, sf_dir):
    return M.salesperson_leaderboard(view_for(spark, sf_dir, M.LEADERBOARD_COLUMNS)).limit(15)


def _latin1_sql(x: str) -> str:
    for src, dst in X.LATIN1_REPLACEMENTS.items():
        x = f"replace({x}, '{src}', '{dst.replace(chr(39), chr(39) * 2)}')"
    return f"regexp_replace({x}, '[^\\x{{00}}-\\x{{FF}}]', '?', 'g')"


@register("insights_latin1", "SELECT Insight_ID, " + _latin1_sql("Text") + " AS Text FROM (" + _INSIGHT_SQL + ") i")
def q_insights_latin1(spark, sf_dir):
    facts = N.executive_summary(view_for(spark, sf_dir, N.INSIGHT_COLUMNS))
    return facts.select("Insight_ID", X.to_latin1("Text").alias("Text"))


# ---------------------------------------------------------------- rows, parameterised SQL, exports, page heads

from salesspark.plans.export import export_catalog  # noqa: E402
from salesspark.schema import VIEW_COLUMNS  # noqa: E402
from salesspark.sources.view import raw_sales, register_view, run_query  # noqa: E402

_AS_DOUBLE = ("Unit_Cost", "Unit_Price", "Sales_Amount", "Discount_Amount", "Cost_Amount", "Profit_Amount", "Shipping_Cost",
              "Net_Revenue")


def _plain(columns):
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in _AS_DOUBLE else "CAST(Order_Date AS VARCHAR) AS Order_Date"
                     if c == "Order_Date" else c for c in columns)


def _doubles(df):
    return df.select(*[_F.col(c).cast("double").alias(c) if c in _AS_DOUBLE else _F.col(c).cast("string").alias(c)
                       if c == "Order_Date" else _F.col(c) for c in df.columns])


@register("sales_lines", with_view(f"SELECT {_plain(VIEW_COLUMNS)} FROM sales"))
def q_sales_lines(spark, sf_dir):
    return _doubles(sales_view(spark, sf_dir))


RAW_FILTER = {"Region": "ASIA", "Year": 1996, "Segment": ["BUILDING", "MACHINERY"]}
RAW_COLUMNS = ["Sales_Key", "Order_ID", "Order_Line_ID", "Order_Date", "Product", "Net_Revenue", "Payment_Mode"]


@register("raw_sales_filtered", with_view(f"""SELECT {_plain(RAW_COLUMNS)} FROM sales
WHERE Region = 'ASIA' AND Year = 1996 AND Segment IN ('BUILDING', 'MACHINERY')"""))
def q_raw_sales_filtered(spark, sf_dir):
    return _doubles(raw_sales(view_for(spark, sf_dir, RAW_COLUMNS, RAW_FILTER), RAW_FILTER, RAW_COLUMNS))


@register("parameterised_kpi", with_view("""
SELECT Region, CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue, COUNT(DISTINCT Order_ID) AS Orders
FROM sales WHERE Year = 1997 AND Channel = 'HIGH' GROUP BY Region"""))
def q_parameterised_kpi(spark, sf_dir):
    name = register_view(view_for(spark, sf_dir, ["Region", "Year", "Channel", "Net_Revenue", "Order_ID"]))
    return run_query(spark, f"""SELECT Region, CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue, COUNT(DISTINCT Order_ID) AS Orders
FROM {name} WHERE Year = :year AND Channel = :channel GROUP BY Region""", {"year": 1997, "channel": "HIGH"})


_EXPORT_COLUMNS = ["Region", "Category", "Customer_Key", "Customer", "Segment", "Product", "Salesperson", "Salesperson_Key",
                   "Year", "Month", "Month_Name", "Sales_Amount"] + M.BREAKDOWN_COLUMNS


def _export_sql() -> str:
    heads = {"Sales by Region": "SELECT SUM(Net_Revenue) AS r FROM sales GROUP BY Region",
             "Sales by Category": "SELECT SUM(Net_Revenue) AS r FROM sales GROUP BY Category",
             "Top 20 Customers": "SELECT SUM(Net_Revenue) AS r FROM sales GROUP BY Customer_Key ORDER BY r DESC LIMIT 20",
             "Top 20 Products": "SELECT SUM(Net_Revenue) AS r FROM sales GROUP BY Product ORDER BY r DESC LIMIT 20",
             "Salesperson Leaderboard": "SELECT SUM(Net_Revenue) AS r FROM sales WHERE Salesperson IS NOT NULL GROUP BY Salesperson_Key",
             "ABC Analysis": "SELECT SUM(Net_Revenue) AS r FROM sales GROUP BY Product",
             "Monthly Trend": "SELECT SUM(Net_Revenue) AS r FROM sales GROUP BY Year, Month"}
    return with_view(" UNION ALL ".join(
        f"SELECT '{n}' AS View_Name, COUNT(*) AS Row_Count, round(CAST(SUM(r) AS DOUBLE), 2) AS Revenue FROM ({q}) x" for n, q in heads.items()))


@register("export_catalog", _export_sql())
def q_export_catalog(spark, sf_dir):
    out = None
    for name, build in export_catalog(view_for(spark, sf_dir, _EXPORT_COLUMNS)).items():
        df = build()
        revenue = next(c for c in ("Net_Revenue", "Revenue") if c in df.columns)
        row = df.agg(_F.count(_F.lit(1)).alias("Row_Count"),
                     _F.round(_F.sum(_F.col(revenue).cast("decimal(20,4)")).cast("double"), 2).alias("Revenue")) \
            .select(_F.lit(name).alias("View_Name"), "Row_Count", "Revenue")
        out = row if out is None else out.unionByName(row)
    return out


@register("rfm_top20", with_view("""
SELECT Customer_Key, Customer, Recency_Days, Frequency, Monetary FROM feat ORDER BY Monetary DESC, Customer_Key LIMIT 20""", _FEATURES_CTE))
def q_rfm_top20(spark, sf_dir):
    f = C.customer_features(view_for(spark, sf_dir, C.FEATURE_COLUMNS))
    return f.select("Customer_Key", "Customer", "Recency_Days", "Frequency", "Monetary") \
        .orderBy(_F.desc("Monetary"), "Customer_Key").limit(20)


@register("churn_risk_top20", with_view(churn_sql.RISK + " LIMIT 20", *_CHURN_FOREST))
def q_churn_risk_top20(spark, sf_dir):
    labeled, model = _churn(spark, sf_dir)
    return CH.predict_risk(model, labeled).limit(20)


@register("churn_check", with_view("""
SELECT (SELECT COUNT(*) FROM churn) AS Customers, COUNT(*) FILTER (WHERE Split = 'test') AS Test_Rows,
  COUNT(*) FILTER (WHERE Split = 'test' AND Churned = 1) AS Test_Churned, 100.0 * AVG(Churned) AS Churn_Rate,
  (SELECT COUNT(*) FROM churn) AS Tiered, CAST(0 AS BIGINT) AS Outside, 1.0 AS Importance FROM split""", _CHURN_CTE, _SPLIT_CTE))
def q_churn_check(spark, sf_dir):
    """Facts about the churn model that the tables determine, beside the full comparison of churn_risk and churn_metrics."""
    labeled, model = _churn(spark, sf_dir)
    risk = CH.predict_risk(model, labeled)
    split = C.holdout_split(labeled)
    p = _F.col("Churn_Probability")
    scored = risk.agg(_F.count(_F.lit(1)).alias("Customers"), _F.count("Risk_Tier").alias("Tiered"),
                      _F.sum(((p < 0) | (p > 1) | p.isNull()).cast("long")).alias("Outside"))
    parts = split.agg(_F.sum((_F.col("Split") == "test").cast("long")).alias("Test_Rows"),
                      _F.sum(((_F.col("Split") == "test") & (_F.col("Churned") == 1)).cast("long")).alias("Test_Churned"),
                      (_F.lit(100.0) * _F.avg("Churned")).alias("Churn_Rate"))
    weight = model.importance.agg(_F.round(_F.sum("Importance"), 9).alias("Importance"))
    return scored.join(parts).join(weight)


@register("region_margin", with_view("""
SELECT *, round((100.0 * Profit) / NULLIF(Net_Revenue, 0), 2) AS Margin_Pct FROM bd
ORDER BY Net_Revenue DESC NULLS LAST, Region""", _BREAKDOWN_CTE.format(dim="Region")))
def q_region_margin(spark, sf_dir):
    return D.category_margin(view_for(spark, sf_dir, ["Region"] + M.BREAKDOWN_COLUMNS), dimension="Region")


# ---------------------------------------------------------------- stored results, layout and files

import uuid  # noqa: E402

from salesspark.plans.export import kept_view, read_views, write_views  # noqa: E402
from salesspark.session import ensure_checkpoint_dir  # noqa: E402
from salesspark.sources.layout import stored_layout  # noqa: E402
from salesspark.sources.results import ResultStore  # noqa: E402
from salesspark.sources.tables import check_integrity  # noqa: E402


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("reused_result", with_view("""
SELECT Answer, From_Store, Region, Net_Revenue, Orders FROM
  (SELECT Region, CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue, COUNT(DISTINCT Order_ID) AS Orders
   FROM sales WHERE Year = 1997 AND Channel = 'HIGH' GROUP BY Region) r, (VALUES (1, false), (2, true)) a(Answer, From_Store)"""))
def q_reused_result(spark, sf_dir):
    """The same parameterised question twice, out of an empty store: the second answer is the stored one."""
    name = register_view(view_for(spark, sf_dir, ["Region", "Year", "Channel", "Net_Revenue", "Order_ID"]))
    store, out = ResultStore(spark, _new_folder(spark, "results")), None
    for nth in (1, 2):
        before = store.hits
        answer = store.query(f"""SELECT Region, CAST(SUM(Net_Revenue) AS DOUBLE) AS Net_Revenue, COUNT(DISTINCT Order_ID) AS Orders
FROM {name} WHERE Year = :year AND Channel = :channel GROUP BY Region""", {"year": 1997, "channel": "HIGH"})
        answer = answer.select(_F.lit(nth).alias("Answer"), _F.lit(store.hits > before).alias("From_Store"), "Region", "Net_Revenue", "Orders")
        out = answer if out is None else out.unionByName(answer)
    return out


@register("stored_layout_orders", with_view("""
SELECT Year, Channel, COUNT(*) AS Orders, CAST(SUM(lines) AS BIGINT) AS Lines, CAST(MAX(r) AS DOUBLE) AS Largest_Order, CAST(SUM(r) AS DOUBLE) AS Net_Revenue
FROM (SELECT Order_ID, Year, Channel, COUNT(*) AS lines, SUM(Net_Revenue) AS r FROM sales GROUP BY Order_ID, Year, Channel) o GROUP BY Year, Channel"""))
def q_stored_layout_orders(spark, sf_dir):
    """Orders per year and channel over the bucketed layout: lines and orders join, and meet by order, without a shuffle."""
    stored = stored_layout(spark, sf_dir)
    view = sales_view(spark, sf_dir, ["Order_ID", "Year", "Channel", "Net_Revenue"], keys_complete=True, stored=stored)
    orders = view.groupBy("Order_ID", "Year", "Channel").agg(_F.count(_F.lit(1)).alias("lines"), _F.sum("Net_Revenue").alias("r"))
    return orders.groupBy("Year", "Channel").agg(
        _F.count(_F.lit(1)).alias("Orders"), _F.sum("lines").alias("Lines"), _F.max("r").cast("double").alias("Largest_Order"),
        _F.sum("r").cast("double").alias("Net_Revenue"))


@register("export_round_trip", "SELECT Format, e.* FROM (" + _export_sql() + ") e, (VALUES ('csv'), ('parquet')) f(Format)")
def q_export_round_trip(spark, sf_dir):
    """The seven exports as Parquet, and these files as CSV, a folder per view in the shared store, counted and summed from the files."""
    root, out = _new_folder(spark, "export"), None
    views = {name: build() for name, build in export_catalog(kept_view(view_for(spark, sf_dir, _EXPORT_COLUMNS), f"{root}/view")).items()}
    schemas = {name: df.schema for name, df in views.items()}
    for fmt in ("parquet", "csv"):
        views = read_views(spark, write_views(views, f"{root}/{fmt}", fmt), schemas, fmt)
        for name, df in views.items():
            revenue = next(c for c in ("Net_Revenue", "Revenue") if c in df.columns)
            row = df.agg(_F.count(_F.lit(1)).alias("Row_Count"), _F.round(_F.sum(_F.col(revenue).cast("decimal(20,4)")).cast("double"), 2).alias("Revenue")) \
                .select(_F.lit(fmt).alias("Format"), _F.lit(name).alias("View_Name"), "Row_Count", "Revenue")
            out = row if out is None else out.unionByName(row)
    return out


def _integrity_sql() -> str:
    keys = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
            ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
            ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    return " UNION ALL ".join(
        f"SELECT '{child}.{ck}' AS Foreign_Key, (SELECT COUNT(*) FROM {child} WHERE NOT EXISTS (SELECT 1 FROM {parent} WHERE {pk} = {ck})) AS Orphans, "
        f"(SELECT COUNT(*) FROM (SELECT {pk} FROM {parent} GROUP BY {pk} HAVING COUNT(*) > 1) d) AS Repeated_Keys" for child, ck, parent, pk in keys)


@register("key_integrity", _integrity_sql())
def q_key_integrity(spark, sf_dir):
    """What ``keys_complete`` promises, counted: all zero where the promise holds."""
    return check_integrity(spark, sf_dir)
