"""ANSI SQL twins of the catalogue queries, for DuckDB over the same parquet tables.

Every text starts from the same flattened view (``sales``), written with the
same decimal arithmetic as ``salesspark.sources.tables`` so sums agree exactly.
"""

from __future__ import annotations

from salesspark.schema import MONTH_NAMES

_MONTHS = ", ".join(f"'{m}'" for m in MONTH_NAMES)
_DATE = "CAST(o.o_orderdate AS DATE)"
_SALES = "CAST(l.l_extendedprice AS DECIMAL(12,2))"
_DISC = f"CAST({_SALES} * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(16,4))"
_COST = (f"CAST({_SALES} * CAST(CAST(50 + 5 * (l.l_partkey % 11) AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(3,2))"
         " AS DECIMAL(3,2)) AS DECIMAL(16,4))")
_TEXT = ", ".join(["l.l_orderkey", "l.l_linenumber", "l.l_partkey", "l.l_suppkey",
                   *[f"CAST(CAST(l.{c} AS DECIMAL(12,2)) AS VARCHAR)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
                   "l.l_returnflag", "l.l_linestatus", "CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR)"])
_KEY = f"CAST('0x' || substr(md5(concat_ws('|', {_TEXT})), 1, 15) AS BIGINT)"

SALES_VIEW_SQL = f"""
sales AS (
  SELECT
    {_KEY} AS Sales_Key,
    l.l_orderkey AS Order_ID,
    l.l_linenumber AS Order_Line_ID,
    {_DATE} AS Order_Date,
    CAST(year({_DATE}) AS INTEGER) AS Year,
    'Q' || CAST(quarter({_DATE}) AS VARCHAR) AS Quarter,
    CAST(month({_DATE}) AS INTEGER) AS Month,
    ([{_MONTHS}])[month({_DATE})] AS Month_Name,
    r.r_name AS Region,
    n.n_name AS Country,
    n.n_name || '/S' || CAST(c.c_custkey % 4 AS VARCHAR) AS State,
    n.n_name || '/S' || CAST(c.c_custkey % 4 AS VARCHAR) || '/C' || CAST(c.c_custkey % 16 AS VARCHAR) AS City,
    p.p_name || ' #' || CAST(p.p_partkey AS VARCHAR) AS Product,
    p.p_type AS Category,
    p.p_brand AS Sub_Category,
    CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(15,3)) AS Unit_Cost,
    CAST(p.p_retailprice AS DECIMAL(12,2)) AS Unit_Price,
    c.c_name AS Customer,
    c.c_mktsegment AS Segment,
    CAST(10 + c.c_custkey % 41 AS DOUBLE) / 10 AS Customer_Rating,
    o.o_custkey AS Customer_Key,
    s.s_name AS Salesperson,
    s.s_suppkey AS Salesperson_Key,
    substr(o.o_orderpriority, 3) AS Channel,
    l.l_quantity AS Quantity,
    {_SALES} AS Sales_Amount,
    {_DISC} AS Discount_Amount,
    {_COST} AS Cost_Amount,
    {_SALES} - {_DISC} - {_COST} AS Profit_Amount,
    CAST({_SALES} * CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(16,4)) AS Shipping_Cost,
    {_SALES} - {_DISC} AS Net_Revenue,
    o.o_orderstatus AS Payment_Mode,
    CAST(l.l_returnflag = 'R' AS INTEGER) AS Is_Returned
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND substr(o.o_orderpriority, 3) <> 'LOW'
)"""


def with_view(body: str, *ctes: str) -> str:
    """``WITH sales AS (...), <ctes> <body>``."""
    parts = [SALES_VIEW_SQL] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def sql_fixed(x: str, decimals: int = 2, grouping: bool = False) -> str:
    x = f"CAST({x} AS DOUBLE)"
    return f"format('{{:,.{decimals}f}}', {x})" if grouping else f"printf('%.{decimals}f', {x})"


def sql_missing(x: str) -> str:
    return f"({x} IS NULL OR isnan({x}))"


def sql_inr(x: str, symbol: str = "₹") -> str:
    """SQL twin of ``salesspark.functions.scalars.format_inr``."""
    a = f"abs({x})"
    return (f"CASE WHEN {sql_missing(x)} THEN '{symbol}0.00' ELSE "
            f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END) || '{symbol}' || "
            f"CASE WHEN {a} >= 10000000 THEN {sql_fixed(a + ' / 10000000')} || ' Cr' "
            f"WHEN {a} >= 100000 THEN {sql_fixed(a + ' / 100000')} || ' L' "
            f"ELSE {sql_fixed(a, 2, True)} END END")


def sql_pct(x: str, decimals: int = 2) -> str:
    return f"CASE WHEN {sql_missing(x)} THEN '0.00%' ELSE {sql_fixed(x, decimals)} || '%' END"


def sql_count(x: str, decimals: int = 0) -> str:
    return f"CASE WHEN {sql_missing(x)} THEN '0' ELSE {sql_fixed(x, decimals, True)} END"


def sql_safe_div(n: str, d: str, default: str = "0.0") -> str:
    return (f"CASE WHEN {sql_missing('CAST(' + d + ' AS DOUBLE)')} OR {d} = 0 THEN {default} "
            f"ELSE CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) END")
