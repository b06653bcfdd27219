"""The sales view over the driver's TPC-H-like tables.

Mapping (one order line of ``lineitem`` = one sales fact):

* order attributes (date, customer key, channel, payment mode) come from ``orders``;
* geography comes from the customer's nation and region;
* product attributes from ``part``; the salesperson is the line's supplier, except
  for the ``LOW`` channel, which has none (so the left join matters);
* money is kept as exact DECIMAL inside the plan and cast to DOUBLE only at the
  output of an operator, which makes sums independent of evaluation order.

The view joins every table, so a line whose keys don't resolve is not in it. A caller
who knows that all keys resolve and parent keys are unique (``check_integrity`` counts the
exceptions) may promise so with ``keys_complete=True``; then only the tables that the
requested columns need are joined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesspark.schema import MONTH_NAMES, VIEW_COLUMNS

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Which source table each view column needs (beyond lineitem).
NEEDS = {
    "Order_Date": {"orders"}, "Year": {"orders"}, "Quarter": {"orders"}, "Month": {"orders"},
    "Month_Name": {"orders"}, "Customer_Key": {"orders"}, "Channel": {"orders"},
    "Payment_Mode": {"orders"},
    "Customer": {"orders", "customer"}, "Segment": {"orders", "customer"},
    "Customer_Rating": {"orders", "customer"},
    "Country": {"orders", "customer", "nation"}, "State": {"orders", "customer", "nation"},
    "City": {"orders", "customer", "nation"},
    "Region": {"orders", "customer", "nation", "region"},
    "Product": {"part"}, "Category": {"part"}, "Sub_Category": {"part"},
    "Unit_Cost": {"part"}, "Unit_Price": {"part"},
    "Salesperson": {"orders", "supplier"}, "Salesperson_Key": {"orders", "supplier"},
}

_MONEY = "decimal(12,2)"
# Precision <= 18 keeps decimals in Spark's long-backed fast path (no BigDecimal per row).
_AMOUNT = "decimal(16,4)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _needed_tables(columns: Iterable[str] | None, keys_complete: bool) -> set[str]:
    if columns is None or not keys_complete:
        return {"orders", "customer", "nation", "region", "part", "supplier"}
    needed: set[str] = set()
    for c in columns:
        if c not in VIEW_COLUMNS:
            raise ValueError(f"unknown view column: {c}")
        needed |= NEEDS.get(c, set())
    return needed


def line_key() -> Column:
    """60 bits of the MD5 of a whole line: a key that any engine computes from the line alone."""
    text = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       *[F.col(c).cast(_MONEY).cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
                       "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def line_columns(li: DataFrame) -> DataFrame:
    """Money and measure columns that only need the line itself."""
    sales = F.col("l_extendedprice").cast(_MONEY)
    discount = (sales * F.col("l_discount").cast("decimal(4,2)")).cast(_AMOUNT)
    cost_rate = ((F.lit(50) + F.lit(5) * (F.col("l_partkey") % 11)).cast("decimal(4,0)")
                 * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(3,2)")
    cost = (sales * cost_rate).cast(_AMOUNT)
    return li.select(
        line_key().alias("Sales_Key"),
        F.col("l_orderkey").alias("Order_ID"),
        F.col("l_linenumber").alias("Order_Line_ID"),
        F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_quantity").alias("Quantity"),
        sales.alias("Sales_Amount"),
        discount.alias("Discount_Amount"),
        cost.alias("Cost_Amount"),
        (sales * F.col("l_tax").cast("decimal(4,2)")).cast(_AMOUNT).alias("Shipping_Cost"),
        (sales - discount).alias("Net_Revenue"),
        (sales - discount - cost).alias("Profit_Amount"),
        (F.col("l_returnflag") == "R").cast("int").alias("Is_Returned"),
    )


def view_columns() -> dict[str, Column]:
    """View columns by the columns of the tables that they come from."""
    return {
        "Order_Date": F.col("Order_Date"),
        "Year": F.year("Order_Date"),
        "Quarter": F.concat(F.lit("Q"), F.quarter("Order_Date").cast("string")),
        "Month": F.month("Order_Date"),
        "Month_Name": F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month("Order_Date")),
        "Region": F.col("r_name"),
        "Country": F.col("n_name"),
        "State": F.concat(F.col("n_name"), F.lit("/S"), (F.col("c_custkey") % 4).cast("string")),
        "City": F.concat(F.col("n_name"), F.lit("/S"), (F.col("c_custkey") % 4).cast("string"),
                         F.lit("/C"), (F.col("c_custkey") % 16).cast("string")),
        "Product": F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")),
        "Category": F.col("p_type"),
        "Sub_Category": F.col("p_brand"),
        "Unit_Price": F.col("p_retailprice").cast(_MONEY),
        "Unit_Cost": (F.col("p_retailprice").cast(_MONEY) * F.lit(0.6).cast("decimal(2,1)")).cast("decimal(15,3)"),
        "Customer": F.col("c_name"),
        "Segment": F.col("c_mktsegment"),
        "Customer_Rating": (F.lit(10) + F.col("c_custkey") % 41).cast("double") / 10,
        "Customer_Key": F.col("o_custkey"),
        "Salesperson": F.col("s_name"),
        "Salesperson_Key": F.col("s_suppkey"),
        "Channel": F.col("Channel"),
        "Payment_Mode": F.col("o_orderstatus"),
    }


def resolved_orders(spark: SparkSession, sf_dir: str, orders: DataFrame, needed: set[str], customers: DataFrame | None = None) -> DataFrame:
    """The orders with what the needed tables say of their customers (out of ``customers``, if given)."""
    orders = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("Order_Date"))
    if "customer" not in needed:
        return orders
    cust = (read_table(spark, sf_dir, "customer") if customers is None else customers).select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    if "nation" in needed:
        nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
        if "region" in needed:
            region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
            nation = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        cust = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    # orders is ~1/4 of lineitem: resolve the customer on the smaller side first.
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))


def sales_view(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None,
               keys_complete: bool = False, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    """Flattened order-line sales view over the tables in ``sf_dir``; ``stored`` has tables to read from elsewhere (``layout.stored_layout``).

    ``columns`` lists the view columns the caller will read (filters included);
    the result has exactly those columns (all 33 when ``None``).
    """
    cols = list(VIEW_COLUMNS) if columns is None else list(dict.fromkeys(columns))
    needed = _needed_tables(cols, keys_complete)

    kept = stored or {}
    fact = line_columns(kept["lineitem"] if "lineitem" in kept else read_table(spark, sf_dir, "lineitem"))

    if "orders" in needed:
        orders = resolved_orders(spark, sf_dir, kept["orders"] if "orders" in kept else read_table(spark, sf_dir, "orders"), needed)
        fact = fact.join(orders, F.col("Order_ID") == F.col("o_orderkey"))
        fact = fact.withColumn("Channel", F.expr("substr(o_orderpriority, 3)"))

    if "part" in needed:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_retailprice")
        fact = fact.join(part, F.col("l_partkey") == F.col("p_partkey"))

    if "supplier" in needed:
        supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        fact = fact.join(supp, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("Channel") != "LOW"), "left")

    exprs = view_columns()
    return fact.select(*[exprs.get(c, F.col(c)).alias(c) for c in cols])


def filter_frames(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The filter columns of the view, each out of the smallest table that has it, with only the rows that some line leads to (semi-joins by
    the keys of the lines). Between them they hold the same values as the view whose keys are complete, without a wide copy of the lines."""
    lines, exprs = read_table(spark, sf_dir, "lineitem"), view_columns()

    def columns(df: DataFrame, *names: str) -> DataFrame:
        return df.select(*(exprs[c].alias(c) for c in names))

    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("Order_Date"), F.expr("substr(o_orderpriority, 3)").alias("Channel"))
    orders = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    part = read_table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    nation = read_table(spark, sf_dir, "nation").join(read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = read_table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi") \
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sold = lines.join(orders.filter(F.col("Channel") != "LOW"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    sellers = read_table(spark, sf_dir, "supplier").join(sold, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
    return [columns(orders, "Year", "Quarter", "Month", "Channel").distinct(), columns(part, "Product", "Category", "Sub_Category"),
            columns(customers, "Region", "Country", "State", "City", "Customer", "Segment"), columns(sellers, "Salesperson")]


def check_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key that the view resolves: child rows without a parent and parent keys that repeat (all zero: ``keys_complete``
    holds). A line's supplier may be missing, so only its repeats matter."""
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer")
    part = read_table(spark, sf_dir, "part")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")

    def orphans(name, child, ck, parent, pk):
        missing = child.join(parent, child[ck] == parent[pk], "left_anti").agg(F.count(F.lit(1)).alias("Orphans"))
        repeats = parent.groupBy(pk).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("Repeated_Keys"))
        return missing.join(repeats).select(F.lit(name).alias("Foreign_Key"), "Orphans", "Repeated_Keys")

    return (orphans("lineitem.l_orderkey", li, "l_orderkey", orders, "o_orderkey")
            .unionByName(orphans("lineitem.l_partkey", li, "l_partkey", part, "p_partkey"))
            .unionByName(orphans("lineitem.l_suppkey", li, "l_suppkey", read_table(spark, sf_dir, "supplier"), "s_suppkey"))
            .unionByName(orphans("orders.o_custkey", orders, "o_custkey", cust, "c_custkey"))
            .unionByName(orphans("customer.c_nationkey", cust, "c_nationkey", nation, "n_nationkey"))
            .unionByName(orphans("nation.n_regionkey", nation, "n_regionkey", region, "r_regionkey")))
