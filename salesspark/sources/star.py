"""The seven-table star schema and its flattened order-line view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAR_SCHEMAS: dict[str, T.StructType] = {
    "dim_date": T.StructType([
        T.StructField("Date_Key", T.LongType(), False),
        T.StructField("Date", T.StringType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Quarter", T.StringType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Month_Name", T.StringType()),
    ]),
    "dim_region": T.StructType([
        T.StructField("Region_Key", T.LongType(), False),
        T.StructField("Region_Name", T.StringType()),
        T.StructField("Country", T.StringType()),
        T.StructField("State", T.StringType()),
        T.StructField("City", T.StringType()),
    ]),
    "dim_product": T.StructType([
        T.StructField("Product_Key", T.LongType(), False),
        T.StructField("Product_Name", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Sub_Category", T.StringType()),
        T.StructField("Unit_Cost", T.DoubleType()),
        T.StructField("Unit_Price", T.DoubleType()),
    ]),
    "dim_customer": T.StructType([
        T.StructField("Customer_Key", T.LongType(), False),
        T.StructField("Customer_Name", T.StringType()),
        T.StructField("Segment", T.StringType()),
        T.StructField("Customer_Rating", T.DoubleType()),
    ]),
    "dim_channel": T.StructType([
        T.StructField("Channel_Key", T.LongType(), False),
        T.StructField("Channel_Name", T.StringType()),
    ]),
    "dim_salesperson": T.StructType([
        T.StructField("Salesperson_Key", T.LongType(), False),
        T.StructField("Salesperson_Name", T.StringType()),
    ]),
    "fact_sales": T.StructType([
        T.StructField("Sales_Key", T.LongType(), False),
        T.StructField("Order_ID", T.LongType()),
        T.StructField("Order_Line_ID", T.IntegerType()),
        T.StructField("Order_Date_Key", T.LongType()),
        T.StructField("Region_Key", T.LongType()),
        T.StructField("Product_Key", T.LongType()),
        T.StructField("Customer_Key", T.LongType()),
        T.StructField("Channel_Key", T.LongType()),
        T.StructField("Salesperson_Key", T.LongType()),
        T.StructField("Quantity", T.DoubleType()),
        T.StructField("Sales_Amount", T.DoubleType()),
        T.StructField("Discount_Amount", T.DoubleType()),
        T.StructField("Cost_Amount", T.DoubleType()),
        T.StructField("Profit_Amount", T.DoubleType()),
        T.StructField("Shipping_Cost", T.DoubleType()),
        T.StructField("Payment_Mode", T.StringType()),
        T.StructField("Is_Returned", T.IntegerType()),
    ]),
}


def read_star(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Read the seven star tables from ``{root}/{table}`` with fixed schemas (no inference)."""
    return {name: spark.read.format(fmt).schema(schema).load(f"{root}/{name}")
            for name, schema in STAR_SCHEMAS.items()}


def _quarter_label(col):
    """Quarter as 'Q1'..'Q4' whether it is stored as 1..4 or already labelled."""
    as_text = col.cast("string")
    return F.when(as_text.startswith("Q"), as_text).otherwise(F.concat(F.lit("Q"), as_text))


def money(name: str):
    """A money column as an exact decimal, so that sums don't depend on the order of tasks."""
    return F.col(name).cast("decimal(16,4)").alias(name.split(".")[1])


def view_from_star(tables: dict[str, DataFrame]) -> DataFrame:
    """The flattened order-line view: five inner joins and a left join to salespeople.

    Only the date and channel dimensions have a bound by construction (calendar
    days, a handful of channels) and are broadcast; the size of the other
    dimensions grows with the business, so the join strategy is left to
    Catalyst's size estimate and AQE's runtime statistics.
    """
    f = tables["fact_sales"].alias("f")
    d = tables["dim_date"].alias("d")
    r = tables["dim_region"].alias("r")
    p = tables["dim_product"].alias("p")
    c = tables["dim_customer"].alias("c")
    ch = tables["dim_channel"].alias("ch")
    sp = tables["dim_salesperson"].alias("sp")
    joined = (
        f.join(d, F.col("f.Order_Date_Key") == F.col("d.Date_Key"))
        .join(r, F.col("f.Region_Key") == F.col("r.Region_Key"))
        .join(p, F.col("f.Product_Key") == F.col("p.Product_Key"))
        .join(c, F.col("f.Customer_Key") == F.col("c.Customer_Key"))
        .join(ch, F.col("f.Channel_Key") == F.col("ch.Channel_Key"))
        .join(sp, F.col("f.Salesperson_Key") == F.col("sp.Salesperson_Key"), "left")
    )
    return joined.select(
        F.col("f.Sales_Key").alias("Sales_Key"),
        F.col("f.Order_ID").alias("Order_ID"),
        F.col("f.Order_Line_ID").alias("Order_Line_ID"),
        F.to_date(F.col("d.Date")).alias("Order_Date"),
        F.col("d.Year").cast("int").alias("Year"),
        _quarter_label(F.col("d.Quarter")).alias("Quarter"),
        F.col("d.Month").cast("int").alias("Month"),
        F.col("d.Month_Name").alias("Month_Name"),
        F.col("r.Region_Name").alias("Region"),
        F.col("r.Country").alias("Country"),
        F.col("r.State").alias("State"),
        F.col("r.City").alias("City"),
        F.col("p.Product_Name").alias("Product"),
        F.col("p.Category").alias("Category"),
        F.col("p.Sub_Category").alias("Sub_Category"),
        money("p.Unit_Cost"),
        money("p.Unit_Price"),
        F.col("c.Customer_Name").alias("Customer"),
        F.col("c.Segment").alias("Segment"),
        F.col("c.Customer_Rating").alias("Customer_Rating"),
        F.col("c.Customer_Key").alias("Customer_Key"),
        F.col("sp.Salesperson_Name").alias("Salesperson"),
        F.col("sp.Salesperson_Key").alias("Salesperson_Key"),
        F.col("ch.Channel_Name").alias("Channel"),
        F.col("f.Quantity").alias("Quantity"),
        money("f.Sales_Amount"),
        money("f.Discount_Amount"),
        money("f.Cost_Amount"),
        money("f.Profit_Amount"),
        money("f.Shipping_Cost"),
        (money("f.Sales_Amount") - money("f.Discount_Amount")).alias("Net_Revenue"),
        F.col("f.Payment_Mode").alias("Payment_Mode"),
        F.col("f.Is_Returned").cast("int").alias("Is_Returned"),
    )
