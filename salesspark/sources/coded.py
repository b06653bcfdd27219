"""The lines of the sales view with numbers in place of long names, for operators that deal them by many columns.

Names of products, customers and salespeople grow in number with the business and are what makes a line wide. They are numbered once, in name
order, so equal numbers are equal names and the smaller number is the smaller name; the tables that hold them take the numbers before any line
meets them, and only the few names of a result are looked up again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import ExitStack, contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesspark.plans.prefix import running_total
from salesspark.session import freed_shuffles, small_tasks
from salesspark.sources.stored import kept_rows
from salesspark.sources.tables import NEEDS, TABLE_NAMES, line_columns, read_table, resolved_orders, view_columns

#: View columns that are names, and the tables that hold them.
NAMED = {"Product": "part", "Customer": "customer", "Salesperson": "supplier"}


def line_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Field, Value, _id): the different names, numbered in the order of field and name."""
    exprs = view_columns()
    names = reduce(DataFrame.unionByName, (read_table(spark, sf_dir, table).select(F.lit(field).alias("Field"), exprs[field].alias("Value"))
                                           for field, table in NAMED.items()))
    with freed_shuffles(spark):
        names = names.filter(F.col("Value").isNotNull()).distinct().withColumn("_one", F.lit(1))
        numbered = running_total(names, "_one", [F.col("Field").asc(), F.col("Value").asc()], out="_upto", rank="_id")
        return numbered.select("Field", "Value", F.col("_id").cast("long").alias("_id")).checkpoint(eager=True)


@contextmanager
def coded_lines(spark: SparkSession, sf_dir: str, columns: Iterable[str], names: DataFrame) -> Iterator[DataFrame]:
    """The rows of ``sales_view`` with all tables joined, in files until the end; columns of ``NAMED`` have the ``_id`` of the name in ``names``.

    The lines meet parts and suppliers while they are narrow and go to files, so the shuffle files of these joins are gone before those of
    the join by order are made."""
    cols, exprs = list(dict.fromkeys(columns)), view_columns()

    def numbered(field: str) -> DataFrame:
        own = names.filter(F.col("Field") == field).select("Value", "_id")
        return read_table(spark, sf_dir, NAMED[field]).join(own, exprs[field] == F.col("Value"), "left")

    of_line = [c for c in cols if c not in NEEDS and c != "Order_ID"]
    of_part = [c for c in cols if NEEDS.get(c) == {"part"}]
    with ExitStack() as files:
        with small_tasks(spark), freed_shuffles(spark):
            part = numbered("Product").select("p_partkey", *((F.col("_id") if c == "Product" else exprs[c]).alias(c) for c in of_part))
            # Lines of the channel without salespeople must come once, however many rows their supplier has.
            copy = F.row_number().over(Window.partitionBy("s_suppkey").orderBy("_id")) - 1
            sellers = numbered("Salesperson").filter(F.col("s_suppkey").isNotNull()).select("s_suppkey", F.col("_id").alias("s_name"), copy.alias("_copy"))
            customers = numbered("Customer").withColumn("c_name", F.col("_id"))
            orders = resolved_orders(spark, sf_dir, read_table(spark, sf_dir, "orders"), set(TABLE_NAMES), customers) \
                .withColumn("Channel", F.expr("substr(o_orderpriority, 3)"))
            lines = line_columns(read_table(spark, sf_dir, "lineitem")) \
                .join(part, F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"), "left") \
                .select(F.col("Order_ID").alias("_order"), *of_line, *of_part, "s_name", "_copy")
            with kept_rows(lines) as narrow:
                sold = F.col("Channel") != "LOW"
                view = narrow.join(orders, F.col("_order") == F.col("o_orderkey")).filter(sold | (F.coalesce("_copy", F.lit(0)) == 0))
                own = {c: F.col(c) for c in (*of_line, *of_part)} | {"Order_ID": F.col("_order"), "Salesperson": F.when(sold, F.col("s_name"))}
                coded = files.enter_context(kept_rows(view.select(*((exprs | own)[c].alias(c) for c in cols))))
        yield coded
