"""File exports of named result views and the long-to-wide reshape.

Results are written by the executors (one file per partition) to a shared
folder; nothing is gathered on the driver. The reference's workbook of sheets
becomes one directory per named view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesspark.operators import distribution as D
from salesspark.operators import metrics as M


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header row, UTF-8, no index column."""
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def safe_name(name: str) -> str:
    """A view name as a folder name."""
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name.strip()).strip("_") or "view"


def write_views(views: dict[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """Every named view into ``{root}/{safe name}``; returns name -> path. Two names for one folder are an error."""
    folders: dict[str, str] = {}
    for name in views:
        other = folders.setdefault(safe_name(name).lower(), name)
        if other != name:
            raise ValueError(f"{other!r} and {name!r} would share the folder {safe_name(name)!r}")
    out = {}
    for name, df in views.items():
        path = f"{root.rstrip('/')}/{safe_name(name)}"
        writer = df.write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(path)
        out[name] = path
    return out


def read_views(spark, paths: dict[str, str], schemas: dict[str, StructType], fmt: str = "parquet") -> dict[str, DataFrame]:
    """What ``write_views`` has written, with the schemas it was written with."""
    reader = {name: spark.read.schema(schemas[name]) for name in paths}
    return {name: (reader[name].option("header", True).csv(path) if fmt == "csv" else reader[name].format(fmt).load(path))
            for name, path in paths.items()}


def kept_view(view: DataFrame, path: str) -> DataFrame:
    """The view as Parquet at ``path``: its joins run once, and each dataset made from it reads only its own columns."""
    view.write.parquet(path)
    return view.sparkSession.read.schema(view.schema).parquet(path)


def export_catalog(view: DataFrame, filters: dict | None = None) -> dict[str, Callable[[], DataFrame]]:
    """The seven exportable datasets (lazy builders, like the reference's menu)."""
    return {
        "Sales by Region": lambda: M.sales_by_dimension(view, "Region", filters),
        "Sales by Category": lambda: M.sales_by_dimension(view, "Category", filters),
        "Top 20 Customers": lambda: M.top_customers(view, 20, filters),
        "Top 20 Products": lambda: M.top_products(view, 20, filters),
        "Salesperson Leaderboard": lambda: M.salesperson_leaderboard(view, filters),
        "ABC Analysis": lambda: D.abc_analysis(view, filters),
        "Monthly Trend": lambda: M.trend(view, "Month", filters),
    }


def pivot_wide(df: DataFrame, index: str, columns: str, values: str, keys: list | None = None) -> DataFrame:
    """One row per ``index``, one column per distinct ``columns`` value.

    A duplicate (index, column) pair is an error, as in a pandas pivot; the check
    is part of the same aggregation (``raise_error`` fires inside the job), so the
    pivot is one pass. The distinct column values become the schema: pass ``keys`` to
    say which (a value outside them is an error too, nothing is left out), else Spark looks them up and refuses more than
    ``spark.sql.pivotMaxValues``.
    """
    if keys is None:
        found = df.groupBy(index).pivot(columns).agg(F.first(values)).columns
        keys = [c for c in found if c != index]
    known = F.coalesce(F.col(columns).isin(*keys), F.lit(False)) if keys else F.lit(True)
    outside = F.raise_error(F.concat(F.lit(f"{columns} outside the columns of the pivot: "), F.coalesce(F.col(columns).cast("string"), F.lit("null"))))
    df = df.withColumn(columns, F.when(known, F.col(columns)).otherwise(outside.cast(df.schema[columns].dataType)))
    wide = df.groupBy(index).pivot(columns, keys).agg(F.first(values).alias("v"), F.count(F.lit(1)).alias("n"))
    dup = F.greatest(*[F.coalesce(F.col(f"{k}_n"), F.lit(0)) for k in keys]) if keys else F.lit(0)
    checked = wide.filter(F.when(dup > 1, F.raise_error(F.lit(
        f"duplicate ({index}, {columns}) pairs: cannot pivot without aggregation"))).otherwise(F.lit(True)))
    return checked.select(index, *[F.col(f"{k}_v").alias(str(k)) for k in keys]).orderBy(index)
