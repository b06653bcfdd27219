"""F1-F8: the whitelisted filter language, compiled to one Catalyst predicate.

A filter dict maps one of 14 names to a value or a collection of values:
``None``, ``"All"``, ``""`` and empty collections mean "no filter"; unknown names
are ignored; a scalar is an equality, a collection an ``IN``; clauses are ANDed.
Literals are cast to the column's type at plan time (UI selections arrive as
strings, e.g. ``Year="2024"``), so the predicate stays a plain comparison that
Catalyst can push through the joins to the scans.
"""

from __future__ import annotations

import datetime as _dt
import decimal as _dec
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesspark.schema import FILTER_COLUMNS, NO_FILTER_SENTINELS

_NO_MATCH = object()


def _is_sentinel(value) -> bool:
    if isinstance(value, (list, tuple, set, frozenset)):
        return len(value) == 0
    return any(value is s or (s is not None and value == s) for s in NO_FILTER_SENTINELS)


def normalize_filters(filters: dict | None) -> dict[str, list]:
    """Whitelisted, sentinel-free clauses: view column -> list of values (len 1 = equality)."""
    out: dict[str, list] = {}
    for key, value in (filters or {}).items():
        column = FILTER_COLUMNS.get(key)
        if column is None or _is_sentinel(value):
            continue
        if isinstance(value, (list, tuple, set, frozenset)):
            values = [v for v in value if not _is_sentinel(v)]
            if not values:
                continue
            out[column] = values
        else:
            out[column] = [value]
    return out


def filter_columns(filters: dict | None) -> list[str]:
    """View columns a filter dict reads (to request them from the view builder).

    A Year filter also reads Order_Date, which carries the scan-level date range."""
    cols = list(normalize_filters(filters))
    return cols + ["Order_Date"] if "Year" in cols else cols


def _year_range(years: list, fields: dict) -> Column | None:
    """Redundant bounding range on Order_Date for a Year filter: Catalyst unwraps the date
    cast and pushes it to the scan (``GreaterThanOrEqual(o_orderdate, ...)``), so parquet
    row groups outside the years are skipped. The exact Year predicate is kept."""
    if "Order_Date" not in fields or not isinstance(fields["Order_Date"], T.DateType):
        return None
    ys = [y for y in years if isinstance(y, int) and 1 <= y < 9999]
    if not ys:
        return None
    return (F.col("Order_Date") >= F.lit(_dt.date(min(ys), 1, 1))) & \
        (F.col("Order_Date") < F.lit(_dt.date(max(ys) + 1, 1, 1)))


def _coerce(value, dtype: T.DataType):
    """Convert a literal to the column type; _NO_MATCH when it cannot equal any value."""
    try:
        if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            if isinstance(value, bool):
                return int(value)
            if isinstance(value, float):
                return int(value) if value.is_integer() else _NO_MATCH
            return int(str(value).strip())
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(dtype, T.DecimalType):
            return _dec.Decimal(str(value))
        if isinstance(dtype, T.DateType):
            return value if isinstance(value, _dt.date) else _dt.date.fromisoformat(str(value))
        if isinstance(dtype, T.StringType):
            return str(value)
    except (ValueError, TypeError, ArithmeticError):
        return _NO_MATCH
    return value


def filter_predicate(df: DataFrame, filters: dict | None) -> Column | None:
    """One boolean Column for the filter dict, or None when nothing filters."""
    clauses = []
    fields = {f.name: f.dataType for f in df.schema.fields}
    for column, values in normalize_filters(filters).items():
        if column not in fields:
            raise ValueError(f"filter column {column!r} is not in the DataFrame; request it from the view")
        typed = [v for v in (_coerce(v, fields[column]) for v in values) if v is not _NO_MATCH]
        if column == "Year" and typed:
            bound = _year_range(typed, fields)
            if bound is not None:
                clauses.append(bound)
        if not typed:
            clauses.append(F.lit(False))
        elif len(values) == 1:
            clauses.append(F.col(column) == F.lit(typed[0]))
        else:
            clauses.append(F.col(column).isin(typed))
    if not clauses:
        return None
    return reduce(lambda a, b: a & b, clauses)


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    pred = filter_predicate(df, filters)
    return df if pred is None else df.filter(pred)
