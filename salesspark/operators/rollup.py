"""Many groupings of the lines at once, with exact distinct order counts and without a copy of a line per grouping.

Distinct counts do not add up from group to group, unless an order can lie in one group only. So the lines are reduced to one row per order
and combination of the columns that never vary within an order (of the usual filters: all but the product's). For each choice of the columns
that do vary, another reduction leaves a row per order and value of these and of the constant columns asked for with them. In either, every
column is constant per row: counting rows counts orders, and all measures add up. Small groupings are then rolled up from a common cube, the
others each from the rows of their orders.

Which columns vary is read from the data, so an order that has lines in two regions is counted right, too: region then counts as
one of the columns that vary. A few lines give a first guess; the rows that it leads to, more than one of some order or not, tell if it missed any.

Disk holds the rows of orders for as long as groupings are taken from them, and the shuffle of one grouping (or one cube) at a time: each is brought
to its result, which ``reduced`` may make small, before the next begins, and its shuffle files go at once. Rows are dealt in parts of bounded
size (``session.small_tasks``), which bounds a task's sorts and hash tables, however many lines there are.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesspark.session import ensure_checkpoint_dir, freed_shuffles, small_tasks
from salesspark.sources.stored import kept_rows

#: A common cube is worth it if it has at most this share of the rows that it comes from, by the product of its columns' values.
CUBE_SHARE = 1 / 8
#: Lines that the driver looks at for the first guess at the columns that vary.
GUESS_LINES = 10_000


@dataclass(frozen=True)
class Grouping:
    name: int  # carried as ``_gid``
    columns: tuple[str, ...]


def _sums(measures: dict[str, str]) -> list:
    return [F.sum(m).alias(m) for m in measures]


def varying_columns(orders: DataFrame, order: str, columns: list[str]) -> tuple[set[str], dict[str, int], int]:
    """Columns with more than one value in some order (null is a value), the approximate number of values of each, and the rows."""
    differs = [(~F.min(c).eqNullSafe(F.max(c)) | ~F.count(c).isin(F.lit(0), F.count(F.lit(1)))).alias(f"v_{c}") for c in columns]
    values = [F.min(c).alias(f"d_{c}") for c in columns]
    per_order = orders.groupBy(order).agg(*differs, *values, F.count(F.lit(1)).alias("_rows"))
    own = per_order.agg(*(F.max(f"v_{c}").alias(f"v_{c}") for c in columns), *(F.approx_count_distinct(f"d_{c}").alias(f"d_{c}") for c in columns),
                        F.count(F.lit(1)).alias("_orders")).first()
    return {c for c in columns if own[f"v_{c}"]}, {c: max(1, own[f"d_{c}"]) for c in columns}, own["_orders"]


def _guessed(lines: DataFrame, order: str, columns: list[str]) -> set[str]:
    """Columns seen to vary within an order among the first lines."""
    first, found = {}, set()
    for row in lines.select(order, *columns).filter(F.col(order).isNotNull()).take(GUESS_LINES):
        found |= {c for c, v in zip(columns, row[1:], strict=True) if first.setdefault((row[0], c), v) != v}
    return found


def rollups(lines: DataFrame, order: str, groupings: list[Grouping], measures: dict[str, str], distinct: str = "Orders",
            reduced: Callable[[DataFrame, Grouping], DataFrame] | None = None) -> DataFrame:
    """One row per grouping and group: ``_gid``, the grouping's columns (null where it has none), ``measures`` (sums; new name: SQL expression of a
    line) and ``distinct``, the number of different non-null ``order`` values. ``reduced`` makes of a grouping's rows what is wanted of them.

    ``lines`` are read once per choice of varying columns, each time some columns of them: keep them (``stored.kept_rows``) if they are dear to make."""
    spark = lines.sparkSession
    ensure_checkpoint_dir(spark)
    columns = sorted({c for g in groupings for c in g.columns})
    kind = {c: F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in columns}
    lines = lines.select(order, *columns, *(F.expr(e).alias(m) for m, e in measures.items()))

    def listed(rows: DataFrame, g: Grouping) -> DataFrame:
        out = rows.groupBy(*g.columns).agg(*_sums(measures), F.sum(distinct).alias(distinct))
        out = out.select(F.lit(g.name).alias("_gid"), *(F.col(c) if c in g.columns else kind[c] for c in columns), *measures, distinct)
        return reduced(out, g) if reduced else out

    def united(parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    parts = []
    with small_tasks(spark), freed_shuffles(spark), ExitStack() as files:
        varying = _guessed(lines, order, columns)
        constants = [c for c in columns if c not in varying]
        orders = files.enter_context(kept_rows(lines.groupBy(order, *constants).agg(*_sums(measures))))
        known = orders.filter(F.col(order).isNotNull())
        missed = set()
        if not known.groupBy(order).count().filter("count > 1").isEmpty():
            missed = varying_columns(known, order, constants)[0]
            varying |= missed
        own = orders.agg(*(F.approx_count_distinct(c).alias(c) for c in constants), F.count(F.lit(1)).alias("_rows")).first().asDict()
        if varying:
            own |= lines.agg(*(F.approx_count_distinct(c).alias(c) for c in varying)).first().asDict()
        values = {c: max(1, own[c]) for c in columns}

        for choice in sorted({tuple(c for c in g.columns if c in varying) for g in groupings}):
            own_groupings = [g for g in groupings if tuple(c for c in g.columns if c in varying) == choice]
            constant = sorted({c for g in own_groupings for c in g.columns} - set(choice))
            rows = orders
            if choice or missed:
                rows = (lines if choice else orders).groupBy(order, *constant, *choice).agg(*_sums(measures))
            rows = rows.withColumn(distinct, F.when(F.col(order).isNotNull(), 1).otherwise(0)).drop(order)
            cube, size = list(choice), reduce(lambda a, c: a * values[c], choice, 1)
            for c in sorted(constant, key=lambda c: values[c]):
                if size * values[c] <= CUBE_SHARE * own["_rows"]:
                    cube.append(c)
                    size *= values[c]
            inside = [g for g in own_groupings if set(g.columns) <= set(cube)]
            inside = inside if len(inside) > 1 else []
            single = [g for g in own_groupings if g not in inside]
            large = any(reduce(lambda a, c: a * values[c], g.columns, 1) > CUBE_SHARE * own["_rows"] for g in single)
            with ExitStack() as shared:
                if choice:
                    files.close()
                    if large or len(single) + bool(inside) > 1:  # a large grouping's shuffle must not stand beside that by order
                        rows = shared.enter_context(kept_rows(rows))
                if inside:
                    common = rows.groupBy(*cube).agg(*_sums(measures), F.sum(distinct).alias(distinct)).checkpoint(eager=True)
                    parts.append(united([listed(common, g) for g in inside]).checkpoint(eager=True))
                parts += [listed(rows, g).checkpoint(eager=True) for g in single]
    return united(parts)
