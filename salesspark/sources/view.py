"""Column-pruned row fetch and result reuse on the sales view."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from salesspark.functions.filters import apply_filters


def raw_sales(view: DataFrame, filters: dict | None = None, columns: list[str] | None = None) -> DataFrame:
    """Filtered rows, projected to ``columns`` (all when None); filters and pruning reach the scan."""
    out = apply_filters(view, filters)
    return out.select(*columns) if columns else out


VIEW_NAME = "vw_app_sales"


def register_view(view: DataFrame, name: str = VIEW_NAME) -> str:
    """Expose the view to SQL under the reference's view name."""
    view.createOrReplaceTempView(name)
    return name


def run_query(spark, sql: str, params: dict | None = None) -> DataFrame:
    """S3: parameterised SQL (``:name`` markers bound as literals, never spliced into the text)."""
    return spark.sql(sql, args=params or {})


def cache_view(view: DataFrame) -> DataFrame:
    """Keep a view for reuse across many operators (the reference's one-hour result cache).

    MEMORY_AND_DISK so that a lost executor only costs a recompute of its blocks.
    """
    return view.persist(StorageLevel.MEMORY_AND_DISK)


def refresh_view(view: DataFrame) -> DataFrame:
    """Drop cached blocks so the next action re-reads the sources (manual cache clear)."""
    return view.unpersist(blocking=False)
