"""Sources: the star schema, the flattened sales view and external readers."""

from salesspark.sources.star import STAR_SCHEMAS, read_star, view_from_star
from salesspark.sources.tables import sales_view, read_table, TABLE_NAMES
from salesspark.sources.view import raw_sales, cache_view, refresh_view, register_view, run_query

__all__ = [
    "STAR_SCHEMAS", "read_star", "view_from_star", "sales_view", "read_table", "TABLE_NAMES",
    "raw_sales", "cache_view", "refresh_view", "register_view", "run_query",
]
