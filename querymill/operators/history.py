"""Listing and searching stored results."""

from pyspark.sql import Column, DataFrame, functions as F

from querymill.defaults import HISTORY_LIMIT


def contains_term(term: str, *columns: str) -> Column:
    """Case-insensitive substring test over any of the columns."""
    needle = F.lower(F.lit(term))
    found = F.lit(False)
    for name in columns:
        found = found | F.coalesce(F.contains(F.lower(name), needle), F.lit(False))
    return found


def list_history(store: DataFrame, limit: int | None = HISTORY_LIMIT, search: str | None = None) -> DataFrame:
    """Newest first, matching rows only if a term is given, then cut."""
    rows = store if search is None else store.where(contains_term(search, "query", "document"))
    ordered = rows.select(
        F.col("query_hash").alias("id"), "query", "status", "confidence", "created_at",
        "execution_time", "pages_scraped", "total_content_length", "document",
    ).orderBy(F.desc("created_at"), "id")
    return ordered if limit is None else ordered.limit(limit)
