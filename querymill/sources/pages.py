"""Crawl snapshots and saved result pages as tables."""

from pyspark.sql import Column, DataFrame, functions as F

from querymill.defaults import MAX_CONTENT_LENGTH, MAX_SOURCES
from querymill.functions.text import clean_text, truncate
from querymill.functions.urls import unwrap_redirect
from querymill.operators.links import accepted_links
from querymill.sources.markup import page_text, result_links


def read_queries(df: DataFrame, text_col: str, id_col: str, ts_col: str | None = None) -> DataFrame:
    """Any table of texts as a query feed; arrival order is the id unless a time is given."""
    ts = F.col(ts_col).cast("timestamp") if ts_col else F.lit(None).cast("timestamp")
    return df.select(
        F.col(id_col).cast("bigint").alias("query_id"),
        F.col(id_col).cast("bigint").alias("arrival"),
        ts.alias("ts"),
        F.col(text_col).alias("query"),
    )


def fetch_failed(status: Column) -> Column:
    return status.isNull() | (status >= 400)


def scan_pages(pages: DataFrame, limit: int = MAX_CONTENT_LENGTH) -> DataFrame:
    """Stored pages to (page_id, url, title, content, success, error_message).

    One pass over ``html``; the column goes no further, so it never crosses an exchange. Pages that
    were not fetched (status missing or at least 400) are not parsed. Without a status column every
    page counts as fetched.
    """
    fetched = pages if "http_status" in pages.columns else pages.withColumn("http_status", F.lit(200))
    failed = fetch_failed(F.col("http_status"))
    parsed = fetched.select(
        "page_id", "url", "http_status", page_text(F.when(~failed, F.col("html"))).alias("_page")
    )
    why = F.concat(F.lit("HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit("No response")))
    return parsed.select(
        "page_id",
        "url",
        F.when(~failed, F.col("_page.title")).alias("title"),
        F.when(failed, "").otherwise(truncate(clean_text(F.col("_page.text")), limit)).alias("content"),
        (~failed).alias("success"),
        F.when(failed, why).alias("error_message"),
    )


def scan_result_pages(pages: DataFrame, engine: str, page_key: str = "query_id") -> DataFrame:
    """Saved result pages (``page_key``, ``html``) of one engine to accepted, numbered links."""
    raw = (
        pages.select(page_key, F.lit(engine).alias("engine"), result_links("html", F.lit(engine)).alias("_links"))
        .select(page_key, "engine", F.explode("_links").alias("_link"))
        .select(page_key, "engine", "_link.*")
        .withColumn("url", unwrap_redirect(F.col("url")) if engine == "b" else F.col("url"))
    )
    found = accepted_links(raw, page_key, MAX_SOURCES if engine == "b" else None)
    return found.select(page_key, "engine", "position", "title", "url", "snippet")
