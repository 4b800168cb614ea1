"""From scraped pages to one answer per query."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from querymill.functions.summaries import (
    build_prompt, extractive_summary, meaningful_pages, model_summary,
)
from querymill.providers import TextHook, text_hook
from querymill.schemas import SCRAPED_CONTENT


def nest_pages(scraped: DataFrame, key: str = "query_hash", limit: int | None = None) -> DataFrame:
    """One row per query with its pages as an array in position order.

    With a ``limit``, a query keeps its first so many pages, and as the cut runs before the shuffle, a key with
    any number of rows sends no more than that of them per task.
    """
    order = Window.partitionBy(key).orderBy("position")
    cut = scraped.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit) if limit else scraped
    page = F.struct("position", *SCRAPED_CONTENT.fieldNames())
    return (
        cut.groupBy(key)
        .agg(F.sort_array(F.collect_list(page)).alias("_pages"))
        .select(
            key,
            F.transform("_pages", lambda p: F.struct(*[p[c].alias(c) for c in SCRAPED_CONTENT.fieldNames()]))
            .cast(f"array<{SCRAPED_CONTENT.simpleString()}>")
            .alias("scraped_content"),
        )
    )


def page_rollup(scraped: DataFrame, key: str = "query_hash") -> DataFrame:
    """Pages scraped, their total length and the success rate per query."""
    return scraped.groupBy(key).agg(
        F.count_if("success").alias("pages_scraped"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("content_length"))), F.lit(0)).alias("total_content_length"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
    )


def array_rollup(pages: Column) -> tuple[Column, Column, Column]:
    """The same three numbers from a nested array; the rate is 0 where there are no pages."""
    good = F.filter(pages, lambda p: p["success"])
    total = F.aggregate(good, F.lit(0).cast("bigint"), lambda acc, p: acc + p["content_length"])
    rate = F.when(F.size(pages) > 0, F.size(good) / F.size(pages)).otherwise(0.0)
    return F.size(good), total, rate


def scrape_totals(scraped: DataFrame) -> DataFrame:
    return scraped.agg(
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("content_length"))), F.lit(0)).alias("total_chars"),
    )


def summarize(df: DataFrame, as_of: Column, model: TextHook | None = None) -> DataFrame:
    """Add ``summary`` from ``query`` and ``scraped_content``.

    Without a model the summary is extractive. With one, rows without meaningful pages are not sent
    to it, and a failed call gives the error summary.
    """
    query, pages = F.col("query"), F.col("scraped_content")
    if model is None:
        return df.withColumn("summary", extractive_summary(query, pages, as_of))
    meaningful = meaningful_pages(pages)
    prompt = F.when(F.size(meaningful) > 0, build_prompt(query, meaningful))
    asked = df.withColumn("_answer", text_hook(model)(prompt))
    answer = F.col("_answer")
    return asked.withColumn(
        "summary", model_summary(query, pages, answer["reply"], answer["error"], as_of)
    ).drop("_answer")
