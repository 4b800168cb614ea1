"""Answer the misses of a batch from stored links and pages, and save the answers."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from querymill.defaults import MAX_SOURCES
from querymill.functions.text import iso_timestamp, page_title
from querymill.operators.answers import nest_pages, summarize
from querymill.operators.links import search_links
from querymill.providers import TextHook
from querymill.schemas import SCRAPED_CONTENT, scraped_record
from querymill.session import cut
from querymill.sources.pages import scan_pages
from querymill.sources.store import insert_results, to_store_row

# Messages of outcomes.
SUCCESS_MESSAGE = "Successfully processed your query"
FAILED_MESSAGE = "Failed to scrape any web content for your query"
FAILED_ERROR = "Web scraping failed"


def scrape_links(links: DataFrame, pages: DataFrame, as_of: Column, key: str = "query_id") -> DataFrame:
    """Each link with the page behind it; a link without a stored page is a failed scrape.

    The newest snapshot of each address is found from the narrow columns; only that one is parsed. Spark chooses by
    size how the wanted snapshots meet the crawl.
    """
    wanted = links.select("url").distinct()
    newest = pages.select("url", "page_id").join(wanted, "url", "left_semi").groupBy("url").agg(F.max("page_id").alias("page_id"))
    needed = pages.join(newest, ["url", "page_id"], "left_semi")
    fetched = F.struct("page_id", "title", "content", "success", "error_message")
    latest = scan_pages(needed).groupBy("url").agg(F.max_by(fetched, "page_id").alias("_page"))
    page = F.col("_page")
    record = scraped_record(
        F.col("url"),
        page_title(F.col("title"), page["title"], F.when(page["success"], F.col("url"))),
        page["content"],
        page["success"],
        F.when(page.isNull(), "HTTP No response").otherwise(page["error_message"]),
        as_of,
    )
    return (
        links.join(latest, "url", "left")
        .select(key, F.col("source_rank").alias("position"), record.alias("_record"))
        .select(key, "position", *[F.col(f"_record.{c}").alias(c) for c in SCRAPED_CONTENT.fieldNames()])
    )


def answer(
    misses: DataFrame,
    links: DataFrame,
    pages: DataFrame,
    as_of: Column,
    *,
    model: TextHook | None = None,
    max_sources: int = MAX_SOURCES,
    dedup: bool = False,
) -> DataFrame:
    """One answer per miss: pages of its first links, their summary, a message.

    ``links`` holds both engines (``engine`` a or b). A miss without links fails and is not saved.
    """
    links = links.join(misses.select("query_id"), "query_id", "left_semi")
    first, second = links.where(F.col("engine") == "a"), links.where(F.col("engine") == "b")
    # Links may come straight from parsing result pages, and are needed three times below.
    chosen = cut(search_links(first, second, "query_id", max_sources, dedup))
    nested = nest_pages(scrape_links(chosen, pages, as_of), "query_id", max_sources)
    none = F.array().cast(f"array<{SCRAPED_CONTENT.simpleString()}>")
    joined = misses.join(nested, "query_id", "left").withColumn(
        "scraped_content", F.coalesce("scraped_content", none)
    )
    found = F.size("scraped_content") > 0
    return summarize(joined, as_of, model).withColumns(
        {
            "summary": F.when(found, F.col("summary")),
            "success": found,
            "message": F.when(found, SUCCESS_MESSAGE).otherwise(FAILED_MESSAGE),
            "error": F.when(~found, FAILED_ERROR),
            "created_at": as_of.cast("timestamp"),
        }
    )


def ingest(spark: SparkSession, path: str, answers: DataFrame) -> None:
    """Save the answers that have pages."""
    rows = answers.where("success")
    if "execution_time" not in rows.columns:
        rows = rows.withColumn("execution_time", F.lit(None).cast("double"))
    insert_results(spark, path, to_store_row(rows))


def _iso(value: Column, kind: T.DataType) -> Column:
    """The value with every timestamp in it, however deep, as ISO text."""
    if isinstance(kind, T.TimestampType):
        return iso_timestamp(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _iso(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_iso(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), fields)
    return value


def export_json(df: DataFrame, path: str | None = None) -> DataFrame:
    """Every row as one JSON text, times in ISO form; written as text files if a path is given."""
    fields = [_iso(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    rows = df.select(F.to_json(F.struct(*fields)).alias("json"))
    if path:
        rows.write.mode("overwrite").text(path)
    return rows
