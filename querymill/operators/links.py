"""Search result links: positions, the second engine, the cut."""

from pyspark.sql import DataFrame, Window, functions as F

from querymill.defaults import MAX_SOURCES
from querymill.functions.text import strip
from querymill.functions.urls import is_valid_url

MIN_TITLE = {"a": 1, "b": 3}


def accepted_links(raw: DataFrame, page_key: str = "page_id", limit: int | None = None) -> DataFrame:
    """Drop links without title or address or to unwanted places; number the rest in page order.

    The number counts accepted links only. ``raw`` needs ``dom_order``, ``title`` and ``url``.
    """
    least = F.coalesce(*[F.when(F.col("engine") == e, F.lit(n)) for e, n in MIN_TITLE.items()], F.lit(1))
    kept = raw.where(
        (F.length(strip(F.col("title"))) >= least) & (F.col("url") != "") & is_valid_url(F.col("url"))
    )
    order = Window.partitionBy(page_key, "engine").orderBy("dom_order")
    numbered = kept.withColumn("position", F.row_number().over(order))
    return numbered.where(F.col("position") <= limit) if limit else numbered


def first_links(links: DataFrame, key: str = "query_id", limit: int = MAX_SOURCES, dedup: bool = False) -> DataFrame:
    """The first ``limit`` links per query, engine a before engine b; ``source_rank`` numbers them."""
    if dedup:
        links = (
            links.groupBy(key, "url")
            .agg(F.min(F.struct("engine", "position", *[c for c in links.columns if c not in (key, "url", "engine", "position")])).alias("_first"))
            .select(key, "url", "_first.*")
        )
    order = Window.partitionBy(key).orderBy("engine", "position")
    return links.withColumn("source_rank", F.row_number().over(order)).where(F.col("source_rank") <= limit)


def search_links(
    first: DataFrame, second: DataFrame, key: str = "query_id", limit: int = MAX_SOURCES, dedup: bool = False
) -> DataFrame:
    """Links of the first engine; those of the second only for queries the first left short of ``limit``.

    As the first engine's links come first and the cut is at the same number, the best ``limit`` of
    all links are just that. Only with ``dedup``, which may shorten a full list again, the short
    queries have to be told apart.
    """
    if not dedup:
        return first_links(first.unionByName(second), key, limit)
    full = first.groupBy(key).agg(F.count("*").alias("_found")).where(F.col("_found") >= limit)
    return first_links(first.unionByName(second.join(full, key, "left_anti")), key, limit, dedup=True)
