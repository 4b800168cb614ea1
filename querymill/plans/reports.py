"""Statistics over outcome log and store."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from querymill.functions.text import bytes_to_mb
from querymill.operators.stats import stats_full, stats_reference
from querymill.sources.store import store_size


def report(outcomes: DataFrame, size: DataFrame, full: bool = False) -> DataFrame:
    """Counters, rates and store size in one row; ``last_updated`` is the newest outcome's time.

    ``size`` is one row (``total_entries``, ``total_size_bytes``), see ``store_size``.
    """
    counted = (stats_full if full else stats_reference)(outcomes)
    newest = outcomes.agg(F.max("ts").alias("last_updated"))
    return counted.select(
        "total_queries", "valid_queries", "invalid_queries", "cache_hits", "cache_misses", "cache_hit_rate",
        "average_execution_time", "total_pages_scraped",
        size.select("total_entries").scalar().alias("total_entries"),
        bytes_to_mb(size.select("total_size_bytes").scalar()).alias("cache_size_mb"),
        newest.scalar().alias("last_updated"),
    )


def stats(spark: SparkSession, outcomes: DataFrame, store_path: str, full: bool = False) -> DataFrame:
    return report(outcomes, store_size(spark, store_path), full)


def write_stats(counters: DataFrame, path: str) -> None:
    """Keep a snapshot of the counters as JSON."""
    counters.write.mode("overwrite").json(path)
