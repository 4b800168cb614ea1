"""Counters and rates over the outcome log; nothing is counted in a file that could drift.

Outcomes: ``invalid``, ``exact_hit``, ``similar_hit``, ``miss`` (answered and saved),
``unsaved`` (answered without the store) and ``failed`` (no pages).
"""

from pyspark.sql import Column, DataFrame, functions as F


def _ratio(part: Column, whole: Column, scale: float = 100.0) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)) * scale, F.lit(0.0))


def _with_rates(counts: DataFrame) -> DataFrame:
    answered = F.col("cache_hits") + F.col("cache_misses")
    return counts.select(
        "*",
        _ratio(F.col("total_execution_time"), F.col("total_queries"), 1.0).alias("average_execution_time"),
        _ratio(F.col("cache_hits"), answered).alias("cache_hit_rate"),
        _ratio(F.col("valid_queries"), F.col("total_queries")).alias("success_rate"),
    )


def stats_reference(outcomes: DataFrame, *group: Column | str) -> DataFrame:
    """The counters as the single-query engine moves them: only by saves and exact hits.

    Invalid queries leave before anything is counted and similar hits are not counted at all.
    """
    kind, saved = F.col("outcome"), F.col("outcome") == "miss"
    counts = outcomes.groupBy(*group).agg(
        F.count_if(saved).alias("total_queries"),
        F.count_if(saved & (F.col("status") == "valid")).alias("valid_queries"),
        F.count_if(saved & (F.col("status") == "invalid")).alias("invalid_queries"),
        F.count_if(kind == "exact_hit").alias("cache_hits"),
        F.count_if(saved).alias("cache_misses"),
        F.coalesce(F.sum(F.when(saved, F.col("pages_scraped"))), F.lit(0)).cast("bigint").alias("total_pages_scraped"),
        F.coalesce(F.sum(F.when(saved, F.col("execution_time"))), F.lit(0.0)).alias("total_execution_time"),
    )
    return _with_rates(counts)


def stats_full(outcomes: DataFrame, *group: Column | str) -> DataFrame:
    """The counters as their names say, over every outcome."""
    kind = F.col("outcome")
    counts = outcomes.groupBy(*group).agg(
        F.count("*").alias("total_queries"),
        F.count_if(kind != "invalid").alias("valid_queries"),
        F.count_if(kind == "invalid").alias("invalid_queries"),
        F.count_if(kind.isin("exact_hit", "similar_hit")).alias("cache_hits"),
        F.count_if(kind.isin("miss", "unsaved", "failed")).alias("cache_misses"),
        F.coalesce(F.sum("pages_scraped"), F.lit(0)).cast("bigint").alias("total_pages_scraped"),
        F.coalesce(F.sum("execution_time"), F.lit(0.0)).alias("total_execution_time"),
    )
    return _with_rates(counts)


def merge_counts(parts: DataFrame, *group: Column | str) -> DataFrame:
    """Counters of a whole from those of its parts, which either function above has made; rates are worked out anew."""
    sums = ("total_queries", "valid_queries", "invalid_queries", "cache_hits", "cache_misses", "total_pages_scraped", "total_execution_time")
    return _with_rates(parts.groupBy(*group).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(parts.schema[c].dataType).alias(c) for c in sums]))


def access_rollup(outcomes: DataFrame) -> DataFrame:
    """How often and when each stored result was last read."""
    return (
        outcomes.where(F.col("outcome").isin("exact_hit", "similar_hit"))
        .groupBy(F.coalesce("matched_hash", "query_hash").alias("query_hash"))
        .agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))
    )


def similarity_report(
    outcomes: DataFrame, store: DataFrame, threshold: float, judge_threshold: float, judge_available: bool
) -> DataFrame:
    counted = stats_reference(outcomes)
    stored = store.agg(F.count("*").alias("total_stored_queries"))
    return counted.select(
        F.lit(float(threshold)).alias("embedding_threshold"),
        F.lit(float(judge_threshold)).alias("semantic_threshold"),
        F.lit(judge_available).alias("judge_available"),
        (F.col("cache_hits") + F.col("cache_misses")).alias("total_queries_processed"),
        "cache_hits",
        "cache_misses",
        F.col("cache_hit_rate").alias("similarity_hit_rate_percent"),
        _scalar(stored).alias("total_stored_queries"),
    )


def _scalar(one_row: DataFrame) -> Column:
    """A one-row, one-column aggregate as a scalar subquery."""
    return one_row.scalar()
