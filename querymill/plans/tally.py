"""Counters kept batch by batch, so that a report adds up a few rows a batch and not the whole outcome log.

A batch leaves the counts, sums and maxima of its own outcomes under its number. A batch that is run again writes the same once more in their place, so nothing counts twice.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from querymill.operators.stats import access_rollup, merge_counts, stats_full, stats_reference


def keep(outcomes: DataFrame, path: str, batch_id: int, *group: str) -> None:
    """Leave what a batch adds to both readings of the counters, for each ``group``, and to the accesses of stored results."""
    parts = {"reference": stats_reference(outcomes, *group), "full": stats_full(outcomes, *group), "access": access_rollup(outcomes)}
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")


def kept_counters(spark: SparkSession, path: str, *group: str, full: bool = False) -> DataFrame:
    """What ``stats_full`` or ``stats_reference`` give over the outcomes of all batches."""
    return merge_counts(spark.read.parquet(f"{path}/{'full' if full else 'reference'}"), *group)


def kept_access(spark: SparkSession, path: str) -> DataFrame:
    """What ``access_rollup`` gives over the outcomes of all batches."""
    parts = spark.read.parquet(f"{path}/access")
    return parts.groupBy("query_hash").agg(F.sum("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"))
