"""Second layer of the similarity look-up: let a judge walk the candidates in score order."""

from pyspark.sql import Column, DataFrame, functions as F

from querymill.defaults import JUDGE_THRESHOLD, MAX_CANDIDATES
from querymill.functions.replies import parse_verdict
from querymill.providers import TextHook, text_hook


def accepts(verdict: Column, threshold: float = JUDGE_THRESHOLD) -> Column:
    return F.coalesce(
        verdict["is_similar"] & (verdict["confidence"] >= threshold) & ~F.isnan(verdict["confidence"]), F.lit(False)
    )


def judged_matches(
    candidates: DataFrame,
    judge: TextHook | None,
    *,
    limit: int = 1,
    key: str = "query_id",
    query: str = "query",
    stored_query: str = "stored_query",
    store_key: str = "query_hash",
    depth: int | None = None,
    threshold: float = JUDGE_THRESHOLD,
) -> DataFrame:
    """The first ``limit`` candidates per query that the judge accepts.

    ``candidates`` holds at most ``depth`` rows per query (a similarity join with that k); unless given, it is
    twice the limit, and MAX_CANDIDATES at least. They are
    nested into one row per query, and rank r is judged only where fewer than ``limit`` lower ranks
    were accepted: as many model calls as a loop that stops early, in one pass and without a further
    shuffle. Without a judge the best ``limit`` candidates are taken.
    """
    depth = max(MAX_CANDIDATES, 2 * limit) if depth is None else depth
    if judge is None:
        return candidates.where(F.col("rank") <= limit).select(
            key, store_key, "score", F.lit(None).cast("double").alias("semantic_similarity"),
            F.lit(None).cast("string").alias("semantic_reason"), "rank",
        )
    hook = text_hook(judge)
    rows = (
        candidates.where(F.col("rank") <= depth)
        .groupBy(key)
        .agg(
            F.first(query).alias("_query"),
            F.sort_array(
                F.collect_list(F.struct("rank", "score", store_key, F.col(stored_query).alias("stored")))
            ).alias("_found"),
        )
        .withColumn("_taken", F.lit(0))
    )
    verdicts = []
    for i in range(depth):
        name = f"_verdict{i}"
        candidate = F.get(F.col("_found"), F.lit(i))
        wanted = candidate.isNotNull() & (F.col("_taken") < limit)
        rows = rows.withColumn("_reply", hook(F.when(wanted, F.col("_query")), F.when(wanted, candidate["stored"])))
        rows = rows.withColumn(
            name, F.when(wanted, parse_verdict(F.col("_reply")["reply"], F.col("_reply")["error"]))
        ).drop("_reply")
        rows = rows.withColumn("_taken", F.col("_taken") + accepts(F.col(name), threshold).cast("int"))
        verdicts.append(name)
    judged = F.arrays_zip("_found", F.array(*verdicts).alias("_verdicts"))
    return (
        rows.select(key, F.explode(judged).alias("_row"))
        .select(
            key,
            F.col(f"_row._found.{store_key}").alias(store_key),
            F.col("_row._found.score").alias("score"),
            F.col("_row._verdicts").alias("_verdict"),
            F.col("_row._found.rank").alias("rank"),
        )
        .where(accepts(F.col("_verdict"), threshold))
        .select(
            key, store_key, "score", F.col("_verdict.confidence").alias("semantic_similarity"),
            F.col("_verdict.reason").alias("semantic_reason"), "rank",
        )
    )


def similar_info(outcomes: DataFrame, store: DataFrame) -> DataFrame:
    """What a similar hit tells about the stored query it was answered with."""
    original = store.select(F.col("query_hash").alias("matched_hash"), F.col("query").alias("original_query"))
    return (
        outcomes.where(F.col("outcome") == "similar_hit")
        .join(original, "matched_hash")
        .select(
            "query_id", "original_query", F.col("similarity_score").alias("embedding_similarity"),
            "semantic_similarity", "semantic_reason",
        )
    )
