"""From the outcomes of a batch and the answers of its misses to a complete log and to one response per query."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from querymill.plans.answer import FAILED_ERROR, FAILED_MESSAGE, answer, ingest
from querymill.plans.resolve import resolve
from querymill.providers import TextHook
from querymill.schemas import SCRAPED_CONTENT, SUMMARY
from querymill.session import cut
from querymill.sources.store import scan_store

FOUND = ("exact_hit", "similar_hit")
ANSWERED = ("miss", "unsaved")


def settle(outcomes: DataFrame, answers: DataFrame) -> DataFrame:
    """``outcomes`` of ``resolve`` as they stand once its misses have been answered (``answer``), with success, pages_scraped and execution_time.

    Only an answered miss is stored. One without pages is ``failed``, and so are the later queries of its hash in the
    batch: each of them is asked anew and finds as little. Rows of the log can be counted by ``stats_full`` and ``stats_reference``.
    """
    taken = F.col("execution_time") if "execution_time" in answers.columns else F.lit(None)
    own = answers.select(
        F.col("query_id").alias("_id"), F.col("success").alias("_won"), F.col("message").alias("_said"), F.col("error").alias("_wrong"),
        F.size(F.filter("scraped_content", lambda p: p["success"])).alias("_pages"), taken.cast("double").alias("_taken"),
    )
    mine = F.col("outcome").isin(*ANSWERED)
    rows = outcomes.join(own, mine & (F.col("query_id") == F.col("_id")), "left").drop("_id")
    # Written, so that the repeats of a query asked very often can be split in the join.
    lost = cut(rows.where((F.col("outcome") == "miss") & ~F.coalesce("_won", F.lit(False))).select(F.col("query_hash").alias("_lost")).distinct())
    rows = rows.join(lost, (F.col("outcome") == "exact_hit") & (F.col("query_hash") == F.col("_lost")), "left")
    failed = F.coalesce(mine & ~F.coalesce("_won", F.lit(False)), F.lit(False)) | F.col("_lost").isNotNull()
    answered = mine & ~failed
    return rows.select(
        *[f"`{c}`" for c in outcomes.columns if c not in ("outcome", "matched_hash", "message", "error", "success", "pages_scraped", "execution_time")],
        F.when(failed, "failed").otherwise(F.col("outcome")).alias("outcome"),
        F.when(~failed, F.col("matched_hash")).alias("matched_hash"),
        F.when(failed, FAILED_MESSAGE).when(answered, F.col("_said")).otherwise(F.col("message")).alias("message"),
        F.when(failed, FAILED_ERROR).when(answered, F.col("_wrong")).otherwise(F.col("error")).alias("error"),
        (answered | F.col("outcome").isin(*FOUND) & ~failed).alias("success"),
        F.when(answered, F.col("_pages")).otherwise(0).alias("pages_scraped"),
        F.coalesce("_taken", F.lit(0.0)).alias("execution_time"),
    )


def respond(settled: DataFrame, answers: DataFrame, store: DataFrame) -> DataFrame:
    """One row per query: query_id, success, message, error, cache_hit, similar_query_used, execution_time and the result itself.

    Misses deliver their own answer, hits the stored result that answers them. ``store`` is the store after the batch was saved, so that a
    repeat finds what its first query left there. Invalid and failed queries have no result.
    """
    fields = ("query", "query_hash", "summary", "scraped_content", "created_at")
    content = f"array<{SCRAPED_CONTENT.simpleString()}>"

    def result() -> Column:
        kinds = {"summary": SUMMARY.simpleString(), "scraped_content": content, "created_at": "timestamp"}
        return F.struct(*[F.col(f).cast(kinds.get(f, "string")).alias(f) for f in fields]).alias("_result")

    made = answers.select(F.col("query_id").alias("_id"), result())
    held = store.select(F.col("query_hash").alias("_hash"), F.col("query").alias("_asked"), result().alias("_stored"))
    hit, similar = F.col("outcome").isin(*FOUND), F.col("outcome") == "similar_hit"
    rows = settled.join(made, F.col("outcome").isin(*ANSWERED) & (F.col("query_id") == F.col("_id")), "left")
    rows = rows.join(held, hit & (F.col("matched_hash") == F.col("_hash")), "left")
    return rows.select(
        "query_id", "success", "message", "error", hit.alias("cache_hit"), F.when(similar, F.col("_asked")).alias("similar_query_used"), "execution_time",
        F.when(hit, F.col("_stored")).otherwise(F.col("_result")).alias("result"),
    )


def process(
    spark: SparkSession, store_path: str, queries: DataFrame, links: DataFrame, pages: DataFrame, as_of: Column,
    *, model: TextHook | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """A batch of queries from end to end: resolve, answer what nothing answers, save, complete the log, deliver.

    Returns the completed log (``settle``) and the responses (``respond``). ``options`` are those of ``resolve``; with ``use_store=False`` nothing is looked up or saved.
    The outcomes, the answers and the log are written once each, so no model is asked twice. Running it again answers from the store what was saved before.
    """
    outcomes = cut(resolve(queries, scan_store(spark, store_path), **options))
    open_ = outcomes.where(F.col("outcome").isin(*ANSWERED)).drop("message", "error")
    answers = cut(answer(open_, links, pages, as_of, model=model))
    ingest(spark, store_path, answers.where("outcome = 'miss'"))
    settled = cut(settle(outcomes, answers))
    return settled, respond(settled, answers, scan_store(spark, store_path))
