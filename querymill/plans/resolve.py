"""Resolve a batch of queries against the store as it was when the batch began."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from querymill.defaults import JUDGE_THRESHOLD, MAX_CANDIDATES, SIMILARITY_THRESHOLD
from querymill.functions.classify import classify_heuristic, parse_classification
from querymill.functions.text import normalize_query, query_hash, strip
from querymill.operators.matching import judged_matches
from querymill.operators.similarity import similarity_join
from querymill.providers import TextHook, embed_hook, text_hook
from querymill.schemas import CLASSIFICATION, OUTCOMES
from querymill.session import cut

# Messages of outcomes.
INVALID_MESSAGE = "Invalid query: "
EMPTY_REASON = "Query cannot be empty"
EXACT_MESSAGE = "Found cached result for your query"


def classify(queries: DataFrame, hook: TextHook | None = None, column: str = "query") -> DataFrame:
    """Add ``status``, ``confidence``, ``reason``, ``suggested_improvements`` for any text column."""
    if hook is None:
        verdict = classify_heuristic(F.col(column)).cast(CLASSIFICATION)
        return queries.withColumn("_class", verdict).select("*", "_class.*").drop("_class")
    asked = queries.withColumn("_answer", text_hook(hook)(F.col(column)))
    verdict = parse_classification(F.col(column), F.col("_answer.reply"))
    return asked.withColumn("_class", verdict).select("*", "_class.*").drop("_class", "_answer")


def validate(queries: DataFrame, hook: TextHook | None = None, column: str = "query") -> DataFrame:
    """Report on raw queries; no reason and no suggestions read as empty."""
    return classify(queries, hook, column).withColumns(
        {
            "reason": F.coalesce("reason", F.lit("")),
            "suggested_improvements": F.coalesce("suggested_improvements", F.array().cast("array<string>")),
        }
    )


def prepare(queries: DataFrame, hook: TextHook | None = None) -> DataFrame:
    """Normalise, hash, classify."""
    ready = queries.withColumn("query", normalize_query(F.col("query"))).withColumn(
        "query_hash", query_hash(F.col("query"))
    )
    # A request without text is turned away before it is classified.
    asked = classify(ready, hook)
    empty = ~F.coalesce(F.length(strip(F.col("query"))) > 0, F.lit(False))
    return asked.withColumns({
        "status": F.when(empty, "invalid").otherwise(F.col("status")),
        "reason": F.when(empty, EMPTY_REASON).otherwise(F.col("reason")),
    })


def embed(queries: DataFrame, hook: Callable | None = None) -> DataFrame:
    """Add ``embedding``; every distinct text is embedded once, however often it was asked."""
    texts = queries.select("query").distinct()
    # Written, so that a text asked very often can be split in the join.
    vectors = cut(texts.withColumn("embedding", embed_hook(hook)(F.col("query"))))
    return queries.join(vectors, "query", "left")


def resolve(
    queries: DataFrame,
    store: DataFrame,
    *,
    classifier: TextHook | None = None,
    embedder: Callable | None = None,
    judge: TextHook | None = None,
    use_store: bool = True,
    threshold: float = SIMILARITY_THRESHOLD,
    judge_threshold: float = JUDGE_THRESHOLD,
    metric: str = "cosine",
    score: str = "reference",
) -> DataFrame:
    """One outcome per query: ``invalid``, ``exact_hit``, ``similar_hit``, ``miss``, ``unsaved``.

    ``queries`` may bring an ``embedding`` column; otherwise the hook makes one for those queries
    that reach the similarity stage. Within the batch the first miss of a hash is the miss and later
    queries of that hash are exact hits on it; similar hits are not stored, so their repeats are
    similar hits again. Beside the outcome columns the result carries ``confidence``, ``reason`` and
    ``embedding``, which saving a miss needs.
    """
    given = "embedding" in queries.columns
    keep = ["query_id", "arrival", "ts", "query", "query_hash", "status", "confidence", "reason"]
    ready = prepare(queries, classifier).select(*keep, *(["embedding"] if given else []))
    if not use_store:
        valid = F.col("status") != "invalid"
        fresh = _outcome(ready.where(valid) if given else embed(ready.where(valid), embedder), "unsaved")
        return fresh.unionByName(_invalid(ready))

    known = store.select("query_hash", F.lit(True).alias("_stored"))
    # Everything below starts from these rows several times; they are worked out once.
    routed = cut(ready.join(known, "query_hash", "left"))
    valid, stored = F.col("status") != "invalid", F.col("_stored").isNotNull()
    hits = _outcome(
        routed.where(valid & stored).drop("_stored"), "exact_hit", F.col("query_hash"), F.lit(EXACT_MESSAGE)
    )
    misses = routed.where(valid & ~stored).drop("_stored")
    misses = misses if given else cut(embed(misses, embedder))
    return (
        _invalid(routed.drop("_stored"))
        .unionByName(hits)
        .unionByName(_similar_or_miss(misses, store, judge, threshold, judge_threshold, metric, score))
    )


def _similar_or_miss(misses, store, judge, threshold, judge_threshold, metric, score) -> DataFrame:
    candidates = similarity_join(
        misses, store, threshold=threshold, metric=metric, score=score,
        k=MAX_CANDIDATES if judge else 1,
    )
    stored_text = store.select("query_hash", F.col("query").alias("stored_query"))
    if judge:
        candidates = candidates.join(stored_text, "query_hash").join(misses.select("query_id", "query"), "query_id")
    matches = judged_matches(candidates, judge, threshold=judge_threshold).drop("rank")
    matches = matches.join(stored_text, "query_hash").withColumnRenamed("query_hash", "matched_hash")
    # Used twice below; no vector is compared and no judge asked a second time.
    looked_up = cut(misses.join(matches, "query_id", "left"))

    # The first query of each hash that nothing answers is the miss that gets saved.
    # Written, so that the repeats of a query asked very often can be split in the join.
    saved = cut(
        looked_up.where(F.col("matched_hash").isNull())
        .groupBy("query_hash")
        .agg(F.min(F.struct("arrival", "query_id")).alias("_first"))
    )
    placed = looked_up.join(saved, "query_hash", "left").withColumn("_at", F.struct("arrival", "query_id"))
    after, is_first = F.col("_at") > F.col("_first"), F.col("_at") == F.col("_first")
    outcome = F.when(is_first, "miss").when(after, "exact_hit").when(F.col("matched_hash").isNotNull(), "similar_hit")
    quoted = F.concat(F.lit("'"), F.col("stored_query"), F.lit("'"))
    found = (
        F.concat(F.lit("Found semantically similar query: "), quoted)
        if judge
        else F.concat(
            F.lit("Found similar query: "), quoted, F.lit(" (similarity: "), F.format_string("%.2f", "score"), F.lit(")")
        )
    )
    similar = outcome == "similar_hit"
    return _outcome(
        placed,
        outcome,
        F.when(similar, F.col("matched_hash")).when(outcome == "exact_hit", F.col("query_hash")),
        F.when(similar, found).when(outcome == "exact_hit", EXACT_MESSAGE),
        score=F.when(similar, F.col("score")),
        semantic=F.when(similar, F.col("semantic_similarity")),
        why=F.when(similar, F.col("semantic_reason")),
    )


def _invalid(ready: DataFrame) -> DataFrame:
    reason = F.coalesce("reason", F.lit("None"))
    rows = ready.where(F.col("status") == "invalid")
    return _outcome(rows, "invalid", message=F.concat(F.lit(INVALID_MESSAGE), reason), error=F.col("reason"))


def _outcome(rows, outcome, matched=None, message=None, error=None, score=None, semantic=None, why=None) -> DataFrame:
    none = F.lit(None)
    made = {
        "outcome": F.lit(outcome) if isinstance(outcome, str) else outcome,
        "matched_hash": none if matched is None else matched,
        "similarity_score": none if score is None else score,
        "semantic_similarity": none if semantic is None else semantic,
        "semantic_reason": none if why is None else why,
        "message": none if message is None else message,
        "error": none if error is None else error,
    }
    embedding = F.col("embedding") if "embedding" in rows.columns else none
    return rows.select(
        *[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in OUTCOMES.fields],
        "arrival", "confidence", "reason", embedding.cast("array<float>").alias("embedding"),
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(
        F.count("*").alias("queries"), F.countDistinct("query_hash").alias("distinct_queries")
    )
