"""Vector rules and the similarity join over whole tables.

Query vectors are the means of each stored vector and its successor, so that every query has matches.
"""

import pandas as pd
from pyspark.sql import functions as F

from querymill.functions import vectors as V
from querymill.functions.replies import parse_verdict
from querymill.operators.matching import judged_matches
from querymill.operators.similarity import similarity_approximate as approximate, similarity_join
from querymill.providers import embed_hook
from workloads.base import case, table

PAIRS = """
n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
mean AS (SELECT a.vec_id AS query_id, a.label, a.e AS own, b.e AS other,
    list_transform(list_zip(a.e, b.e), lambda x: (x[1] + x[2]) / 2) AS e
  FROM v a JOIN v b ON b.vec_id = (a.vec_id + 1) % (SELECT n FROM n))"""
COSINE = "1 - list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
SQL2 = "list_sum(list_transform(list_zip({0}, {1}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def means(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    total = vectors.count()
    doubles = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").alias("query_id"), "label", doubles.alias("own"))
    following = vectors.select(
        F.pmod(F.col("vec_id") - 1, F.lit(total)).alias("query_id"), doubles.alias("other")
    )
    return own.join(following, "query_id").withColumn("embedding", F.zip_with("own", "other", lambda x, y: (x + y) / 2))


def scored(distance: str, threshold: float, k: int, score: str = "greatest(0.0, 1 - d * d / 2)") -> str:
    return f"""
dist AS (SELECT query_id, mean.label AS query_label, v.vec_id AS store_id, v.label AS store_label, {distance} AS d FROM mean, v),
hits AS (SELECT *, {score} AS score FROM dist),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, store_id) AS rank
  FROM hits WHERE score >= {threshold}),
best AS (SELECT * FROM ranked WHERE rank <= {k})"""


def found(joined):
    return joined.select(
        "query_id", "store_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


def stored(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("store_id"), "embedding", F.col("label").alias("store_label"))


SHOW = "SELECT query_id, store_id, round(score, 6) AS score, rank FROM best"


@case(
    "V1 V2",
    f"""WITH {PAIRS}, d AS (SELECT query_id, {COSINE.format('own', 'other')} AS c, {SQL2.format('own', 'other')} AS s FROM mean)
    SELECT query_id, round(c, 6) AS cosine, round(s, 6) AS sql2, round(greatest(0.0, 1 - c * c / 2), 6) AS score FROM d""",
)
def vector_distances(spark, sf_dir):
    a, b = F.col("own"), F.col("other")
    cosine = V.cosine_distance(a, b)
    return means(spark, sf_dir).select(
        "query_id", F.round(cosine, 6).alias("cosine"), F.round(V.squared_l2_distance(a, b), 6).alias("sql2"),
        F.round(V.distance_to_score(cosine), 6).alias("score"),
    )


@case("J3 F7 W3", f"WITH {PAIRS}, {scored(COSINE.format('mean.e', 'v.e'), 0.85, 5)} {SHOW}")
def similarity_topk(spark, sf_dir):
    return found(similarity_join(means(spark, sf_dir), stored(spark, sf_dir), store_key="store_id"))


@case("J3 V2", f"WITH {PAIRS}, {scored(COSINE.format('mean.e', 'v.e'), 0.6, 3, '1 - d')} {SHOW}")
def similarity_true_cosine(spark, sf_dir):
    joined = similarity_join(
        means(spark, sf_dir), stored(spark, sf_dir), store_key="store_id", score="cosine", threshold=0.6, k=3
    )
    return found(joined)


@case("J3 V2", f"WITH {PAIRS}, {scored(SQL2.format('mean.e', 'v.e'), 0.7, 5)} {SHOW}")
def similarity_squared_l2(spark, sf_dir):
    joined = similarity_join(
        means(spark, sf_dir), stored(spark, sf_dir), store_key="store_id", metric="sql2", threshold=0.7
    )
    return found(joined)


@case("J3", f"WITH {PAIRS}, {scored(COSINE.format('mean.e', 'v.e'), 0.85, 5)} {SHOW}")
def similarity_in_blocks(spark, sf_dir):
    """The same join cut into many cells and blocks, as large inputs are."""
    joined = similarity_join(
        means(spark, sf_dir), stored(spark, sf_dir), store_key="store_id", block_rows=100, max_cells=4
    )
    return found(joined)


@case("J3 X1")
def similarity_approximate(spark, sf_dir):
    """The approximate join, at its defaults; it may miss matches, so there is no SQL twin. Its recall is tested against ``similarity_topk``."""
    return found(approximate(means(spark, sf_dir), stored(spark, sf_dir), store_key="store_id"))


def label_judge(asked: pd.Series, candidate: pd.Series) -> list[str]:
    """Stands for a model: same label is similar, surer for even labels."""
    return [
        '{"is_similar": %s, "confidence": %s, "reason": "label"}' % (str(a == b).lower(), 0.7 if int(a) % 5 == 4 else 0.9)
        for a, b in zip(asked, candidate)
    ]


def candidates(spark, sf_dir, k):
    asked, store = means(spark, sf_dir), stored(spark, sf_dir)
    joined = similarity_join(asked, store, store_key="store_id", k=k)
    return (
        joined.join(asked.select("query_id", F.col("label").cast("string").alias("query")), "query_id")
        .join(store.select("store_id", F.col("store_label").cast("string").alias("stored_query")), "store_id")
        .withColumnRenamed("store_id", "query_hash")
    )


def judged(take: int, k: int) -> str:
    return f"""WITH {PAIRS}, {scored(COSINE.format('mean.e', 'v.e'), 0.85, k)},
    accepted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM best
      WHERE query_label = store_label AND query_label % 5 <> 4)
    SELECT query_id, store_id, round(score, 6) AS score, 0.9::DOUBLE AS semantic_similarity, rank FROM accepted WHERE nth <= {take}"""


def _matches(rows):
    return rows.select(
        "query_id", F.col("query_hash").alias("store_id"), F.round("score", 6).alias("score"), "semantic_similarity",
        F.col("rank").cast("bigint").alias("rank"),
    )


@case("J4 F8 X3", judged(1, 5))
def first_validated_match(spark, sf_dir):
    return _matches(judged_matches(candidates(spark, sf_dir, 5), label_judge))


@case("J5 X3", judged(2, 4))
def validated_matches(spark, sf_dir):
    return _matches(judged_matches(candidates(spark, sf_dir, 4), label_judge, limit=2, depth=4))


@case("J4", f"WITH {PAIRS}, {scored(COSINE.format('mean.e', 'v.e'), 0.85, 1)} SELECT query_id, store_id, round(score, 6) AS score FROM best")
def top_match_without_judge(spark, sf_dir):
    return _matches(judged_matches(candidates(spark, sf_dir, 1), None)).select("query_id", "store_id", "score")


@case(
    "N3",
    """SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN true WHEN 'purchase' THEN value > 5
        WHEN 'signup' THEN true ELSE true END AS is_similar,
      CASE event_type WHEN 'click' THEN round(value / 100, 4) WHEN 'view' THEN round(value / 100, 4)
        WHEN 'purchase' THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence,
      CASE event_type WHEN 'click' THEN 'r' WHEN 'view' THEN 'Assessed by Gemini' WHEN 'purchase' THEN 'Assessed by Gemini'
        WHEN 'signup' THEN 'Invalid LLM response' ELSE 'Parse error' END AS reason FROM events""",
)
def parse_verdicts(spark, sf_dir):
    number = F.format_string("%.4f", F.round(F.col("value") / 100, 4))
    kind = F.col("event_type")
    reply = (
        F.when(kind == "click", F.concat(F.lit('```json\n{"is_similar": true, "reason": "r", "confidence": '), number, F.lit("}\n```")))
        .when(kind == "view", F.concat(F.lit('{"is_similar": "false", "confidence": "'), number, F.lit('"}')))
        .when(kind == "purchase", F.concat(F.lit('x {"is_similar": '), (F.col("value") > 5).cast("string"), F.lit(', "confidence": 0.9}')))
        .when(kind == "signup", F.lit('{"confidence": 0.9}'))
        .otherwise(F.lit("no idea"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", parse_verdict(reply).alias("v"))
    return rows.select("event_id", "v.is_similar", "v.confidence", "v.reason")


@case("X1")
def default_embeddings(spark, sf_dir):
    """The default embedding of every document; its hash function has no SQL twin."""
    docs = table(spark, sf_dir, "documents").select("doc_id", embed_hook()(F.col("text")).alias("e"))
    return docs.select("doc_id", F.size("e").alias("dim"), F.round(F.sqrt(V.dot(F.col("e"), F.col("e"))), 4).alias("length"))
