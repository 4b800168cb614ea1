"""Whole jobs: resolve, answer, save."""

from pyspark.sql import functions as F

from querymill.functions.text import normalize_query
from querymill.operators.matching import similar_info
from querymill.plans.answer import answer, ingest
from querymill.plans.resolve import classify, embed, outcome_summary, prepare, resolve
from querymill.plans.sequential import resolve_sequential, resolve_sequential_judged
from querymill.providers import embed_hook
from querymill.sources.pages import scan_result_pages
from querymill.sources.store import scan_store
from workloads.base import ALL_TEXTS, ASKED, STORED, as_of, asked_queries, asked_texts, case, sql_strip, stored_queries, table
from workloads.pages import PAGE_TEXT, STATUS, UNION, result_pages_a, result_pages_b, with_status
from workloads.similarity import COSINE, PAIRS, means
from workloads.store import scratch
from workloads.text import sql_class


def asked_with_vectors(spark, sf_dir):
    vectors = means(spark, sf_dir).select(F.col("query_id").alias("_vec"), "embedding")
    total = table(spark, sf_dir, "embeddings").count()
    asked = asked_queries(spark, sf_dir).withColumn("_vec", F.pmod(F.col("conv_id") * 8 + F.col("turn"), F.lit(total)))
    return asked.join(vectors, "_vec")


def store_with_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    total = vectors.count()
    rows = stored_queries(spark, sf_dir).withColumn("vec_id", F.pmod("n", F.lit(total)))
    return rows.join(vectors.select("vec_id", "embedding"), "vec_id")


def sql_resolve(accepted: str = "true", confidence: str = "NULL::DOUBLE", k: int = 1) -> str:
    return f"""
classed AS (SELECT query_id, arrival, query, query_hash, conv_id, turn, {sql_class('query')} FROM asked_hash),
stored_v AS (SELECT stored.query_hash, stored.query, e, label FROM stored, v WHERE vec_id = stored.n % (SELECT n FROM n)),
open AS (SELECT c.*, mean.e AS e FROM classed c JOIN mean ON mean.query_id = (conv_id * 8 + turn) % (SELECT n FROM n)
  WHERE status <> 'invalid' AND query_hash NOT IN (SELECT query_hash FROM stored)),
dist AS (SELECT o.query_id, o.query AS asked, s.query_hash AS store_hash, s.query AS stored_query, {COSINE.format('o.e', 's.e')} AS d FROM open o, stored_v s),
ranked AS (SELECT *, greatest(0.0, 1 - d * d / 2) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(0.0, 1 - d * d / 2), 9) DESC, store_hash) AS rank
  FROM dist WHERE greatest(0.0, 1 - d * d / 2) >= 0.85),
found AS (SELECT *, {confidence} AS semantic, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM ranked WHERE rank <= {k} AND {accepted}),
looked AS (SELECT open.*, store_hash, stored_query, score, semantic FROM open LEFT JOIN (SELECT * FROM found WHERE nth = 1) f USING (query_id)),
placed AS (SELECT *, min(CASE WHEN store_hash IS NULL THEN arrival END) OVER (PARTITION BY query_hash) AS saved_at FROM looked),
outcomes AS (
  SELECT query_id, query, query_hash, 'invalid' AS outcome, status, NULL AS matched_hash, NULL::DOUBLE AS similarity_score,
    NULL::DOUBLE AS semantic_similarity, NULL AS stored_query, reason, e_reason FROM (SELECT *, reason AS e_reason FROM classed WHERE status = 'invalid')
  UNION ALL
  SELECT query_id, query, query_hash, 'exact_hit', status, query_hash, NULL, NULL, NULL, reason, NULL FROM classed
    WHERE status <> 'invalid' AND query_hash IN (SELECT query_hash FROM stored)
  UNION ALL
  SELECT query_id, query, query_hash, CASE WHEN arrival = saved_at THEN 'miss' WHEN arrival > saved_at THEN 'exact_hit' ELSE 'similar_hit' END, status,
    CASE WHEN arrival = saved_at THEN NULL WHEN arrival > saved_at THEN query_hash ELSE store_hash END,
    CASE WHEN coalesce(arrival < saved_at, true) THEN score END, CASE WHEN coalesce(arrival < saved_at, true) THEN semantic END, stored_query, reason, NULL FROM placed)"""


SHOWN = """SELECT query_id, query, query_hash, outcome, status, matched_hash, round(similarity_score, 6) AS similarity_score, semantic_similarity,
  CASE outcome WHEN 'invalid' THEN 'Invalid query: ' || e_reason WHEN 'exact_hit' THEN 'Found cached result for your query'
    WHEN 'similar_hit' THEN {0} END AS message, e_reason AS error FROM outcomes"""
ROUNDED = "'Found similar query: ''' || stored_query || ''' (similarity: ' || printf('%.2f', similarity_score) || ')'"


def shown(outcomes):
    return outcomes.select(
        "query_id", "query", "query_hash", "outcome", "status", "matched_hash",
        F.round("similarity_score", 6).alias("similarity_score"), "semantic_similarity", "message", "error",
    )


@case("P1 J1 J2 J3 F1 W5", f"WITH {ASKED}, {STORED}, {PAIRS}, {sql_resolve()} {SHOWN.format(ROUNDED)}")
def resolve_queries(spark, sf_dir):
    return shown(resolve(asked_with_vectors(spark, sf_dir), store_with_vectors(spark, sf_dir)))


def length_judge(asked, candidate):
    """Stands for a model: texts are similar if their lengths are both even or both odd."""
    return [
        '{"is_similar": %s, "confidence": 0.95}' % str(len(a) % 2 == len(b) % 2).lower() for a, b in zip(asked, candidate)
    ]


@case(
    "P1 J4 X3",
    f"WITH {ASKED}, {STORED}, {PAIRS}, {sql_resolve('length(asked) % 2 = length(stored_query) % 2', '0.95::DOUBLE', 5)} "
    + SHOWN.format("'Found semantically similar query: ''' || stored_query || ''''"),
)
def resolve_queries_judged(spark, sf_dir):
    return shown(resolve(asked_with_vectors(spark, sf_dir), store_with_vectors(spark, sf_dir), judge=length_judge))


@case(
    "N9 J4",
    f"""WITH {ASKED}, {STORED}, {PAIRS}, {sql_resolve()} SELECT query_id, stored_query AS original_query,
      round(similarity_score, 6) AS embedding_similarity, semantic_similarity FROM outcomes WHERE outcome = 'similar_hit'""",
)
def similar_query_info(spark, sf_dir):
    store = store_with_vectors(spark, sf_dir)
    rows = similar_info(resolve(asked_with_vectors(spark, sf_dir), store), store)
    return rows.select(
        "query_id", "original_query", F.round("embedding_similarity", 6).alias("embedding_similarity"), "semantic_similarity"
    )


SUMMARY = f"""WITH {ASKED}, {STORED}, {PAIRS}, {sql_resolve()}
SELECT outcome, count(*) AS queries, count(DISTINCT query_hash) AS distinct_queries FROM outcomes GROUP BY outcome"""


@case("P1", SUMMARY)
def resolve_summary(spark, sf_dir):
    return outcome_summary(resolve(asked_with_vectors(spark, sf_dir), store_with_vectors(spark, sf_dir)))


# Outcomes in order of asking: one step per query that is valid and not stored, carrying what was saved so far.
def sql_sequence(accepted: str = "true", k: int = 1) -> str:
    return f"""
classed AS (SELECT query_id, arrival, query, query_hash, conv_id, turn, {sql_class('query')} FROM asked_hash),
stored_v AS (SELECT stored.query_hash, stored.query, e FROM stored, v WHERE vec_id = stored.n % (SELECT n FROM n)),
opened AS (SELECT c.query_id, query, query_hash, mean.e AS e, row_number() OVER (ORDER BY arrival) AS step FROM classed c
  JOIN mean ON mean.query_id = (conv_id * 8 + turn) % (SELECT n FROM n)
  WHERE status <> 'invalid' AND query_hash NOT IN (SELECT query_hash FROM stored)),
scored AS MATERIALIZED (
  SELECT a.step, 0 AS other, b.query_hash AS hash, a.query AS asked, b.query AS stored_query, {COSINE.format('a.e', 'b.e')} AS d FROM opened a, stored_v b
  UNION ALL SELECT a.step, b.step, b.query_hash, a.query, b.query, {COSINE.format('a.e', 'b.e')} FROM opened a JOIN opened b ON b.step < a.step),
near AS MATERIALIZED (SELECT step, other, hash, {accepted} AS ok, greatest(0.0, 1 - d * d / 2) AS score FROM scored WHERE greatest(0.0, 1 - d * d / 2) >= 0.85),
edges AS MATERIALIZED (SELECT step, list({{'score': score, 'hash': hash, 'other': other, 'ok': ok}} ORDER BY round(score, 9) DESC, other, hash) AS found
  FROM near GROUP BY step),
steps AS MATERIALIZED (SELECT o.step, o.query_id, o.query_hash, coalesce(found, []) AS found FROM opened o LEFT JOIN edges USING (step)),
walk AS (
  SELECT 0::BIGINT AS step, []::BIGINT[] AS saved, []::VARCHAR[] AS hashes, ''::VARCHAR AS outcome, NULL::VARCHAR AS matched, NULL::DOUBLE AS score
  UNION ALL
  SELECT step, CASE WHEN kind = 'miss' THEN list_append(saved, step) ELSE saved END,
    CASE WHEN kind = 'miss' THEN list_append(hashes, query_hash) ELSE hashes END, kind,
    CASE kind WHEN 'exact_hit' THEN query_hash WHEN 'similar_hit' THEN best.hash END, CASE kind WHEN 'similar_hit' THEN best.score END
  FROM (SELECT *, CASE WHEN list_contains(hashes, query_hash) THEN 'exact_hit' WHEN best IS NOT NULL THEN 'similar_hit' ELSE 'miss' END AS kind
    FROM (SELECT s.step, s.query_hash, w.saved, w.hashes,
        list_filter(list_filter(s.found, lambda f: f.other = 0 OR list_contains(w.saved, f.other))[1:{k}], lambda f: f.ok)[1] AS best
      FROM walk w JOIN steps s ON s.step = w.step + 1)))"""


def sql_in_sequence(semantic: str = "", **judged) -> str:
    return f"""WITH RECURSIVE {ASKED}, {STORED}, {PAIRS}, {sql_sequence(**judged)}
    SELECT s.query_id, outcome, matched AS matched_hash, round(score, 6) AS similarity_score{semantic and f", CASE outcome WHEN 'similar_hit' THEN {semantic} END AS semantic_similarity"}
    FROM walk w JOIN steps s ON s.step = w.step
    UNION ALL SELECT query_id, 'exact_hit', query_hash, NULL{semantic and ', NULL'} FROM classed
      WHERE status <> 'invalid' AND query_hash IN (SELECT query_hash FROM stored)"""


@case("P7", sql_in_sequence())
def resolve_in_sequence(spark, sf_dir):
    asked = prepare(asked_with_vectors(spark, sf_dir)).where("status <> 'invalid'")
    rows = resolve_sequential(asked, store_with_vectors(spark, sf_dir))
    return rows.withColumn("similarity_score", F.round("similarity_score", 6))


@case("P7 J4 X3", sql_in_sequence("0.95::DOUBLE", accepted="length(asked) % 2 = length(stored_query) % 2", k=5))
def resolve_in_sequence_judged(spark, sf_dir):
    asked = prepare(asked_with_vectors(spark, sf_dir)).where("status <> 'invalid'")
    rows = resolve_sequential_judged(asked, store_with_vectors(spark, sf_dir), length_judge)
    return rows.withColumn("similarity_score", F.round("similarity_score", 6))


@case("P1 X1 X2")
def resolve_with_hooks(spark, sf_dir):
    """Embeddings and classes come from hooks; the default embedding has no SQL twin."""
    store = stored_queries(spark, sf_dir).withColumn("embedding", embed_hook()(F.col("query")))
    return outcome_summary(resolve(asked_queries(spark, sf_dir), store, classifier=lambda texts: [
        '{"status": "%s", "confidence": 0.9}' % ("invalid" if t.startswith("call ") else "valid") for t in texts
    ]))


LETTERS = "aeio"


@case(
    "X1",
    f"WITH {ALL_TEXTS} SELECT query_id, " + ", ".join(f"(length(query) - length(replace(query, '{c}', '')))::DOUBLE AS n_{c}" for c in LETTERS) + " FROM asked_norm",
)
def hooked_embeddings(spark, sf_dir):
    """A hook that counts letters, as DuckDB can too."""
    asked = asked_texts(spark, sf_dir).withColumn("query", normalize_query(F.col("query")))
    vectors = embed(asked, lambda texts: [[float(t.count(c)) for c in LETTERS] for t in texts])
    return vectors.select("query_id", *[F.col("embedding")[i].cast("double").alias(f"n_{c}") for i, c in enumerate(LETTERS)])


@case(
    "X2 N2",
    f"""WITH {ALL_TEXTS} SELECT query_id, CASE WHEN length(query) % 2 = 1 THEN 'invalid' ELSE 'valid' END AS status, 0.75::DOUBLE AS confidence,
      'length ' || length(query) AS reason FROM asked_norm""",
)
def hooked_classes(spark, sf_dir):
    """A hook that goes by the length of the text, as DuckDB can too."""
    asked = asked_texts(spark, sf_dir).withColumn("query", normalize_query(F.col("query")))
    found = classify(asked, lambda texts: [
        '{"status": "%s", "confidence": 0.75, "reason": "length %d"}' % ("invalid" if len(t) % 2 else "valid", len(t)) for t in texts
    ])
    return found.select("query_id", "status", "confidence", "reason")


# One query per result page, answered from its links.
def answered(spark, sf_dir):
    queries = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 12).alias("query_id")).distinct()
    misses = queries.unionByName(queries.select((-F.col("query_id") - 1).alias("query_id"))).select(
        "query_id", F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("query"),
        F.sha2(F.col("query_id").cast("string"), 256).alias("query_hash"), F.lit("valid").alias("status"),
        F.lit(0.8).alias("confidence"), F.lit("r").alias("reason"), F.array(F.lit(1.0)).alias("embedding"),
    )
    links = scan_result_pages(result_pages_a(spark, sf_dir), "a").unionByName(
        scan_result_pages(result_pages_b(spark, sf_dir), "b")
    )
    return answer(misses, links, with_status(table(spark, sf_dir, "pages")), as_of())


LEAD = f"list_filter(list_transform(string_split(content, '. ')[1:2], lambda x: {sql_strip('x')}), lambda x: length(x) > 50)[1] || '.'"
ANSWER = f"""
fetched AS (SELECT *, {STATUS} AS st FROM scanned),
got AS (SELECT query_id, source_rank, c.url, coalesce(st < 400, false) AS success, CASE WHEN st < 400 THEN content ELSE '' END AS content
  FROM chosen c LEFT JOIN fetched f ON c.url = f.url),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id, success ORDER BY source_rank) AS nth, {LEAD} AS lead FROM got),
rolled AS (SELECT query_id, count(*) FILTER (success) AS pages_scraped, coalesce(sum(length(content)) FILTER (success), 0)::BIGINT AS total_content_length,
  string_agg(lead, ' ' ORDER BY source_rank) FILTER (success AND nth <= 3) AS leads,
  coalesce(string_agg(url, '|' ORDER BY source_rank) FILTER (success), '') AS sources FROM numbered GROUP BY query_id)"""
TEXT = """CASE WHEN leads IS NOT NULL THEN 'Based on the available sources for ''query ' || query_id || ''': ' || leads
  ELSE 'Information found about ''query ' || query_id || ''' from ' || pages_scraped || ' sources.' END"""


@case(
    "P2 U1 O3 J6 A6 N6",
    f"""WITH {UNION}, {PAGE_TEXT}, {ANSWER}
    SELECT query_id, true AS success, 'Successfully processed your query' AS message, NULL AS error, {TEXT} AS summary, sources FROM rolled
    UNION ALL SELECT DISTINCT -(page_id // 12) - 1, false, 'Failed to scrape any web content for your query', 'Web scraping failed', NULL, NULL FROM pages""",
)
def answer_queries(spark, sf_dir):
    return answered(spark, sf_dir).select(
        "query_id", "success", "message", "error", "summary.summary", F.array_join("summary.sources", "|").alias("sources")
    )


@case(
    "P3 K1 K4",
    f"""WITH {UNION}, {PAGE_TEXT}, {ANSWER} SELECT sha256(query_id::VARCHAR) AS query_hash, pages_scraped, total_content_length,
      'query ' || query_id || ' | ' || {TEXT} AS document, 0.0::DOUBLE AS execution_time FROM rolled""",
)
def ingest_answers(spark, sf_dir):
    path = scratch(spark, "store")
    ingest(spark, path, answered(spark, sf_dir))
    return scan_store(spark, path).select(
        "query_hash", F.col("pages_scraped").cast("bigint").alias("pages_scraped"), "total_content_length", "document", "execution_time"
    )
