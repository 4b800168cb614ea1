"""Store operators, history and statistics over whole tables."""

import uuid

from pyspark.sql import functions as F

from querymill.functions import text as X
from querymill.operators.answers import array_rollup, page_rollup, scrape_totals, summarize
from querymill.operators.history import list_history
from querymill.operators.stats import access_rollup, similarity_report, stats_full, stats_reference
from querymill.plans.answer import export_json
from querymill.plans.reports import stats, write_stats
from querymill.session import shared_dir
from querymill.sources.search_index import add_to_index, search
from querymill.sources.store import (
    clear, decode_result, delete_results, encode_result, insert_results, lookup, mark_hit, new_rows, scan_store,
    store_size, to_store_row, with_keys, without_keys,
)
from workloads.base import (
    as_of, ASKED, OUTCOME_LOG, SCRAPED, STORED, asked_queries, case, outcome_log, scraped_documents, stored_queries, table,
)
from workloads.replies import EXTRACTIVE, nested


def scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hashed(spark, sf_dir):
    asked = asked_queries(spark, sf_dir).withColumn("query", X.normalize_query(F.col("query")))
    return asked.withColumn("query_hash", X.query_hash(F.col("query")))


@case("F9 O2", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def text_search_indexed(spark, sf_dir):
    """Documents that hold a term, by an index of their trigrams."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "grams")
    add_to_index(docs, path, "doc_id", "text", "source")
    return search(docs, path, "License", "doc_id", "text", "source").select("doc_id", "source")


@case(
    "J1",
    f"""WITH {ASKED}, {STORED} SELECT query_id, a.query_hash, s.query AS stored_query, s.query_hash IS NOT NULL AS cache_hit
    FROM asked_hash a LEFT JOIN stored s ON a.query_hash = s.query_hash""",
)
def exact_result_join(spark, sf_dir):
    store = stored_queries(spark, sf_dir).select("query_hash", F.col("query").alias("stored_query"))
    return hashed(spark, sf_dir).join(store, "query_hash", "left").select(
        "query_id", "query_hash", "stored_query", F.col("stored_query").isNotNull().alias("cache_hit")
    )


@case("J2", f"WITH {ASKED}, {STORED} SELECT query_id, query_hash FROM asked_hash WHERE query_hash NOT IN (SELECT query_hash FROM stored)")
def unanswered_queries(spark, sf_dir):
    return without_keys(hashed(spark, sf_dir), stored_queries(spark, sf_dir)).select("query_id", "query_hash")


@case("J8", f"WITH {ASKED}, {STORED} SELECT query_id, query_hash FROM asked_hash WHERE query_hash IN (SELECT query_hash FROM stored)")
def answered_queries(spark, sf_dir):
    return with_keys(hashed(spark, sf_dir), stored_queries(spark, sf_dir)).select("query_id", "query_hash")


@case(
    "W5",
    f"""WITH {ASKED} SELECT query_id, query_hash, row_number() OVER (PARTITION BY query_hash ORDER BY arrival, query_id) = 1 AS is_first
    FROM asked_hash""",
)
def first_per_hash(spark, sf_dir):
    asked = hashed(spark, sf_dir)
    first = asked.groupBy("query_hash").agg(F.min(F.struct("arrival", "query_id")).alias("_first"))
    return asked.join(first, "query_hash").select(
        "query_id", "query_hash", (F.struct("arrival", "query_id") == F.col("_first")).alias("is_first")
    )


# Stored rows made of the documents: one result per five documents.
def answers(spark, sf_dir):
    rows = summarize(nested(spark, sf_dir), as_of())
    return rows.select(
        X.query_hash(F.col("query")).alias("query_hash"), "query", F.lit("valid").alias("status"),
        F.lit(0.8).alias("confidence"), F.lit("r").alias("reason"), "scraped_content", "summary",
        F.array(F.lit(1.0), F.col("query_id").cast("double")).alias("embedding"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("query_id") % 100 * 60).alias("created_at"),
        F.when(F.col("query_id") % 3 != 0, F.col("query_id") / 4).alias("execution_time"),
    )


ANSWERS = f"""{SCRAPED}, {EXTRACTIVE},
totals AS (SELECT query_id, count(*) FILTER (success) AS pages_scraped,
  coalesce(sum(length(content)) FILTER (success), 0)::BIGINT AS total_content_length FROM scraped GROUP BY query_id),
rows AS (SELECT sha256('query ' || query_id) AS query_hash, 'query ' || query_id AS query,
    strftime(TIMESTAMP '2024-01-01' + (query_id % 100) * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S') AS created_at,
    CASE WHEN query_id % 3 = 0 THEN 0.0 ELSE query_id / 4 END AS execution_time, pages_scraped, total_content_length,
    'query ' || query_id || ' | ' || summary AS document
  FROM totals JOIN extract USING (query_id))"""
ROW = "query_hash, query, created_at, execution_time, pages_scraped, total_content_length, document"


def flat(rows):
    return rows.select(
        "query_hash", "query", X.iso_timestamp(F.col("created_at")).alias("created_at"), "execution_time",
        F.col("pages_scraped").cast("bigint").alias("pages_scraped"), "total_content_length", "document",
    )


@case("K4 T11", f"WITH {ANSWERS} SELECT {ROW} FROM rows")
def store_rows(spark, sf_dir):
    return flat(to_store_row(answers(spark, sf_dir)))


@case("K1 S3 J7", f"WITH {ANSWERS} SELECT {ROW} FROM rows")
def insert_and_scan(spark, sf_dir):
    """Everything is inserted twice, the second time later and under another text: the first stays."""
    path = scratch(spark, "store")
    rows = to_store_row(answers(spark, sf_dir))
    insert_results(spark, path, rows)
    insert_results(spark, path, rows.withColumn("query", F.lit("changed")))
    return flat(scan_store(spark, path))


@case(
    "K1 J7",
    f"""WITH {ASKED}, {STORED} SELECT query_hash, query_id FROM (
      SELECT *, row_number() OVER (PARTITION BY query_hash ORDER BY arrival, query) AS n FROM asked_hash)
    WHERE n = 1 AND query_hash NOT IN (SELECT query_hash FROM stored)""",
)
def rows_to_insert(spark, sf_dir):
    asked = hashed(spark, sf_dir).withColumnRenamed("arrival", "created_at")
    return new_rows(stored_queries(spark, sf_dir), asked).select("query_hash", "query_id")


@case("K2 J7", f"WITH {ANSWERS} SELECT {ROW} FROM rows WHERE pages_scraped = 5")
def delete_and_scan(spark, sf_dir):
    """Results with a failed page are deleted, and keys nobody stored with them."""
    path = scratch(spark, "store")
    rows = to_store_row(answers(spark, sf_dir))
    insert_results(spark, path, rows)
    unknown = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("query_hash"))
    delete_results(spark, path, rows.where("pages_scraped < 5").select("query_hash").unionByName(unknown))
    return flat(scan_store(spark, path))


@case("K3 A10", "SELECT 0::BIGINT AS entries_after, count(DISTINCT doc_id // 5) AS entries_before FROM documents")
def clear_store(spark, sf_dir):
    path = scratch(spark, "store")
    insert_results(spark, path, to_store_row(answers(spark, sf_dir)))
    before = scan_store(spark, path).count()
    clear(spark, path)
    return scan_store(spark, path).agg(F.count("*").alias("entries_after"), F.lit(before).alias("entries_before"))


@case("K7 A10", "SELECT count(DISTINCT doc_id // 5) AS total_entries, true AS has_size FROM documents")
def stored_size(spark, sf_dir):
    path = scratch(spark, "store")
    insert_results(spark, path, to_store_row(answers(spark, sf_dir)))
    return store_size(spark, path).select("total_entries", (F.col("total_size_bytes") > 0).alias("has_size"))


@case("S4", f"WITH {ANSWERS} SELECT query_hash, query, document FROM rows WHERE query_hash IN (SELECT sha256('query ' || vec_id) FROM embeddings)")
def lookup_by_keys(spark, sf_dir):
    path = scratch(spark, "store")
    insert_results(spark, path, to_store_row(answers(spark, sf_dir)))
    keys = table(spark, sf_dir, "embeddings").select(
        F.sha2(F.concat(F.lit("query "), F.col("vec_id").cast("string")), 256).alias("query_hash")
    )
    return lookup(scan_store(spark, path), keys).select("query_hash", "query", "document")


@case(
    "S5 D1",
    f"""WITH {ANSWERS} SELECT r.query_hash, r.query, r.created_at, r.execution_time, e.summary, e.key_points, true AS cache_hit,
      s.content AS first_content FROM rows r JOIN extract e ON r.query = 'query ' || e.query_id
      JOIN scraped s ON s.query_id = e.query_id AND s.position = 0""",
)
def decode_stored_record(spark, sf_dir):
    rows = decode_result(encode_result(to_store_row(answers(spark, sf_dir))))
    rows = rows.withColumn("result", mark_hit(F.col("result")))
    return rows.select(
        "query_hash", "result.query", X.iso_timestamp(F.col("result.created_at")).alias("created_at"),
        "result.execution_time", "result.summary.summary",
        F.array_join("result.summary.key_points", "|").alias("key_points"), "result.cache_hit",
        F.col("result.scraped_content")[0]["content"].alias("first_content"),
    )


@case(
    "K6",
    f"""WITH {OUTCOME_LOG} SELECT '{{"query_id":' || event_id || ',"query_hash":"' || query_hash || '","outcome":"' || outcome || '"}}' AS json
    FROM outcomes""",
)
def export_outcomes(spark, sf_dir):
    return export_json(outcome_log(spark, sf_dir).select("query_id", "query_hash", "outcome"))


def money(rows, *names):
    return rows.select(*[F.round(c, 9).alias(c) if c in names else c for c in rows.columns])


RATES = ("total_execution_time", "average_execution_time", "cache_hit_rate", "success_rate")
SQL_RATES = """round(total_execution_time, 9) AS total_execution_time,
  round(coalesce(total_execution_time / nullif(total_queries, 0), 0), 9) AS average_execution_time,
  round(coalesce(cache_hits / nullif(cache_hits + cache_misses, 0) * 100, 0), 9) AS cache_hit_rate,
  round(coalesce(valid_queries / nullif(total_queries, 0) * 100, 0), 9) AS success_rate"""
REFERENCE = """
counted AS (SELECT count(*) FILTER (outcome = 'miss') AS total_queries, count(*) FILTER (outcome = 'miss') AS valid_queries,
    0::BIGINT AS invalid_queries, count(*) FILTER (outcome = 'exact_hit') AS cache_hits, count(*) FILTER (outcome = 'miss') AS cache_misses,
    coalesce(sum(pages_scraped) FILTER (outcome = 'miss'), 0)::BIGINT AS total_pages_scraped,
    coalesce(sum(execution_time) FILTER (outcome = 'miss'), 0) AS total_execution_time FROM outcomes)"""
COUNTS = "total_queries, valid_queries, invalid_queries, cache_hits, cache_misses, total_pages_scraped"


@case("A1 A2 A3 A4", f"WITH {OUTCOME_LOG}, {REFERENCE} SELECT {COUNTS}, {SQL_RATES} FROM counted")
def counters(spark, sf_dir):
    return money(stats_reference(outcome_log(spark, sf_dir)), *RATES)


@case(
    "A1 A2 A3 A4",
    f"""WITH {OUTCOME_LOG}, counted AS (SELECT query_hash, count(*) AS total_queries, count(*) FILTER (outcome <> 'invalid') AS valid_queries,
      count(*) FILTER (outcome = 'invalid') AS invalid_queries, count(*) FILTER (outcome IN ('exact_hit', 'similar_hit')) AS cache_hits,
      count(*) FILTER (outcome IN ('miss', 'unsaved', 'failed')) AS cache_misses, sum(pages_scraped)::BIGINT AS total_pages_scraped,
      sum(execution_time) AS total_execution_time FROM outcomes GROUP BY query_hash)
    SELECT query_hash, {COUNTS}, {SQL_RATES} FROM counted""",
)
def counters_per_user(spark, sf_dir):
    return money(stats_full(outcome_log(spark, sf_dir), "query_hash"), *RATES)


@case(
    "K5",
    f"WITH {OUTCOME_LOG}, {REFERENCE} SELECT total_queries, cache_hits, cache_misses, round(total_execution_time, 9) AS total_execution_time FROM counted",
)
def stats_snapshot(spark, sf_dir):
    path = scratch(spark, "stats")
    write_stats(stats_reference(outcome_log(spark, sf_dir)), path)
    schema = "total_queries bigint, cache_hits bigint, cache_misses bigint, total_execution_time double"
    return money(spark.read.schema(schema).json(path), "total_execution_time")


@case(
    "A7",
    f"""WITH {OUTCOME_LOG}, {REFERENCE}, {STORED} SELECT 0.85::DOUBLE AS embedding_threshold, 0.8::DOUBLE AS semantic_threshold,
      true AS judge_available, cache_hits + cache_misses AS total_queries_processed, cache_hits, cache_misses,
      round(cache_hits / (cache_hits + cache_misses) * 100, 9) AS similarity_hit_rate_percent,
      (SELECT count(*) FROM stored) AS total_stored_queries FROM counted""",
)
def similarity_statistics(spark, sf_dir):
    rows = similarity_report(outcome_log(spark, sf_dir), stored_queries(spark, sf_dir), 0.85, 0.8, True)
    return money(rows, "similarity_hit_rate_percent")


@case(
    "A8",
    f"""WITH {OUTCOME_LOG} SELECT query_hash, count(*) AS access_count, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_accessed
    FROM outcomes WHERE outcome IN ('exact_hit', 'similar_hit') GROUP BY query_hash""",
)
def access_counts(spark, sf_dir):
    rows = access_rollup(outcome_log(spark, sf_dir))
    return rows.withColumn("last_accessed", F.date_format("last_accessed", "yyyy-MM-dd'T'HH:mm:ss"))


@case(
    "A5",
    f"""WITH {SCRAPED} SELECT query_id, count(*) FILTER (success) AS pages_scraped,
      coalesce(sum(length(content)) FILTER (success), 0)::BIGINT AS total_content_length,
      round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM scraped GROUP BY query_id""",
)
def page_rollups(spark, sf_dir):
    return money6(page_rollup(scraped_documents(spark, sf_dir), "query_id"))


def money6(rows):
    return rows.withColumn("success_rate", F.round("success_rate", 6))


@case(
    "A5 A6",
    f"""WITH {SCRAPED} SELECT query_id, string_agg(url, '|' ORDER BY position) AS urls, count(*) FILTER (success) AS pages_scraped,
      coalesce(sum(length(content)) FILTER (success), 0)::BIGINT AS total_content_length,
      round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM scraped GROUP BY query_id""",
)
def nested_pages(spark, sf_dir):
    good, total, rate = array_rollup(F.col("scraped_content"))
    rows = nested(spark, sf_dir).select(
        "query_id", F.array_join("scraped_content.url", "|").alias("urls"), good.cast("bigint").alias("pages_scraped"),
        total.alias("total_content_length"), rate.alias("success_rate"),
    )
    return money6(rows)


@case(
    "A9",
    f"""WITH {SCRAPED} SELECT count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
      sum(length(content)) FILTER (success)::BIGINT AS total_chars FROM scraped""",
)
def scrape_run_totals(spark, sf_dir):
    return scrape_totals(scraped_documents(spark, sf_dir))


HISTORY = "SELECT query_hash AS id, query, created_at, execution_time, pages_scraped, total_content_length FROM rows"


def listed(rows):
    return rows.select(
        "id", "query", X.iso_timestamp(F.col("created_at")).alias("created_at"), "execution_time",
        F.col("pages_scraped").cast("bigint").alias("pages_scraped"), "total_content_length",
    )


@case("O1 P5 N9", f"WITH {ANSWERS} {HISTORY} ORDER BY created_at DESC, query_hash LIMIT 10")
def newest_history(spark, sf_dir):
    return listed(list_history(to_store_row(answers(spark, sf_dir)), 10))


@case("O2 F9 P5", f"WITH {ANSWERS} {HISTORY} WHERE contains(lower(document), 'query 1') ORDER BY created_at DESC, query_hash LIMIT 20")
def matching_history(spark, sf_dir):
    return listed(list_history(to_store_row(answers(spark, sf_dir)), 20, "QUERY 1"))


@case("P5 N9", f"WITH {ANSWERS} {HISTORY}")
def whole_history(spark, sf_dir):
    return listed(list_history(to_store_row(answers(spark, sf_dir)), None))


@case(
    "P6 A10",
    f"""WITH {OUTCOME_LOG}, {REFERENCE} SELECT {COUNTS.replace('total_pages_scraped', 'round(cache_hits / (cache_hits + cache_misses) * 100, 9) AS cache_hit_rate')},
      round(total_execution_time / total_queries, 9) AS average_execution_time, total_pages_scraped,
      (SELECT count(DISTINCT doc_id // 5) FROM documents) AS total_entries, true AS has_size,
      (SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S') FROM outcomes) AS last_updated FROM counted""",
)
def stats_report(spark, sf_dir):
    path = scratch(spark, "store")
    insert_results(spark, path, to_store_row(answers(spark, sf_dir)))
    rows = money(stats(spark, outcome_log(spark, sf_dir), path), *RATES)
    return rows.withColumns(
        {"has_size": F.col("cache_size_mb") > 0, "last_updated": F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss")}
    ).drop("cache_size_mb")
