"""Streaming jobs, run to the end over files of the given tables."""

import re

from pyspark.sql import functions as F

from querymill.plans.respond import process
from querymill.plans.tally import kept_access, kept_counters
from querymill.schemas import RESULT_STORE, SUMMARY as SUMMARY_TYPE
from querymill.sources.pages import scan_result_pages
from querymill.sources.store import insert_results, to_store_row
from querymill.streaming.jobs import (
    end_of_feed, resolve_stream, rolling_counters, suppress_repeats, suppress_repeats_timed, tally_stream,
)
from workloads.base import ASKED, CASES, OUTCOME_LOG, STORED, as_of, case, outcome_log, table
from workloads.jobs import SUMMARY, asked_with_vectors, sql_resolve, store_with_vectors
from workloads.pages import LINKS_A, result_pages_a
from workloads.similarity import PAIRS
from workloads.store import RATES, access_counts, counters_per_user, money, scratch


def streamed(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def finish(writer, spark, name):
    """Run a query over all that is there and wait for it."""
    query = writer.option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()


# Files of a batch, at most, and rows that each of them has at least if there are several.
FILES, FILE_ROWS = 64, 1 << 16


def in_batches(rows, path, batches):
    """The rows (batch, others) as files that a stream reads one batch after another, in that order.

    Every batch has equally many files, as a stream takes so many at a time: one, or as many as tasks can write with FILE_ROWS rows or more in each.
    """
    rows = rows.withColumn("_place", F.pmod(F.xxhash64(*rows.columns), F.lit(FILES)).cast("int")).persist()
    sizes = {(r[0], r[1]): r[2] for r in rows.groupBy("batch", "_place").count().collect()}  # at most FILES a batch

    def filled(files):
        return all(sum(sizes.get((number, place), 0) for place in range(file, FILES, files)) >= FILE_ROWS for number in range(batches) for file in range(files))

    files = FILES
    while files > 1 and not filled(files):
        files //= 2
    for number in range(batches):
        own = rows.where(F.col("batch") == number)
        dealt = own.repartition(1) if files == 1 else own.repartitionById(files, F.pmod("_place", F.lit(files)))
        dealt.drop("batch", "_place").write.mode("append").parquet(path)
    rows.unpersist()
    return rows.sparkSession.readStream.schema(rows.drop("batch", "_place").schema).option("maxFilesPerTrigger", files).parquet(path)


@case(
    "ST2",
    f"""WITH {OUTCOME_LOG}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM outcomes),
    closed AS (SELECT * FROM w WHERE b + INTERVAL 6 HOUR <= (SELECT max(ts) FROM outcomes) - INTERVAL 1 HOUR)
    SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (outcome = 'miss') AS cache_misses,
      count(*) FILTER (outcome = 'exact_hit') AS cache_hits,
      round(coalesce(sum(execution_time) FILTER (outcome = 'miss'), 0), 4) AS total_execution_time FROM closed GROUP BY b""",
)
def rolling_window_counters(spark, sf_dir):
    """Windows that the watermark has closed; those still open are not out yet."""
    path = scratch(spark, "windows")
    counted = rolling_counters(outcome_log(spark, sf_dir, streamed(spark, sf_dir, "events")), "6 hours")
    finish(counted.writeStream.format("parquet").option("path", path), spark, "windows")
    return spark.read.schema(counted.schema).parquet(path).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "cache_misses", "cache_hits",
        F.round("total_execution_time", 4).alias("total_execution_time"),
    )


@case(
    "ST2",
    f"""WITH {OUTCOME_LOG}, w AS (SELECT *, unnest([time_bucket(INTERVAL 2 HOUR, ts) - i * INTERVAL 2 HOUR FOR i IN [0, 1, 2]]) AS b FROM outcomes)
    SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) FILTER (outcome = 'miss') AS cache_misses,
      count(*) FILTER (outcome = 'exact_hit') AS cache_hits,
      round(coalesce(sum(execution_time) FILTER (outcome = 'miss'), 0), 4) AS total_execution_time FROM w GROUP BY b""",
)
def sliding_windows_to_the_end(spark, sf_dir):
    """Windows of six hours every two hours, over batches of five days; a heartbeat ends the feed, so every window comes out."""
    log = outcome_log(spark, sf_dir)
    start = F.lit("2024-01-01").cast("timestamp")
    rows = log.withColumn("batch", F.floor(F.timestamp_diff("DAY", start, F.col("ts")) / 5))
    batches = rows.agg(F.max("batch")).first()[0] + 1
    last = end_of_feed(log, "8 hours").withColumn("batch", F.lit(batches))
    feed, path = in_batches(rows.unionByName(last), scratch(spark, "log"), batches + 1), scratch(spark, "windows")
    windows = rolling_counters(feed, "6 hours", "2 hours")
    finish(windows.writeStream.format("parquet").option("path", path), spark, "windows")
    return spark.read.schema(windows.schema).parquet(path).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "cache_misses", "cache_hits",
        F.round("total_execution_time", 4).alias("total_execution_time"),
    )


@case("ST3", f"WITH {OUTCOME_LOG} SELECT DISTINCT query_hash FROM outcomes")
def repeats_suppressed(spark, sf_dir):
    """With a horizon longer than the log, one row per hash is left."""
    path = scratch(spark, "repeats")
    feed = suppress_repeats(outcome_log(spark, sf_dir, streamed(spark, sf_dir, "events")), "60 days")
    finish(feed.writeStream.format("parquet").option("path", path), spark, "repeats")
    return spark.read.schema(feed.schema).parquet(path).select("query_hash")


# Six micro-batches of five days; every fiftieth event comes a batch late, and a third of all events are of one hash. A batch drops what is late by the watermark
# of the batch before it, and forgets at its end what its own watermark has passed.
IN_BATCHES = """
feed AS (SELECT ts, CASE WHEN event_id % 3 = 0 THEN sha256('hot') ELSE sha256(user_id::VARCHAR) END AS query_hash,
  (event_id + CASE WHEN event_id % 50 = 7 THEN n // 5 ELSE 0 END) * 5 // n AS batch FROM events, (SELECT count(*) AS n FROM events)),
marks AS (SELECT b.batch, coalesce((SELECT max(epoch_ms(ts)) FROM feed f WHERE f.batch < b.batch) - 259200000, 0) AS mark FROM (SELECT DISTINCT batch FROM feed) b),
first AS (SELECT f.batch, query_hash, min(ts) AS ts FROM feed f LEFT JOIN marks l ON l.batch = f.batch - 1 WHERE epoch_us(ts) > coalesce(l.mark, 0) * 1000 GROUP BY ALL),
walk AS (
  SELECT -1::BIGINT AS batch, query_hash, NULL::BIGINT AS until, NULL::TIMESTAMP AS ts FROM (SELECT DISTINCT query_hash FROM feed)
  UNION ALL
  SELECT batch, query_hash, CASE WHEN next > mark THEN next END, out FROM (
    SELECT m.batch, w.query_hash, m.mark, CASE WHEN w.until IS NULL THEN f.ts END AS out,
      coalesce(w.until, (epoch_us(f.ts) + 999) // 1000 + 259200000) AS next
    FROM walk w JOIN marks m ON m.batch = w.batch + 1 LEFT JOIN first f ON f.batch = m.batch AND f.query_hash = w.query_hash))"""


@case("ST3", f"WITH RECURSIVE {IN_BATCHES} SELECT query_hash, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM walk WHERE ts IS NOT NULL")
def repeats_within_days_suppressed(spark, sf_dir):
    """With a horizon of three days, so that hashes come again; late rows, and one hash that a third of the rows have."""
    events = table(spark, sf_dir, "events")
    n, number = events.count(), F.col("event_id")
    late = F.when(number % 50 == 7, F.lit(n // 5)).otherwise(0)
    asked = F.when(number % 3 == 0, F.lit("hot")).otherwise(F.col("user_id").cast("string"))
    rows = events.select(F.sha2(asked, 256).alias("query_hash"), F.col("ts").cast("timestamp").alias("ts"), F.floor((number + late) * 5 / n).alias("batch"))
    feed, path = in_batches(rows, scratch(spark, "feed"), 6), scratch(spark, "repeats")
    finish(suppress_repeats_timed(feed, "3 days").writeStream.format("parquet").option("path", path), spark, "repeats")
    return spark.read.schema(feed.schema).parquet(path).select("query_hash", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


def store_and_links(spark, sf_dir):
    """A store of the stored queries, and result pages for some of the asked ones."""
    store, none = scratch(spark, "store"), F.lit(None)
    rows = store_with_vectors(spark, sf_dir).select(
        "query_hash", "query", "embedding", "created_at", none.cast("double").alias("execution_time"),
        F.lit("valid").alias("status"), F.lit(0.8).alias("confidence"), F.lit("r").alias("reason"),
        F.array().cast(RESULT_STORE["scraped_content"].dataType).alias("scraped_content"), none.cast(SUMMARY_TYPE).alias("summary"),
    )
    insert_results(spark, store, to_store_row(rows))
    return store, scan_result_pages(result_pages_a(spark, sf_dir), "a")


def outcomes_of(spark, sf_dir, feed, store, links):
    out = scratch(spark, "outcomes")
    finish(resolve_stream(feed, store, out, links, table(spark, sf_dir, "pages"), as_of), spark, "resolve")
    return spark.read.option("basePath", out).parquet(out)


def counted(outcomes, *by):
    return outcomes.groupBy(*by).agg(F.count("*").alias("queries"), F.countDistinct("query_hash").alias("distinct_queries"))


@case("ST1 P1 P3", SUMMARY)
def resolve_as_stream(spark, sf_dir):
    """The feed in one batch: the same outcomes as the batch job."""
    asked = asked_with_vectors(spark, sf_dir).select("query_id", "arrival", "ts", "query", "embedding")
    feed = scratch(spark, "feed")
    asked.write.parquet(feed)
    stream = spark.readStream.schema(asked.schema).parquet(feed)
    return counted(outcomes_of(spark, sf_dir, stream, *store_and_links(spark, sf_dir)), "outcome")


BATCHES = 3
BATCH_OF_QUERY = "CASE WHEN query_id % 1000 < 500 THEN 0 WHEN query_id % 1000 < 700 THEN 1 ELSE 2 END"
# Every fourth result page belongs to an opening turn, the others to the user's next ones.
LINKED = "query_id // 4 * 1000 + query_id % 4 * 2"


def sql_batches(count: int) -> str:
    """Each batch against the store as the one before left it: with its misses that have links."""
    steps = ["stored_v_0 AS (SELECT stored.query_hash, stored.query, e, label FROM stored, v WHERE vec_id = stored.n % (SELECT n FROM n))"]
    own = re.sub(r"(?m)^stored_v AS .*$", "", sql_resolve()).replace("FROM stored)", "FROM stored_v)")
    for i in range(count):
        steps.append(f"asked_hash_{i} AS (SELECT * FROM asked_hash WHERE {BATCH_OF_QUERY} = {i})")
        steps.append(re.sub(r"\b(classed|open|dist|ranked|found|looked|placed|outcomes|asked_hash|stored_v)\b", rf"\1_{i}", own).strip())
        steps.append(f"""stored_v_{i + 1} AS (SELECT * FROM stored_v_{i} UNION ALL SELECT query_hash, query, e, NULL FROM placed_{i}
          WHERE arrival = saved_at AND query_id IN (SELECT {LINKED} FROM links_a))""")
    steps.append("every AS (" + " UNION ALL ".join(f"SELECT {i} AS batch_id, outcome, query_hash FROM outcomes_{i}" for i in range(count)) + ")")
    return ",\n".join(steps)


@case(
    "ST1 P1 P3",
    f"""WITH {ASKED}, {STORED}, {PAIRS}, {LINKS_A}, {sql_batches(BATCHES)}
    SELECT batch_id, outcome, count(*) AS queries, count(DISTINCT query_hash) AS distinct_queries FROM every GROUP BY ALL""",
)
def resolve_in_batches(spark, sf_dir):
    """Three micro-batches: later ones find what earlier ones have saved, and ask again what could not be answered."""
    asked = asked_with_vectors(spark, sf_dir).select("query_id", "arrival", "ts", "query", "embedding", F.expr(BATCH_OF_QUERY).alias("batch"))
    store, links = store_and_links(spark, sf_dir)
    links = links.withColumn("query_id", F.expr("query_id div 4 * 1000 + query_id % 4 * 2"))
    feed = in_batches(asked, scratch(spark, "feed"), BATCHES)
    outcomes = outcomes_of(spark, sf_dir, feed, store, links)
    return counted(outcomes, F.col("batch_id").cast("int").alias("batch_id"), "outcome")


@case(
    "P1 P2 P3 K1",
    f"""WITH {ASKED}, {STORED}, {PAIRS}, {LINKS_A}, {sql_resolve()},
    linked AS (SELECT {LINKED} AS query_id, least(count(*), 5) AS pages FROM links_a GROUP BY ALL),
    lost AS (SELECT query_hash FROM outcomes WHERE outcome = 'miss' AND query_id NOT IN (SELECT query_id FROM linked)),
    saved AS (SELECT query_hash, query, pages FROM outcomes JOIN linked USING (query_id) WHERE outcome = 'miss' UNION ALL SELECT query_hash, query, 0 FROM stored),
    settled AS (SELECT *, CASE WHEN outcome IN ('miss', 'exact_hit') AND query_hash IN (SELECT query_hash FROM lost) THEN 'failed' ELSE outcome END AS kind FROM outcomes),
    delivered AS (SELECT s.*, saved.query AS result_query, saved.query_hash AS result_hash, pages FROM settled s
      LEFT JOIN saved ON saved.query_hash = CASE kind WHEN 'similar_hit' THEN matched_hash WHEN 'exact_hit' THEN s.query_hash WHEN 'miss' THEN s.query_hash END)
    SELECT query_id, kind AS outcome, kind IN ('exact_hit', 'similar_hit', 'miss') AS success,
      CASE kind WHEN 'invalid' THEN 'Invalid query: ' || e_reason WHEN 'failed' THEN 'Failed to scrape any web content for your query' WHEN 'miss' THEN 'Successfully processed your query'
        WHEN 'exact_hit' THEN 'Found cached result for your query' ELSE 'Found similar query: ''' || stored_query || ''' (similarity: ' || printf('%.2f', similarity_score) || ')' END AS message,
      CASE kind WHEN 'invalid' THEN e_reason WHEN 'failed' THEN 'Web scraping failed' END AS error, kind IN ('exact_hit', 'similar_hit') AS cache_hit,
      CASE kind WHEN 'similar_hit' THEN stored_query END AS similar_query_used, result_query, result_hash, pages AS result_pages FROM delivered""",
)
def responses(spark, sf_dir):
    """One response per query: resolved, answered, saved, settled and delivered with its result."""
    store, links = store_and_links(spark, sf_dir)
    links = links.withColumn("query_id", F.expr("query_id div 4 * 1000 + query_id % 4 * 2"))
    asked = asked_with_vectors(spark, sf_dir).select("query_id", "arrival", "ts", "query", "embedding")
    settled, delivered = process(spark, store, asked, links, table(spark, sf_dir, "pages"), as_of())
    return delivered.join(settled.select("query_id", "outcome"), "query_id").select(
        "query_id", "outcome", "success", "message", "error", "cache_hit", "similar_query_used", F.col("result.query").alias("result_query"),
        F.col("result.query_hash").alias("result_hash"), F.when(F.col("result").isNotNull(), F.size("result.scraped_content")).cast("bigint").alias("result_pages"),
    )


def tallied(spark, sf_dir):
    """The outcome log in five batches by number, of which the counters of each are kept."""
    rows = outcome_log(spark, sf_dir).withColumn("batch", F.col("query_id") % 5)
    path = scratch(spark, "tally")
    finish(tally_stream(in_batches(rows, scratch(spark, "log"), 5), path, "query_hash"), spark, "tally")
    return path


@case("A1 A2 A3 A4 P6", CASES[counters_per_user.__name__].sql)
def counters_kept_by_batch(spark, sf_dir):
    return money(kept_counters(spark, tallied(spark, sf_dir), "query_hash", full=True), *RATES)


@case("A8 P6", CASES[access_counts.__name__].sql)
def access_kept_by_batch(spark, sf_dir):
    rows = kept_access(spark, tallied(spark, sf_dir))
    return rows.withColumn("last_accessed", F.date_format("last_accessed", "yyyy-MM-dd'T'HH:mm:ss"))
