"""Registry and the shared inputs derived from the given tables, in Spark and in SQL."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from querymill.functions import text as X


class Case(NamedTuple):
    ids: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(ids: str, sql: str | None = None):
    """Register a function under its own name; ``ids`` are the inventory entries it covers."""

    def add(run):
        CASES[run.__name__] = Case(ids, run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return text.replace("'", "''")


def as_of():
    """The fixed "now" of the registered queries."""
    return F.lit("2024-01-01 00:00:00")


# SQL forms of the text rules.
SPACES = f"[{X.SPACE}]+"


def sql_normalize(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SPACES}', ' ', 'g'))"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACES}|{SPACES}$', '', 'g')"


def sql_clean(expr: str) -> str:
    line = f"trim(regexp_replace(regexp_replace({expr}, '{SPACES}', ' ', 'g'), '[^{quoted(X.KEPT)}]+', ' ', 'g'))"
    return f"(CASE WHEN length({line}) > 10 THEN {line} ELSE '' END)"


def sql_truncate(expr: str, limit: int = 10000) -> str:
    return f"(CASE WHEN length({expr}) > {limit} THEN substr({expr}, 1, {limit}) || '...' ELSE {expr} END)"


def sql_words(expr: str) -> str:
    return f"len(list_filter(regexp_split_to_array({expr}, '{SPACES}'), lambda x: x <> ''))"


# User turns, some made into commands, each asked a second time in other case and spacing; of some also their first two characters.
def asked_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_turns(table(spark, sf_dir, "conversations").where("role = 'user'"))


# The same of all turns, for rules on texts, whoever wrote them.
def asked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked_turns(table(spark, sf_dir, "conversations"))


def asked_turns(turns: DataFrame) -> DataFrame:
    varied = (
        F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("call "), "text")).otherwise(F.col("text"))
    )
    again = F.concat(F.lit("  "), F.replace(F.lower(varied), F.lit(" "), F.lit("  ")), F.lit("\t"))
    number = F.col("conv_id") * 1000 + F.col("turn")
    first = turns.select(number.alias("query_id"), varied.alias("query"), "conv_id", "turn")
    second = turns.select((number + 500).alias("query_id"), again.alias("query"), "conv_id", "turn")
    short = turns.where("conv_id % 11 = 0").select((number + 700).alias("query_id"), F.substring("text", 1, 2).alias("query"), "conv_id", "turn")
    return first.unionByName(second).unionByName(short).select(
        "query_id",
        (F.col("query_id") % 1000 * 1_000_000 + F.col("conv_id")).alias("arrival"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("query_id")).alias("ts"),
        "query", "conv_id", "turn",
    )


ASKED = """
varied AS (
  SELECT conv_id, turn,
    CASE WHEN conv_id % 7 = 0 THEN 'call ' || text ELSE text END AS t, text
  FROM conversations WHERE role = 'user'),
asked AS (
  SELECT conv_id * 1000 + turn AS query_id, t AS query, conv_id, turn FROM varied
  UNION ALL
  SELECT conv_id * 1000 + turn + 500, '  ' || replace(lower(t), ' ', '  ') || chr(9), conv_id, turn FROM varied
  UNION ALL
  SELECT conv_id * 1000 + turn + 700, substr(text, 1, 2), conv_id, turn FROM varied WHERE conv_id % 11 = 0),
asked_norm AS (
  SELECT query_id, query_id % 1000 * 1000000 + conv_id AS arrival, """ + sql_normalize("query") + """ AS query, conv_id, turn FROM asked),
asked_hash AS (SELECT *, sha256(lower(query)) AS query_hash FROM asked_norm)"""
ALL_TEXTS = ASKED.replace(" WHERE role = 'user'", "")


# Stored results: opening turns and benchmark passages, told apart by their key's origin.
def stored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = table(spark, sf_dir, "conversations").where("role = 'user' AND turn = 0").select(
        F.lower("text").alias("query"), (F.col("conv_id") * 8).alias("n")
    )
    passages = table(spark, sf_dir, "benchmark").select(F.col("text").alias("query"), (F.col("item_id") * 37).alias("n"))
    rows = opening.unionByName(passages).withColumn("query", X.normalize_query(F.col("query")))
    return rows.select(
        X.query_hash(F.col("query")).alias("query_hash"), "query", "n",
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("n") * 60).alias("created_at"),
    )


STORED = f"""
stored AS (
  SELECT sha256(lower(query)) AS query_hash, query, n, TIMESTAMP '2024-01-01' + n * INTERVAL 1 MINUTE AS created_at
  FROM (SELECT {sql_normalize('lower(text)')} AS query, conv_id * 8 AS n FROM conversations WHERE role = 'user' AND turn = 0
        UNION ALL SELECT {sql_normalize('text')}, item_id * 37 FROM benchmark))"""


# Outcome log made of events.
OUTCOME_OF_EVENT = {
    "click": "exact_hit", "purchase": "miss", "error": "invalid", "view": "similar_hit", "signup": "unsaved",
}


def outcome_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in OUTCOME_OF_EVENT.items()])
    return events.select(
        F.col("event_id").alias("query_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("query_hash"),
        F.lit(None).cast("string").alias("matched_hash"),
        kind.alias("outcome"),
        F.when(kind == "invalid", "invalid").otherwise("valid").alias("status"),
        F.when(kind == "miss", F.col("event_id") % 6).otherwise(0).cast("int").alias("pages_scraped"),
        F.col("value").alias("execution_time"),
    )


OUTCOME_LOG = """
outcomes AS (
  SELECT event_id, ts, sha256(user_id::VARCHAR) AS query_hash, outcome,
    CASE WHEN outcome = 'invalid' THEN 'invalid' ELSE 'valid' END AS status,
    CASE WHEN outcome = 'miss' THEN event_id % 6 ELSE 0 END AS pages_scraped, value AS execution_time
  FROM (SELECT *, CASE event_type """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOME_OF_EVENT.items()) + """ END AS outcome FROM events))"""


# Scraped pages made of documents: five per query, failed where the label says so.
def scraped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    good = F.coalesce(F.col("quality"), F.lit(1)) == 1
    content = F.when(good, X.truncate(X.clean_text(F.col("text")))).otherwise("")
    rows = docs.join(labels, "doc_id", "left").select(
        F.floor(F.col("doc_id") / 5).alias("query_id"),
        (F.col("doc_id") % 5).cast("int").alias("position"),
        F.concat(F.lit("http://h/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))).alias("title"),
        content.alias("content"),
        F.timestamp_seconds(F.lit(1_704_067_200)).alias("scraped_at"),
        good.alias("success"),
        F.when(~good, "HTTP 404").alias("error_message"),
        F.when(good, "success").otherwise("failed").alias("status"),
    )
    return rows.withColumn("content_length", F.length("content"))


SCRAPED = f"""
scraped0 AS (
  SELECT d.doc_id, coalesce(quality, 1) = 1 AS success, {sql_clean('text')} AS cleaned
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
scraped AS (
  SELECT doc_id // 5 AS query_id, doc_id % 5 AS position, 'http://h/' || doc_id AS url,
    CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Doc ' || doc_id END AS title,
    CASE WHEN success THEN {sql_truncate('cleaned')} ELSE '' END AS content, success
  FROM scraped0)"""
