"""Text, address and scalar rules over whole tables."""

from pyspark.sql import functions as F

from querymill.defaults import MIN_CONTENT_LENGTH
from querymill.functions import classify as C, text as X, urls as U, vectors as V
from querymill.operators.history import contains_term
from querymill.operators.links import accepted_links
from querymill.plans.resolve import classify, validate
from querymill.schemas import is_confidence
from querymill.sources.pages import read_queries
from querymill.sources.store import not_expired
from workloads.base import (
    ALL_TEXTS, STORED, asked_texts, case, quoted, sql_clean, sql_normalize, sql_strip, sql_truncate, sql_words,
    stored_queries, table,
)

LOWERED = "lower({0})"


def _contains(patterns, expr):
    return "(" + " OR ".join(f"contains({expr}, '{quoted(p)}')" for p in patterns) + ")"


def sql_class(expr: str) -> str:
    """SQL for (status, confidence, reason)."""
    bad = f"({_contains(C.COMMAND_PATTERNS, f'lower({expr})')} OR length({sql_strip(expr)}) < 3)"
    good = _contains(C.SEARCH_PATTERNS, f"lower({expr})")
    return (
        f"CASE WHEN {bad} THEN 'invalid' ELSE 'valid' END AS status, "
        f"CASE WHEN {bad} THEN 0.7::DOUBLE WHEN {good} THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence, "
        f"CASE WHEN {bad} THEN '{C.REASON_COMMAND}' WHEN {good} THEN '{C.REASON_SEARCH}' ELSE '{C.REASON_OTHER}' END AS reason"
    )


@case("S1 T1", f"SELECT conv_id * 1000 + turn AS query_id, {sql_normalize('text')} AS query FROM conversations")
def normalize_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return read_queries(turns, "text", "id").select("query_id", X.normalize_query(F.col("query")).alias("query"))


@case("T2", f"WITH {ALL_TEXTS} SELECT query_id, query_hash FROM asked_hash")
def query_hash(spark, sf_dir):
    asked = asked_texts(spark, sf_dir)
    return asked.select("query_id", X.query_hash(X.normalize_query(F.col("query"))).alias("query_hash"))


@case("T3 F1", f"WITH {ALL_TEXTS} SELECT query_id, {sql_class('query')} FROM asked_norm")
def classify_heuristic(spark, sf_dir):
    asked = asked_texts(spark, sf_dir).withColumn("query", X.normalize_query(F.col("query")))
    return classify(asked).select("query_id", "status", "confidence", "reason")


@case(
    "P4",
    f"""WITH {ALL_TEXTS}, c AS (SELECT query_id, query, {sql_class('query')} FROM asked)
    SELECT query_id, query, status, confidence, reason,
      CASE WHEN status = 'invalid' THEN '{C.SUGGESTION}' ELSE '' END AS suggestions FROM c""",
)
def validate_queries(spark, sf_dir):
    checked = validate(asked_texts(spark, sf_dir))
    return checked.select(
        "query_id", "query", "status", "confidence", "reason", F.array_join("suggested_improvements", "|").alias("suggestions")
    )


@case(
    "F2",
    f"""SELECT doc_id, length(text) BETWEEN 1 AND 500 AND length({sql_strip('text')}) > 0 AS accepted,
      doc_id % 30 BETWEEN 1 AND 20 AS accepted_limit FROM documents""",
)
def request_check(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.is_valid_request(F.col("text")).alias("accepted"),
        X.is_valid_max_results(F.col("doc_id") % 30).alias("accepted_limit"),
    )


SEED = "²①½ ☃ "


@case("T4", f"SELECT doc_id, {sql_clean(f'''('{SEED}' || text)''')} AS content FROM documents")
def clean_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.clean_text(F.concat(F.lit(SEED), "text")).alias("content"))


@case(
    "T5",
    f"SELECT doc_id, {sql_truncate('text')} AS content, {sql_truncate('text', 2000)} AS excerpt FROM documents",
)
def truncate_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", X.truncate(F.col("text")).alias("content"), X.truncate(F.col("text"), 2000).alias("excerpt")
    )


@case("T6 T7", f"SELECT doc_id, {sql_words('text')} AS word_count, length(text) AS content_length FROM documents")
def word_and_char_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.word_count(F.col("text")).cast("bigint").alias("word_count"),
        F.length("text").cast("bigint").alias("content_length"),
    )


@case(
    "T12",
    """SELECT doc_id, len(s) AS sentences, s[1] AS first_sentence, s[-1] AS last_sentence
    FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents)""",
)
def split_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", X.split_sentences(F.col("text")).alias("s"))
    return docs.select(
        "doc_id", F.size("s").cast("bigint").alias("sentences"), F.get("s", F.lit(0)).alias("first_sentence"),
        F.element_at("s", -1).alias("last_sentence"),
    )


@case(
    "T8",
    r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#]*)', 1)), 'www\.', '') AS domain
    FROM pages""",
)
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.url_domain(F.col("url")).alias("domain"))


# Addresses bent so that every rule of the filter has work to do.
def bent_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    kind, url = F.col("page_id") % 7, F.col("url")
    bent = (
        F.when(kind == 1, F.concat(url, F.lit(".pdf")))
        .when(kind == 2, F.concat(url, F.lit(".DOCX")))
        .when(kind == 3, F.concat(url, F.lit(".pdf?x=1")))
        .when(kind == 4, F.regexp_replace(url, "://[^/]+", "://www.YouTube.com"))
        .when(kind == 5, F.regexp_replace(url, "^https?://", ""))
        .otherwise(url)
    )
    return pages.select("page_id", bent.alias("url"))


BENT = """
bent AS (SELECT page_id, CASE page_id % 7 WHEN 1 THEN url || '.pdf' WHEN 2 THEN url || '.DOCX' WHEN 3 THEN url || '.pdf?x=1'
  WHEN 4 THEN regexp_replace(url, '://[^/]+', '://www.YouTube.com') WHEN 5 THEN regexp_replace(url, '^https?://', '')
  ELSE url END AS url FROM pages),
judged AS (SELECT page_id, url, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')
  AND NOT regexp_matches(lower(url), '[.](pdf|docx?|xlsx?|pptx?)$')
  AND NOT regexp_matches(lower(regexp_extract(url, '://([^/?#]+)', 1)), '(facebook|twitter|instagram|linkedin|youtube)[.]com')
  AS is_valid FROM bent)"""


@case("F5", f"WITH {BENT} SELECT page_id, url, is_valid FROM judged")
def valid_urls(spark, sf_dir):
    return bent_urls(spark, sf_dir).select("page_id", "url", U.is_valid_url(F.col("url")).alias("is_valid"))


@case("T9", "SELECT page_id, url || '+x' AS target FROM pages")
def unwrap_redirect(spark, sf_dir):
    wrapped = F.concat(F.lit("/url?q="), F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")), F.lit("+x&sa=U"))
    return table(spark, sf_dir, "pages").select("page_id", U.unwrap_redirect(wrapped).alias("target"))


@case(
    "T10",
    f"""WITH {ALL_TEXTS} SELECT query_id, 'https://html.duckduckgo.com/html/?q=' || q AS url_a,
      'https://www.google.com/search?q=' || q || '&hl=en' AS url_b
    FROM (SELECT query_id, replace(url_encode(query), '%20', '+') AS q FROM asked_norm)""",
)
def search_url(spark, sf_dir):
    query = X.normalize_query(F.col("query"))
    return asked_texts(spark, sf_dir).select(
        "query_id", U.search_url(query, "a").alias("url_a"), U.search_url(query, "b").alias("url_b")
    )


@case(
    "T11",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source ELSE source || ' | ' || text END AS document FROM documents""",
)
def document_text(spark, sf_dir):
    summary = F.when(F.col("doc_id") % 8 == 0, "").when(F.col("doc_id") % 4 != 0, F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.document_text(F.col("source"), summary).alias("document")
    )


@case(
    "T13",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Given' WHEN 1 THEN 'T ' || page_id ELSE url END AS title,
      CASE page_id % 3 WHEN 0 THEN 'Given' ELSE 'Untitled' END AS prompt_title FROM pages""",
)
def default_titles(spark, sf_dir):
    kind = F.col("page_id") % 3
    given = F.when(kind == 0, "Given").when(kind == 1, "")
    own = F.when(kind == 1, F.concat(F.lit("T "), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select(
        "page_id", X.page_title(given, own, F.col("url")).alias("title"), X.prompt_title(given).alias("prompt_title")
    )


@case(
    "F9",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'the ') OR contains(lower(source), 'rc1')",
)
def text_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(contains_term("THE ", "text") | contains_term("rC1", "source")).select("doc_id")


@case(
    "F3 F4",
    f"SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) >= {MIN_CONTENT_LENGTH}",
)
def meaningful_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(F.length("text") >= MIN_CONTENT_LENGTH).select("doc_id", F.length("text").cast("bigint").alias("chars"))


@case(
    "F11",
    f"WITH {STORED} SELECT query_hash FROM stored WHERE created_at >= TIMESTAMP '2024-01-08' - INTERVAL 7 DAY + INTERVAL 1 HOUR",
)
def result_ttl(spark, sf_dir):
    as_of = F.timestamp_seconds(F.lit(1_704_067_200 + 7 * 86400 + 3600))
    return not_expired(stored_queries(spark, sf_dir), 7, as_of).select("query_hash")


@case(
    "F10 W1",
    f"""WITH {BENT}, kept AS (SELECT page_id // 10 AS group_id, page_id % 10 AS dom_order, url,
        CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'T' ELSE 'T ' || page_id END AS title, is_valid FROM judged)
    SELECT group_id, url, title, row_number() OVER (PARTITION BY group_id ORDER BY dom_order) AS position
    FROM kept WHERE is_valid AND title <> ''""",
)
def link_positions(spark, sf_dir):
    kind = F.col("page_id") % 4
    title = F.when(kind == 0, "").when(kind == 1, "T").otherwise(F.concat(F.lit("T "), F.col("page_id").cast("string")))
    raw = bent_urls(spark, sf_dir).select(
        F.floor(F.col("page_id") / 10).alias("group_id"), (F.col("page_id") % 10).alias("dom_order"), "url",
        title.alias("title"), F.lit("a").alias("engine"),
    )
    return accepted_links(raw, "group_id").select("group_id", "url", "title", F.col("position").cast("bigint").alias("position"))


@case(
    "V3",
    """SELECT event_id, least(greatest(value / 10 - 0.2, 0.0), 1.0)::DOUBLE AS clamped,
      value / 10 - 0.2 BETWEEN 0 AND 1 AS in_range FROM events""",
)
def clamp_confidence(spark, sf_dir):
    raw = F.col("value") / 10 - 0.2
    return table(spark, sf_dir, "events").select(
        "event_id", V.clamp_confidence(raw).alias("clamped"), is_confidence(raw).alias("in_range")
    )


@case("V4", "SELECT doc_id, n_chars / 1048576 AS mb FROM documents")
def bytes_to_mb(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.bytes_to_mb(F.col("n_chars")).alias("mb"))


@case(
    "D1",
    """SELECT event_id, iso, true AS round_trip FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
      CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS iso FROM events)""",
)
def iso_timestamps(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", X.iso_timestamp(ts).alias("iso"), (X.parse_iso(X.iso_timestamp(ts)) == ts).alias("round_trip")
    )
