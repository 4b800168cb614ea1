"""Model replies and summaries over whole tables."""

from pyspark.sql import functions as F

from querymill.functions import classify as C, replies as R, summaries as S
from querymill.operators.answers import nest_pages, summarize
from workloads.base import as_of, SCRAPED, case, scraped_documents, sql_strip, sql_words, table
from workloads.text import sql_class



@case(
    "N1",
    r"""SELECT doc_id, CASE WHEN regexp_extract(r, '\{[^}]*\}') <> '' THEN regexp_extract(r, '\{[^}]*\}') ELSE """
    + sql_strip("r")
    + """ END AS json FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || ' {"a": "' || doc_id || '"} tail } ' || text END AS r
      FROM documents)""",
)
def extract_json(spark, sf_dir):
    boxed = F.concat("text", F.lit(' {"a": "'), F.col("doc_id").cast("string"), F.lit('"} tail } '), "text")
    reply = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(boxed)
    return table(spark, sf_dir, "documents").select("doc_id", R.extract_json(reply).alias("json"))


@case(
    "N2 X2",
    f"""WITH h AS (SELECT doc_id, text, {sql_class('text')} FROM documents)
    SELECT doc_id,
      CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'invalid' ELSE status END AS status,
      CASE doc_id % 5 WHEN 0 THEN 0.25::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE confidence END AS confidence,
      CASE doc_id % 5 WHEN 0 THEN 'because' WHEN 1 THEN '{C.REASON_MODEL}' ELSE reason END AS reason FROM h""",
)
def parse_classification(spark, sf_dir):
    kind = F.col("doc_id") % 5
    reply = (
        F.when(kind == 0, F.lit('Sure: {"status": "pending", "confidence": "0.25", "reason": "because"} ok?'))
        .when(kind == 1, F.lit('{"status": "invalid", "confidence": true, "suggested_improvements": null}'))
        .when(kind == 2, F.lit('{"status": "maybe", "confidence": 0.5}'))
        .when(kind == 3, F.lit('{"status": "valid", "confidence": 1.5}'))
        .otherwise(F.col("text"))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", C.parse_classification(F.col("text"), reply).alias("c"))
    return rows.select("doc_id", "c.status", "c.confidence", "c.reason")


def sql_text_summary(expr: str) -> str:
    """SQL for (summary, key_points, confidence) of free text."""
    text = sql_strip(expr)
    bullets = (
        f"list_filter(list_transform(list_filter(list_transform(string_split({text}, chr(10)), lambda x: {sql_strip('x')}), "
        f"lambda x: regexp_matches(x, '^(•|-|[*]|[1-7][.])')), lambda x: {sql_strip('''regexp_replace(x, '^[•*1-9. -]+', '')''')}), lambda x: length(x) > 10)"
    )
    sentences = (
        f"list_transform(list_filter(list_transform(string_split({text}, '. ')[1:5], lambda x: {sql_strip('x')}), "
        "lambda x: length(x) > 20 AND length(x) < 200), lambda x: CASE WHEN ends_with(x, '.') THEN x ELSE x || '.' END)"
    )
    stock = "[" + ", ".join(f"'{p}'" for p in R.STOCK_POINTS) + "]"
    points = f"CASE WHEN len({bullets}) > 0 THEN {bullets}[1:7] WHEN len({sentences}) > 0 THEN {sentences} ELSE {stock} END"
    return f"{text} AS summary, array_to_string({points}, '|') AS key_points"


BULLETS = "CASE WHEN doc_id % 4 = 0 THEN '- ' || replace(text, '. ', chr(10) || '2. ') ELSE text END"


@case("N5", f"SELECT doc_id, {sql_text_summary('t')}, 0.5::DOUBLE AS confidence FROM (SELECT doc_id, {BULLETS} AS t FROM documents)")
def summary_from_text(spark, sf_dir):
    listed = F.concat(F.lit("- "), F.replace("text", F.lit(". "), F.lit("\n2. ")))
    text = F.when(F.col("doc_id") % 4 == 0, listed).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", R.summary_from_text(text).alias("s"))
    return rows.select("doc_id", "s.summary", F.array_join("s.key_points", "|").alias("key_points"), "s.confidence")


@case(
    "N4 X4",
    f"""WITH f AS (SELECT doc_id, text, source, {sql_text_summary('text')} FROM documents),
    r AS (SELECT doc_id, doc_id % 5 AS kind, f.* EXCLUDE (doc_id) FROM f)
    SELECT doc_id,
      CASE kind WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '{{"summary": 5, "key_points": [], "confidence": 1}}'
        WHEN 3 THEN NULL ELSE summary END AS summary,
      CASE kind WHEN 0 THEN source || '|True|7|2.5' WHEN 1 THEN '' WHEN 2 THEN '{{"summary": 5, "key_points": [], "confidence": 1}}.'
        WHEN 3 THEN NULL ELSE key_points END AS key_points,
      CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 3 THEN NULL ELSE 0.5 END::DOUBLE AS confidence,
      CASE kind WHEN 3 THEN 'argument of type ''int'' is not iterable' END AS error FROM r""",
)
def parse_summary(spark, sf_dir):
    kind, text = F.col("doc_id") % 5, F.col("text")
    points = F.concat(F.lit('", "", true, 0, 7, null, 2.5], "confidence": 3}'))
    encoded = F.regexp_extract(F.to_json(F.struct(text.alias("summary"))), r"(?s)^(.*)\}$", 1)
    reply = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), encoded, F.lit(', "key_points": ["'), "source", points, F.lit("\n```")))
        .when(kind == 1, F.concat(encoded, F.lit(', "key_points": [], "confidence": 0.25}')))
        .when(kind == 2, F.lit('{"summary": 5, "key_points": [], "confidence": 1}'))
        .when(kind == 3, F.col("doc_id").cast("string"))
        .otherwise(text)
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", R.parse_summary(reply).alias("s"))
    return rows.select("doc_id", "s.summary", F.array_join("s.key_points", "|").alias("key_points"), "s.confidence", "s.error")


def nested(spark, sf_dir):
    pages = nest_pages(scraped_documents(spark, sf_dir), "query_id")
    return pages.withColumn("query", F.concat(F.lit("query "), F.col("query_id").cast("string")))


def shown(rows):
    return rows.select(
        "query_id", "summary.summary", F.array_join("summary.key_points", "|").alias("key_points"),
        F.array_join("summary.sources", "|").alias("sources"), "summary.confidence",
        F.col("summary.word_count").cast("bigint").alias("word_count"),
    )


LEAD = f"list_filter(list_transform(string_split(content, '. ')[1:2], lambda x: {sql_strip('x')}), lambda x: length(x) > 50)[1] || '.'"
POINT = f"list_filter(list_transform(string_split(content, '. ')[1:5], lambda x: {sql_strip('x')}), lambda x: length(x) > 30 AND length(x) < 150)[1]"
EMPTY_SUMMARY = "'" + S.EMPTY_TEXT[0] .replace("'", "''") + "' || query || '" + S.EMPTY_TEXT[1].replace("'", "''") + "'"
EXTRACTIVE = f"""
page AS (SELECT *, 'query ' || query_id AS query, row_number() OVER (PARTITION BY query_id, success ORDER BY position) AS nth FROM scraped),
piece AS (SELECT *, {LEAD} AS lead, {POINT} AS point FROM page),
rolled AS (SELECT query_id, any_value(query) AS query, count(*) FILTER (success) AS good,
    string_agg(lead, ' ' ORDER BY position) FILTER (success AND nth <= 3) AS leads,
    string_agg(point, '|' ORDER BY position) FILTER (success AND nth <= 3) AS points,
    coalesce(string_agg(url, '|' ORDER BY position) FILTER (success), '') AS good_urls,
    coalesce(string_agg(url, '|' ORDER BY position) FILTER (NOT success), '') AS bad_urls,
    count(*) FILTER (success AND length(content) >= 100) AS meaningful,
    coalesce(string_agg(url, '|' ORDER BY position) FILTER (success AND length(content) >= 100), '') AS meaningful_urls
  FROM piece GROUP BY query_id),
extract AS (SELECT query_id,
    CASE WHEN good = 0 THEN {EMPTY_SUMMARY}
      WHEN leads IS NOT NULL THEN 'Based on the available sources for ''' || query || ''': ' || leads
      ELSE 'Information found about ''' || query || ''' from ' || good || ' sources.' END AS summary,
    CASE WHEN good = 0 THEN '{'|'.join(S.EMPTY_POINTS)}' ELSE coalesce(points, 'Found information from ' || good || ' sources|{'|'.join(S.EXTRACTIVE_POINTS)}') END AS key_points,
    CASE WHEN good = 0 THEN bad_urls ELSE good_urls END AS sources,
    CASE WHEN good = 0 THEN 0.0 ELSE 0.3 END::DOUBLE AS confidence FROM rolled)"""


@case("N6 W2 T12", f"WITH {SCRAPED}, {EXTRACTIVE} SELECT *, {sql_words('summary')} AS word_count FROM extract")
def extractive_summaries(spark, sf_dir):
    return shown(summarize(nested(spark, sf_dir), as_of()))


@case(
    "N7",
    f"""WITH {SCRAPED}, {EXTRACTIVE}, e AS (SELECT query_id, 'An error occurred while processing your query: ''' || query ||
        '''. The system was able to retrieve content from ' || good || ' sources, but encountered an issue during summarization. Error: boom' AS summary,
      good_urls, bad_urls, {EMPTY_SUMMARY} AS empty_text FROM rolled)
    SELECT query_id, summary, '{'|'.join(S.ERROR_POINTS)}' AS key_points, good_urls AS sources, 0.0::DOUBLE AS confidence,
      {sql_words('summary')} AS word_count, empty_text, bad_urls AS empty_sources FROM e""",
)
def empty_and_error_summaries(spark, sf_dir):
    query, pages = F.col("query"), F.col("scraped_content")
    rows = nested(spark, sf_dir).select(
        "query_id", S.error_summary(query, pages, F.lit("boom"), as_of()).alias("summary"),
        S.empty_summary(query, pages, as_of()).alias("_empty"),
    )
    return rows.select(
        "query_id", "summary.summary", F.array_join("summary.key_points", "|").alias("key_points"),
        F.array_join("summary.sources", "|").alias("sources"), "summary.confidence",
        F.col("summary.word_count").cast("bigint").alias("word_count"),
        F.col("_empty.summary").alias("empty_text"), F.array_join("_empty.sources", "|").alias("empty_sources"),
    )


PROMPT = """
source AS (SELECT *, 'query ' || query_id AS query, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n
  FROM scraped WHERE success AND length(content) >= 100),
prompt AS (SELECT query_id, any_value(query) AS query, 'User Query: ' || any_value(query) || E'\\n\\nContent from multiple web sources:\\n' ||
    string_agg(E'\\n--- Source ' || n || ': ' || CASE WHEN title = '' THEN 'Untitled' ELSE title END || ' (' || url || E') ---\\n' ||
      CASE WHEN length(content) > 2000 THEN substr(content, 1, 2000) || '...' ELSE content END || E'\\n', E'\\n' ORDER BY n) ||
    E'\\n\\nPlease create a comprehensive summary that directly answers the query: ''' || any_value(query) || E'''\\n""" + S.PROMPT_CLOSING + """' AS prompt
  FROM source GROUP BY query_id)"""


@case("N8 W4", f"WITH {SCRAPED}, {PROMPT} SELECT query_id, prompt FROM prompt")
def build_prompts(spark, sf_dir):
    pages = S.meaningful_pages(F.col("scraped_content"))
    rows = nested(spark, sf_dir).where(F.size(pages) > 0)
    return rows.select("query_id", S.build_prompt(F.col("query"), pages).alias("prompt"))


def counting_model(prompts):
    """Stands for a model: answers with the prompt's length, refuses lengths that end in 3."""
    if len(prompts) > 1 and any(len(p) % 10 == 3 for p in prompts):
        raise ValueError("one of these prompts is refused")
    if any(len(p) % 10 == 3 for p in prompts):
        raise ValueError("refused")
    return ['{"summary": "about %d", "key_points": ["%d"], "confidence": 0.9}' % (len(p), len(p)) for p in prompts]


@case(
    "N10 X4 A6",
    f"""WITH {SCRAPED}, {EXTRACTIVE}, {PROMPT}, routed AS (SELECT rolled.*, length(prompt) AS n FROM rolled LEFT JOIN prompt USING (query_id)),
    s AS (SELECT query_id,
      CASE WHEN meaningful = 0 THEN {EMPTY_SUMMARY} WHEN n % 10 = 3 THEN 'An error occurred while processing your query: ''' || query ||
        '''. The system was able to retrieve content from ' || good || ' sources, but encountered an issue during summarization. Error: refused'
        ELSE 'about ' || n END AS summary,
      CASE WHEN meaningful = 0 THEN '{'|'.join(S.EMPTY_POINTS)}' WHEN n % 10 = 3 THEN '{'|'.join(S.ERROR_POINTS)}' ELSE n::VARCHAR END AS key_points,
      CASE WHEN meaningful = 0 THEN bad_urls WHEN n % 10 = 3 THEN good_urls ELSE meaningful_urls END AS sources,
      CASE WHEN meaningful = 0 OR n % 10 = 3 THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM routed)
    SELECT *, {sql_words('summary')} AS word_count FROM s""",
)
def model_summaries(spark, sf_dir):
    return shown(summarize(nested(spark, sf_dir), as_of(), counting_model))
