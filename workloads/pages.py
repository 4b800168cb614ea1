"""HTML extraction and result page links over the page table."""

from pyspark.sql import functions as F

from querymill.operators.links import search_links
from querymill.plans.answer import scrape_links
from querymill.sources.pages import scan_pages, scan_result_pages
from workloads.base import as_of, case, sql_clean, sql_truncate, table

ENTITIES = [("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©")]


def sql_decode(expr: str) -> str:
    for entity, char in ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char}')"
    # Some headings are cut off behind "&amp", which is an ampersand all the same.
    return f"regexp_replace({expr}, '&amp;?', '&', 'g')"


BODY = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
BARE = (
    "regexp_replace(regexp_replace(regexp_replace(" + BODY
    + ", '(?s)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
)
PAGE_TEXT = f"""
page_text AS (SELECT page_id, url, {sql_clean('bare')} AS cleaned, title
  FROM (SELECT page_id, url, {sql_decode(BARE)} AS bare, {sql_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title FROM pages)),
scanned AS (SELECT page_id, url, title, {sql_truncate('cleaned')} AS content FROM page_text)"""


@case("H1 H2 H3 H4", f"WITH {PAGE_TEXT} SELECT page_id, title, content FROM scanned")
def page_text(spark, sf_dir):
    return scan_pages(table(spark, sf_dir, "pages")).select("page_id", "title", "content")


def with_status(pages):
    kind = F.col("page_id") % 6
    status = F.when(kind.isin(0, 1), 200).when(kind == 2, 404).when(kind == 3, 500).when(kind == 5, 301)
    return pages.withColumn("http_status", status)


STATUS = "CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 5 THEN 301 END"


@case(
    "S2 F6",
    f"""WITH {PAGE_TEXT}, s AS (SELECT *, {STATUS} AS st FROM scanned)
    SELECT page_id, coalesce(st < 400, false) AS success, CASE WHEN st < 400 THEN title END AS title,
      CASE WHEN st < 400 THEN content ELSE '' END AS content,
      CASE WHEN st IS NULL THEN 'HTTP No response' WHEN st >= 400 THEN 'HTTP ' || st END AS error_message FROM s""",
)
def scan_crawl_snapshot(spark, sf_dir):
    rows = scan_pages(with_status(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "success", "title", "content", "error_message")


# Saved result pages made of the page table: twelve results each for engine a, as headings for b.
def result_pages_a(spark, sf_dir):
    number = F.col("page_id").cast("string")
    kind = F.col("page_id") % 5
    # Every other result page has one more document link, which leaves it short of five links.
    skipped = (kind == 0) | ((kind == 2) & (F.floor(F.col("page_id") / 12) % 2 == 1))
    href = F.when(skipped, F.concat("url", F.lit(".pdf"))).otherwise(F.col("url"))
    title = F.when(kind == 1, "").otherwise(F.concat(F.lit("Result <b>"), number, F.lit("</b> &amp; more")))
    snippet = F.when(kind == 2, "").otherwise(F.concat(F.lit('<div class="x result__snippet"> about '), number, F.lit("</div>")))
    block = F.concat(
        F.lit('<div class="result web"><h2><a class="result__a" href="'), href, F.lit('">'), title, F.lit("</a></h2>"),
        snippet, F.lit("</div>"),
    )
    return _gathered(table(spark, sf_dir, "pages").select("page_id", block.alias("block")))


def result_pages_b(spark, sf_dir):
    number = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    wrapped = F.concat(F.lit("/url?q="), F.url_encode("url"), F.lit("&amp;sa=U"))
    title = F.when(kind == 1, "No").otherwise(F.concat(F.lit("Page "), number))
    block = (
        F.when(kind == 3, F.concat(F.lit("<div><div><h3>"), title, F.lit('</h3></div><a href="'), "url", F.lit('">go</a></div>')))
        .otherwise(F.concat(F.lit('<div><a href="'), wrapped, F.lit('"><br><h3>'), title, F.lit("</h3></a></div>")))
    )
    return _gathered(table(spark, sf_dir, "pages").select("page_id", block.alias("block")))


def _gathered(blocks):
    # Twelve blocks to a page.
    return (
        blocks.groupBy(F.floor(F.col("page_id") / 12).alias("query_id"))
        .agg(F.sort_array(F.collect_list(F.struct("page_id", "block"))).alias("blocks"))
        .select(
            "query_id",
            F.concat(F.lit("<html><body><script>var a='<div class=\"result\">'</script>"), F.array_join(F.col("blocks.block"), "\n"), F.lit("</body>")).alias("html"),
        )
    )


LINKS_A = """
links_a AS (SELECT page_id // 12 AS query_id, 'a' AS engine,
    row_number() OVER (PARTITION BY page_id // 12 ORDER BY page_id) AS position, 'Result' || page_id || '& more' AS title, url,
    CASE WHEN page_id % 5 = 2 THEN NULL ELSE 'about ' || page_id END AS snippet
  FROM pages WHERE page_id % 12 < 10 AND page_id % 5 NOT IN (0, 1)
    AND NOT (page_id % 5 = 2 AND page_id // 12 % 2 = 1))"""
LINKS_B = """
links_b AS (SELECT * FROM (SELECT page_id // 12 AS query_id, 'b' AS engine,
    row_number() OVER (PARTITION BY page_id // 12 ORDER BY page_id) AS position, 'Page ' || page_id AS title, url,
    NULL::VARCHAR AS snippet FROM pages WHERE page_id % 12 < 10 AND page_id % 4 <> 1) WHERE position <= 5)"""


def _links(rows):
    return rows.withColumn("position", F.col("position").cast("bigint"))


@case("S6 H5 W1", f"WITH {LINKS_A} SELECT * FROM links_a")
def result_links_engine_a(spark, sf_dir):
    return _links(scan_result_pages(result_pages_a(spark, sf_dir), "a"))


@case("S6 H6 T9", f"WITH {LINKS_B} SELECT * FROM links_b")
def result_links_engine_b(spark, sf_dir):
    return _links(scan_result_pages(result_pages_b(spark, sf_dir), "b"))


UNION = f"""{LINKS_A}, {LINKS_B},
short AS (SELECT query_id FROM (SELECT DISTINCT page_id // 12 AS query_id FROM pages) q
  WHERE (SELECT count(*) FROM links_a WHERE links_a.query_id = q.query_id) < 5),
both_links AS (SELECT * FROM links_a UNION ALL SELECT * FROM links_b WHERE query_id IN (SELECT query_id FROM short)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY engine, position) AS source_rank FROM both_links)
  WHERE source_rank <= 5)"""


def chosen_links(spark, sf_dir):
    a = scan_result_pages(result_pages_a(spark, sf_dir), "a")
    b = scan_result_pages(result_pages_b(spark, sf_dir), "b")
    return search_links(a, b)


@case("U1 O3", f"WITH {UNION} SELECT query_id, engine, position, title, url, source_rank FROM chosen")
def links_of_both_engines(spark, sf_dir):
    return _links(chosen_links(spark, sf_dir)).select(
        "query_id", "engine", "position", "title", "url", F.col("source_rank").cast("bigint").alias("source_rank")
    )


@case(
    "J6",
    f"""WITH {UNION}, {PAGE_TEXT}, fetched AS (SELECT *, {STATUS} AS st FROM scanned),
    linked AS (SELECT * REPLACE (CASE WHEN source_rank = 5 THEN url || '/gone' ELSE url END AS url) FROM chosen)
    SELECT query_id, source_rank AS position, c.url, c.title, CASE WHEN st < 400 THEN content ELSE '' END AS content,
      coalesce(st < 400, false) AS success,
      CASE WHEN st IS NULL THEN 'HTTP No response' WHEN st >= 400 THEN 'HTTP ' || st END AS error_message
    FROM linked c LEFT JOIN fetched f ON c.url = f.url""",
)
def query_pages(spark, sf_dir):
    # The fifth link of a query leads to a page that was never stored: a failed scrape.
    gone = F.when(F.col("source_rank") == 5, F.concat("url", F.lit("/gone"))).otherwise(F.col("url"))
    links = chosen_links(spark, sf_dir).withColumn("url", gone)
    rows = scrape_links(links, with_status(table(spark, sf_dir, "pages")), as_of())
    return rows.select(
        "query_id", F.col("position").cast("bigint").alias("position"), "url", "title", "content", "success", "error_message"
    )
