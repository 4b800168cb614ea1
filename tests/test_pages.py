"""HTML reading on literal pages, result page links, crawl snapshots."""

import pytest
from pyspark.sql import functions as F

from querymill.operators.links import search_links
from querymill.plans.answer import scrape_links
from querymill.sources.markup import read_page
from querymill.sources.pages import scan_pages, scan_result_pages

PAGES = [
    ("<html><head><title>T &amp; U</title></head><body>one <b>two</b> three</body></html>", "one two three", "T & U"),
    ("<body><main>in main</main><article>in article</article></body>", "in main", None),
    ("<body><div class='x'>no</div><article>in article</article></body>", "in article", None),
    ("<body><div class='side'>no</div><div class='big Main-part'>yes<div>inner</div></div>tail</body>", "yes inner", None),
    ("no body <p>at all", "no body at all", None),
    ("<body>a<script>var x = '<p>';</script>b<style>p{}</style>c<nav>n</nav><header>h</header><footer>f</footer>"
     "<aside>s</aside><iframe>i</iframe>d</body>", "a b c d", None),
    ("<body>keep<nav>lost <p>still lost</body>after", "keep", None),
    ("<body><nav><main>dropped main</main></nav><p>body text</p></body>", "body text", None),
    ("<body>a<!-- no --> b<template>t <p>u</p></template><ruby>k<rt>r</rt></ruby></body>", "a b k", None),
    ("<body>x&nbsp;y &copy; &#233; &#x41; &unknown; &lt;tag&gt;</body>", "x\xa0y © é A &unknown <tag>", None),
    ("<body><p>one<p>two<br>three</i>four</p></body>", "one two three four", None),
    ("<body><div class='content'/>outside</body>", "", None),
    ("<body><main></main>rest</body>", "", None),
    ("<title></title><body>x</body>", "x", ""),
    ("<body>a<![CDATA[raw]]>b</body>", None, None),
    ("", "", None),
]


@pytest.mark.parametrize(("markup", "text", "title"), PAGES)
def test_read_page(markup, text, title):
    got = read_page(markup)
    assert got[1] == title
    if text is not None:
        assert got[0] == text


def test_unreadable_page_is_empty():
    assert read_page(None) == ("", None)


def test_scan_pages(spark):
    html = "<title>Name</title><body>" + "word ☃ " * 3 + "</body>"
    rows = [(1, "u1", html, 200), (2, "u2", html, 404), (3, "u3", html, None), (4, "u4", "<body>short</body>", 301), (5, "u5", None, 200)]
    got = scan_pages(spark.createDataFrame(rows, "page_id int, url string, html string, http_status int")).orderBy("page_id").collect()
    assert [(r["title"], r["content"], r["success"], r["error_message"]) for r in got] == [
        ("Name", "word   word   word", True, None), (None, "", False, "HTTP 404"), (None, "", False, "HTTP No response"),
        (None, "", True, None), (None, "", True, None),
    ]
    long = spark.createDataFrame([(1, "u", "<body>" + "ab " * 6000 + "</body>")], "page_id int, url string, html string")
    assert len(scan_pages(long).first()["content"]) == 10003


RESULT_A = """
<body><div class="results-wrapper">
<div class="result"><h2><a class="result__a" href="http://a.b/1">First <b>one</b></a></h2><a class="result__snippet">About first</a></div>
<div class="result ad"><h2><a class="result__a" href="http://www.youtube.com/x">Video</a></h2></div>
<div class="result"><h2><a href="http://a.b/2">Plain link</a></h2><span class="snippet">S</span></div>
<div class="result"><p>no link</p></div>
<div class="result"><a class="result__a" href="">No address</a></div>
<div class="result"><a class="result__a" href="http://a.b/3"></a></div>
<div class="result"><a class="result__a" href="http://a.b/4">Fourth</a></div></div></body>"""

RESULT_B = """
<body><div><a href="/url?q=https%3A%2F%2Fa.b%2Fc%2Bd&amp;sa=U"><h3>Wrapped  result</h3></a></div>
<div><div><h3>Side result</h3></div><a href="http://side.x/">x</a></div>
<div><a href="http://short.x/"><h3>ab</h3></a></div>
<div><a><h3>No address</h3></a></div><div><div><div><div><h3>Too deep</h3></div></div></div><a href="http://deep.x/">x</a></div>
<div><a href="/url?q=http://plus.x/a+b"><h3>Plus</h3></a></div></body>"""


def test_engine_a(spark):
    got = scan_result_pages(spark.createDataFrame([(1, RESULT_A), (2, "<p>none</p>"), (3, None)], "query_id int, html string"), "a")
    assert [(r["position"], r["title"], r["url"], r["snippet"]) for r in got.orderBy("position").collect()] == [
        (1, "Firstone", "http://a.b/1", "About first"), (2, "Plain link", "http://a.b/2", "S"), (3, "Fourth", "http://a.b/4", None),
    ]


def test_engine_a_falls_through_selectors(spark):
    page = '<section class="web-result"><h3><a href="http://x.y/">T</a></h3></section>'
    got = scan_result_pages(spark.createDataFrame([(1, page)], "query_id int, html string"), "a").collect()
    assert [(r["title"], r["url"]) for r in got] == [("T", "http://x.y/")]


def test_engine_a_reads_ten_containers(spark):
    page = "".join(f'<div class="result"><a href="http://x.y/{i}">T{i}</a></div>' for i in range(15))
    assert scan_result_pages(spark.createDataFrame([(1, page)], "query_id int, html string"), "a").count() == 10


def test_engine_b(spark):
    got = scan_result_pages(spark.createDataFrame([(1, RESULT_B)], "query_id int, html string"), "b")
    assert [(r["position"], r["title"], r["url"]) for r in got.orderBy("position").collect()] == [
        (1, "Wrapped result", "https://a.b/c+d"), (2, "Side result", "http://side.x/"), (3, "Plus", "http://plus.x/a+b"),
    ]


def links(spark, engine, counts):
    rows = [(q, engine, i + 1, f"t{i}", f"http://{engine}/{i % 3}") for q, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "query_id int, engine string, position int, title string, url string")


def test_second_engine_fills_up(spark):
    first, second = links(spark, "a", {1: 7, 2: 3}), links(spark, "b", {1: 4, 2: 4, 3: 2})
    got = search_links(first, second).orderBy("query_id", "source_rank").collect()
    assert [(r["query_id"], r["engine"], r["position"]) for r in got] == (
        [(1, "a", i) for i in range(1, 6)] + [(2, "a", 1), (2, "a", 2), (2, "a", 3), (2, "b", 1), (2, "b", 2)] + [(3, "b", 1), (3, "b", 2)]
    )
    once = search_links(first, second, dedup=True).orderBy("query_id", "source_rank").collect()
    # The first engine filled query 1, so the second stays unused although copies were dropped.
    assert [(r["query_id"], r["engine"], r["position"]) for r in once] == (
        [(1, "a", i) for i in (1, 2, 3)] + [(2, "a", i) for i in (1, 2, 3)] + [(2, "b", 1), (2, "b", 2), (3, "b", 1), (3, "b", 2)]
    )


def test_html_does_not_cross_an_exchange(spark, tmp_path):
    spark.createDataFrame([(1, "http://x/", "<body>some words here</body>")], "page_id int, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    wanted = spark.createDataFrame([(1, 1, "T", "http://x/"), (1, 2, "U", "http://gone/")], "query_id int, source_rank int, title string, url string")
    rows = scrape_links(wanted, pages, F.lit("2024-01-01 00:00:00"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("page_text")]
    assert "html" not in above
    got = rows.orderBy("position").collect()
    assert [(r["title"], r["content"], r["success"], r["status"], r["error_message"]) for r in got] == [
        ("T", "some words here", True, "success", None), ("U", "", False, "failed", "HTTP No response"),
    ]


def test_deep_pages_keep_their_links():
    from querymill.sources.markup import links_of_engine_a

    one = '<div class="result"><a class="result__a" href="http://x/1">T</a></div>'
    want = links_of_engine_a(one)
    assert want and links_of_engine_a("<p>" * 5000 + one) == want
