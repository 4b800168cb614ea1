"""Column functions against plain Python restatements of the rules."""

import hashlib
import re
from urllib.parse import quote_plus, unquote, urlparse

from pyspark.sql import functions as F

from querymill.functions import classify as C, text as X, urls as U

TEXTS = [
    "", " ", "a", "  Best   places\tto\n visit ", " x y　", "x\x1cy\x1fz", "What is machine learning?",
    "²①½ héllo wörld ___ ok", "é combining mark here", "zero​width joiner‍ text", "12345678901",
    "1234567890", "[brackets] {braces} <tags> & more; (kept) 'q' \"d\"", "ÀÉÎ STRASSE ß", "日本語 の テキスト です よ",
    "line one\nline two\r\nline three", "☃☃☃☃☃☃☃☃☃☃☃☃☃", "tabs\tand ☃ symbols ☃ between", "a" * 10003, "b " * 6000,
]


def values(spark, column, inputs=TEXTS):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def python_clean(text):
    text = re.sub(r"\s+", " ", text)
    text = re.sub(r"[^\w\s.,!?;:()\-'\"]+", " ", text).strip()
    return text if len(text) > 10 else ""


def test_normalize(spark):
    want = [re.sub(r"\s+", " ", t.strip()) for t in TEXTS]
    assert values(spark, X.normalize_query(F.col("t"))) == want
    assert values(spark, X.normalize_query(X.normalize_query(F.col("t")))) == want


def test_hash(spark):
    got = values(spark, X.query_hash(X.normalize_query(F.col("t"))))
    want = [hashlib.sha256(re.sub(r"\s+", " ", t.strip()).lower().strip().encode()).hexdigest() for t in TEXTS]
    assert got == want


def test_clean_truncate_count(spark):
    safe = [t for t in TEXTS if "́" not in t]
    assert values(spark, X.clean_text(F.col("t")), safe) == [python_clean(t) for t in safe]
    assert values(spark, X.truncate(F.col("t"))) == [t[:10000] + "..." if len(t) > 10000 else t for t in TEXTS]
    assert values(spark, X.word_count(F.col("t"))) == [len(t.split()) for t in TEXTS]
    assert values(spark, X.split_sentences(F.col("t")), ["a. b. ", "x", ""]) == [["a", "b", ""], ["x"], [""]]


def test_request_and_titles(spark):
    asked = ["", "  ", "ok", "x" * 500, "x" * 501]
    assert values(spark, X.is_valid_request(F.col("t")), asked) == [False, False, True, True, False]
    assert values(spark, X.page_title(F.lit(""), F.lit("T"), F.lit("u")), ["x"]) == ["T"]
    assert values(spark, X.page_title(F.lit(None), F.lit(None), F.lit("u")), ["x"]) == ["u"]
    assert values(spark, X.prompt_title(F.col("t")), ["", "x"]) == ["Untitled", "x"]
    assert values(spark, X.document_text(F.lit("q"), F.col("t")), ["", "s", None]) == ["q", "q | s", "q"]


def test_iso(spark):
    stamps = ["2024-01-02T03:04:05", "2024-01-02T03:04:05.000600"]
    assert values(spark, X.iso_timestamp(X.parse_iso(F.col("t"))), stamps) == stamps
    assert values(spark, X.parse_iso(F.col("t")), ["nonsense"]) == [None]


def python_valid(url):
    try:
        parsed = urlparse(url)
    except ValueError:
        return False
    if not parsed.scheme or not parsed.netloc:
        return False
    if any(url.lower().endswith(e) for e in U.SKIPPED_EXTENSIONS):
        return False
    return not any(d in parsed.netloc.lower() for d in U.SKIPPED_DOMAINS)


URLS = [
    "http://a.b/c", "https://www.youtube.com/watch", "https://notfacebook.com.evil.org/", "http://a.b/c.PDF",
    "http://a.b/c.pdf?x=1", "http://a.b/c.docx", "ftp://host/file", "//a.b/c", "a.b/c", "http://", "mailto:x@y.z", "",
    "http://[::1]/x", "http://[::1/x", "  http://lead.ing/x", "1http://a.b", "http://a b/c", "javascript:void(0)",
    "http:///path", "HTTP://LinkedIn.com", "http://a.b?x=facebook.com",
]


def test_valid_url(spark):
    assert values(spark, U.is_valid_url(F.col("t")), URLS) == [python_valid(u) for u in URLS]


DOMAINS = {
    "http://www.a.b/c": "a.b", "https://user:pw@WWW.Example.COM:8080/x?y#z": "example.com", "http://awww.b.c/": "ab.c",
    "plain text": "plain text", "http://[::1]:80/x": "[::1]", "http://": "http://", "http:a.b/c": "a.b",
    "http://a b/c": "http://a b/c", "mailto:x@y.z": "", "http://m.ab.c#top": "m.ab.c",
}


def test_domain(spark):
    assert values(spark, U.url_domain(F.col("t")), list(DOMAINS)) == list(DOMAINS.values())


def test_redirect_and_search(spark):
    links = [
        "/url?q=https%3A%2F%2Fa.b%2Fc%2Bd&sa=U", "/url?q=https://a.b/x+y&sa=U", "/url?q=a%zzb%41", "https://a.b", "/url?q=",
    ]
    want = [unquote(u.replace("/url?q=", "").split("&")[0]) if u.startswith("/url?q=") else u for u in links]
    assert values(spark, U.unwrap_redirect(F.col("t")), links) == want
    queries = ["a b", "c++ ~x*y", "é/?&=", "-_.!'()"]
    got = values(spark, U.search_url(F.col("t"), "b"), queries)
    assert got == [f"https://www.google.com/search?q={quote_plus(q)}&hl=en" for q in queries]


def test_heuristic(spark):
    cases = {
        "What is machine learning?": ("valid", 0.8), "walk my pet": ("invalid", 0.7), "send email": ("invalid", 0.7),
        "book appointment": ("invalid", 0.7), "locally grown food": ("invalid", 0.7), "in this context what": ("invalid", 0.7),
        "cheap laptop": ("valid", 0.8), "ab": ("invalid", 0.7), "abc": ("valid", 0.6), "": ("invalid", 0.7),
        "Python vs Java": ("valid", 0.8), " a ": ("invalid", 0.7),
    }
    got = values(spark, C.classify_heuristic(F.col("t")), list(cases))
    assert [(g["status"], g["confidence"]) for g in got] == list(cases.values())
    assert got[1]["suggested_improvements"] == [C.SUGGESTION]
    assert got[0]["suggested_improvements"] is None


REPLIES = [
    ('{"status": "valid", "confidence": 0.9, "reason": "r"}', ("valid", 0.9, "r", None)),
    ('text {"status": "pending", "confidence": "0.4"} more', ("pending", 0.4, C.REASON_MODEL, None)),
    ('{"status": "invalid", "confidence": true, "reason": null, "suggested_improvements": ["x"]}', ("invalid", 1.0, None, ["x"])),
    ('{"status": "valid", "confidence": 1.5}', ("valid", 0.6, C.REASON_OTHER, None)),
    ('{"status": "maybe", "confidence": 0.5}', ("valid", 0.6, C.REASON_OTHER, None)),
    ('{"status": "invalid"}', ("valid", 0.6, C.REASON_OTHER, None)),
    ('{"status": "invalid", "confidence": 0.5, "reason": {"a": 1}}', ("valid", 0.6, C.REASON_OTHER, None)),
    ('{"status": "invalid", "confidence": 0.5, "reason": 3}', ("valid", 0.6, C.REASON_OTHER, None)),
    ("no json", ("valid", 0.6, C.REASON_OTHER, None)),
    ("[1]", ("valid", 0.6, C.REASON_OTHER, None)),
    (None, ("valid", 0.6, C.REASON_OTHER, None)),
]


def test_parse_classification(spark):
    got = values(spark, C.parse_classification(F.lit("plain"), F.col("t")), [r for r, _ in REPLIES])
    assert [tuple(g) for g in got] == [want for _, want in REPLIES]
