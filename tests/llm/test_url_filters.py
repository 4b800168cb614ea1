import random
import re
from collections import Counter
from itertools import combinations

from querymill.llm import url_filters as U
from querymill.llm.queries import RULES
from querymill.session import Scratch
from tests.llm.helpers import multiset

ODD_URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "http://É.Example.org?q=1#f", "x://a.b/p?k=v&k=w&=z#/fr/", "http://sub.example.org/en/12", "http://example.org/EN/1", "ftp://org/", "http://notorg/", "http://a.com/de/?x", "http://a.com:80/de/", "http://a.com/fr/b://c/de/", "http://h/\n/a", "http://h/" + "a/" * 3000]


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(url):
    host, path = split(url)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def test_hosts_paths_and_explicit_rules(spark):
    rng = random.Random(1)
    urls = ODD_URLS + ["".join(rng.choice(["http://", "a.", "example.org", ".com", "/de/", "/fr/", "/en/1", "?", "#", "org", "/", "B"]) for _ in range(rng.randrange(7))) for _ in range(300)]
    name, verdict = U.explicit(U.F.col("url"), RULES)
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in df.select("url", U.host(U.F.col("url")), U.path(U.F.col("url")), name, verdict).collect():
        assert (tuple(r)[1:3], tuple(r)[3:]) == (split(r["url"]), rule_of(r["url"])), r["url"]


def labelled(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        host, lang, key = rng.choice(["spam.example.com", "www.good.org", "b.net"]), rng.choice(["en", "de"]), rng.choice(["", "?utm=1", "?page=2&ref=x"])
        bad = host.startswith("spam") and lang == "de" or key == "?utm=1" and rng.random() < 0.7
        rows.append((f"http://{host}/{lang}/{i}{key}", "block" if bad != (rng.random() < 0.05) else "allow"))
    return rows


def mined(spark, rows, mining):
    """Every combination of tokens, counted."""
    df = spark.createDataFrame(rows, "url string, label string")
    baskets = [(r["t"][:mining.tokens], r["label"]) for r in df.select(U.tokens(U.F.col("url")).alias("t"), "label").collect() if r["t"] and r["label"] in ("block", "allow")]
    seen, bad = Counter(), Counter()
    for items, label in baskets:
        for k in range(1, mining.items + 1):
            for c in combinations(sorted(items), k):
                seen[c] += 1
                bad[c] += label == "block"
    n = len(baskets)
    return {" ".join(c): bad[c] / seen[c] for c in seen if bad[c] >= max(mining.support * n, mining.urls) and bad[c] / seen[c] >= mining.confidence}


def test_rules_are_all_frequent_and_confident_combinations(spark):
    mining = U.Mining(0.05, 25, 0.6, 24, 4)
    rows = labelled(2) + [(None, "block"), ("no scheme", "block"), ("http://x/", None), ("http://x/", "other")]
    want = mined(spark, rows, mining)
    got = {r["rule"]: r["confidence"] for r in U.mine(spark.createDataFrame(rows, "url string, label string"), mining).collect()}
    assert want and {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_tokens_count_wherever_they_stand(spark):
    """Only query key and fragment, behind 30 path segments of each URL's own and a deep host, tell bad URLs from good ones."""
    deep = ".".join("abcdefgh")
    rows = [(f"http://{deep}/" + "/".join(f"{'xyzuvw'[j % 6] * (j + 1)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for j in range(30)) + ("?bad=1#f" if i % 3 == 0 else "?ok=1"), "block" if i % 3 == 0 else "allow") for i in range(300)]
    mining = U.Mining(0.05, 25, 0.6, items=2)
    df = spark.createDataFrame(rows, "url string, label string")
    rules = {r["rule"]: (r["confidence"], round(r["support"], 9)) for r in U.mine(df, mining).collect()}
    assert rules["key:bad"] == rules["fragment"] == rules["fragment key:bad"] == (1.0, round(1 / 3, 9))
    with Scratch(spark) as scratch:
        judged = U.judge(scratch, df, df, (), mining).select("label", "verdict").collect()
    assert all(r["label"] == r["verdict"] for r in judged)


def test_verdicts(spark):
    mining = U.Mining(0.05, 25, 0.6, 24, 4)
    rows = labelled(3)
    rules = mined(spark, rows, mining)
    pages = [(i, u, "own") for i, u in enumerate(ODD_URLS + [u for u, _ in rows[:200]])] + [(3, rows[0][0], "again")] * 2 + [(None, rows[1][0], "n")]
    df = spark.createDataFrame(pages, "page_id long, url string, verdict string")
    with Scratch(spark) as scratch:
        judged = U.judge(scratch, df, spark.createDataFrame(rows, "url string, label string"), RULES, mining)
        assert "Python" not in judged._jdf.queryExecution().executedPlan().toString() and "Arrow" not in judged._jdf.queryExecution().executedPlan().toString()
        got = judged.collect()
        tokens = {r["url"]: set(r["t"]) for r in df.select("url", U.tokens(U.F.col("url")).alias("t")).collect()}
        assert U.judge(scratch, df.limit(0), df.selectExpr("url", "'block' label").limit(0)).count() == 0
    want = []
    for page_id, url, _ in pages:
        fits = [(-c, r) for r, c in rules.items() if set(r.split(" ")) <= tokens[url]]
        name, verdict = rule_of(url)
        want.append((page_id, url, name, verdict or ("block" if fits else "allow"), min(fits)[1] if fits else None))
    assert multiset((r["page_id"], r["url"], r["rule"], r["verdict"], r["mined_rule"]) for r in got) == multiset(want)
    assert {w[3] for w in want} == {"allow", "block"} and any(w[4] for w in want)
