"""URL filters by association rules.

Frequent combinations of URL tokens that go with a label are mined from labelled URLs, one token more at a time, wherever in the URL the
tokens stand; those of enough support and confidence are rules. A URL meets a rule if it has all its tokens: tokens look up the rules they are in (the inverted index), and a rule that is
found as often as it has tokens fits. Explicit rules of hosts and paths come first. All in DataFrame functions.
"""

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from querymill.session import Scratch, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"


class Mining(NamedTuple):
    support: float = 0.002  # share of the labelled URLs that have the combination and the label
    urls: int = 25  # and how many of them, at least
    confidence: float = 0.5  # share of the URLs with the combination that have the label
    tokens: int = 24  # has no effect: combinations are made of all tokens of a URL
    items: int = 6  # tokens of a rule, at most


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, the host and every domain above it, path segments (numbers as ``#``), query keys, and whether there is a fragment."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(F.regexp_replace(path(url), "[0-9]+", "#"), "/"), lambda s: s != "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), lambda k: k != "")
    return F.when(F.locate("://", url) > 0, F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, "://", 1)))), domains,
        F.transform(segments, lambda s: F.concat(F.lit("path:"), s)), F.transform(keys, lambda k: F.concat(F.lit("key:"), k)),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array()),
    ))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(rule, items, confidence, support): combinations that go with the label ``block``, from ``labelled`` (url, label).

    ``label`` is ``block`` or ``allow``; rows with another or none, and URLs without ``://``, teach nothing. No labelled rows, no
    rules. The rules are as many as the support admits, however many URLs there are.
    """
    known = labelled.where(F.col("label").isin(BLOCK, ALLOW)).select(F.array_sort(tokens(F.col("url"))).alias("items"), (F.col("label") == BLOCK).cast("long").alias("bad"))
    # URLs of the same tokens are one row with their number: numbers in paths are no tokens, so there are far fewer.
    baskets = cut(known.where("size(items) > 0").groupBy("items").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    total = baskets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(mining.support, mining.urls / max(1, total))
    if least > 1:
        return baskets.sparkSession.createDataFrame([], "items array<string>, confidence double, support double, rule string")
    enough = f"bad >= {math.ceil(least * total)}"
    # A token that is too rare with the label is in no combination that is not.
    single = baskets.select("items", "n", "bad", F.explode("items").alias("token"))
    frequent = cut(single.groupBy("token").agg(F.sum("bad").alias("bad")).where(enough).select("token"))
    short = single.join(frequent, "token").groupBy("items", "n", "bad").agg(F.array_sort(F.collect_set("token")).alias("rest"))
    # Each row is a combination and what follows it in the order of a basket's tokens.
    at = cut(short.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(F.array().cast("array<string>").alias("items"), "rest", "n", "bad"))
    levels = []
    for _ in range(mining.items):
        longer = at.select("items", "rest", "n", "bad", F.posexplode("rest").alias("i", "token")).select(
            F.concat("items", F.array("token")).alias("items"), F.slice("rest", F.col("i") + 2, F.size("rest")).alias("rest"), "n", "bad"
        )
        levels.append(cut(longer.groupBy("items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(enough)))
        at = cut(longer.where("size(rest) > 0").join(levels[-1].select("items"), "items", "left_semi").groupBy("items", "rest").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
        if at.isEmpty():
            break
    counted = reduce(DataFrame.unionByName, levels).withColumns({"confidence": F.col("bad") / F.col("n"), "support": F.col("bad") / F.lit(total)})
    return counted.where(F.col("confidence") >= mining.confidence).select("items", "confidence", "support", F.array_join("items", " ").alias("rule"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url and any others) with mined_rule and mined_confidence of the most confident rule whose tokens they all have, or nulls.

    Of equally confident ones the first by name. Rows are judged by their URL: equal URLs once. Own columns of these names are replaced.
    """
    urls = urls.drop("mined_rule", "mined_confidence")
    index = rules.select("rule", "confidence", F.size("items").alias("needed"), F.explode("items").alias("token"))
    distinct = urls.select("url").distinct()
    hits = (
        distinct.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(index, "token")
        .groupBy("url", "rule", "confidence", "needed").agg(F.count("*").alias("found")).where("found = needed")
    )
    # Written, so that the rows of a URL that very many pages share can be split in the join.
    best = cut(hits.groupBy("url").agg(F.min(F.struct((-F.col("confidence")).alias("order"), "rule")).alias("best")))
    return urls.join(best, "url", "left").select(
        *[f"`{c}`" for c in urls.columns], F.col("best.rule").alias("mined_rule"), (-F.col("best.order")).alias("mined_confidence")
    )


def explicit(url: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest of a short list of rules that fits; nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r))
    fits = [((host(url) == r.host) | F.endswith(host(url), F.lit("." + r.host))) & F.startswith(path(url), F.lit(r.path)) for r in ordered]
    names = F.coalesce(*[F.when(f, r.host + r.path) for f, r in zip(fits, ordered)], F.lit(None).cast("string"))
    verdicts = F.coalesce(*[F.when(f, r.verdict) for f, r in zip(fits, ordered)], F.lit(None).cast("string"))
    return names, verdicts


def judge(scratch: Scratch, pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = (), mining: Mining = Mining()) -> DataFrame:
    """``pages`` (url and any others) with host, path, rule, verdict and the mined rule that fits.

    The verdict is that of the longest explicit rule; without one, block if a mined rule fits, else allow. A null URL has an empty
    host and path and is allowed unless a rule says otherwise. All rows stay. Own columns of the added names are replaced.
    """
    mined = scratch.cut(mine(labelled, mining))
    url = F.col("url")
    name, verdict = explicit(url, rules)
    return matched(pages, mined).withColumns({"host": host(url), "path": path(url), "rule": name}).withColumn(
        "verdict", F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), BLOCK).otherwise(ALLOW))
    )
