import hashlib
import random

import regex

from querymill.llm import winnowing as W
from querymill.session import Scratch
from tests.llm.helpers import LONG, ODD

UNITS = regex.compile(W.UNITS)


def fingerprints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    made = W.with_fingerprint(df, "t", "f")
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    return {r["i"]: [(x >> 32, W.LAST - (x & W.LAST)) for x in r["f"]] for r in made.collect()}


def window_minima(hashes):
    """Rightmost smallest of each window, once each, in order."""
    n = max(1, len(hashes) - W.WINDOW + 1) if hashes else 0
    out = []
    for i in range(n):
        window = list(enumerate(hashes[i:i + W.WINDOW], i))
        best = min(window, key=lambda p: (p[1], -p[0]))
        if not out or out[-1] != (best[1], best[0]):
            out.append((best[1], best[0]))
    return out


def test_minima_of_every_window(spark):
    rng = random.Random(1)
    texts = [t for t in ODD if t != LONG] + [" ".join(rng.choice(["ab", "abcdefgh", "x!", "éé", "12345", "a"]) for _ in range(rng.randrange(40))) for _ in range(80)] + ["a " * 50]
    # All grams of a text as Spark hashes them: with windows of one gram, every gram is its own minimum.
    width, W.WINDOW = W.WINDOW, 1
    try:
        single = fingerprints(spark, texts)
    finally:
        W.WINDOW = width
    got = fingerprints(spark, texts)
    for i, text in enumerate(texts):
        units = UNITS.findall(text or "")
        assert [p for _, p in single[i]] == list(range(max(min(len(units), 1), len(units) - W.K + 1)))
        assert got[i] == window_minima([h for h, _ in single[i]])
        grams = [tuple(units[j:j + W.K]) for j, _ in enumerate(single[i])]
        same = {}
        for g, (h, _) in zip(grams, single[i]):
            assert same.setdefault(g, h) == h
        assert len(set(same.values())) == len(same)


def test_a_shared_passage_shares_a_fingerprint(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(1000)]
    passage = [rng.choice(words) for _ in range(W.WINDOW + W.K - 1)]
    texts = [" ".join([rng.choice(words) for _ in range(rng.randrange(60))] + passage + [rng.choice(words) for _ in range(60)]) for _ in range(20)]
    got = fingerprints(spark, texts)
    common = set.intersection(*[{h for h, _ in f} for f in got.values()])
    assert common


def test_edited_texts(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(None, "no id at all, but words enough to be told apart"), (1, "tie b"), (1, "tie a"), (1, "tie a")]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, fingerprint string").repartition(5)
    with Scratch(spark) as scratch:
        got = W.compare_edited(scratch, df).collect()
        assert W.compare_edited(scratch, df.limit(0)).count() == 0
        alone = W.compare_edited(scratch, df.where("doc_id = 100")).first()
    assert len(got) == len(rows) and alone["near_next"] == 1.0
    ids = sorted({r[0] for r in rows}, key=lambda i: (i is not None, i or 0))
    want = []
    for i, text in rows:
        text = text or ""
        after, m = ids[(ids.index(i) + 1) % len(ids)], len(text) // 4
        longest = max(len(t or "") for j, t in rows if j == i) // 4
        start = min((t or "")[:longest] for j, t in rows if j == after)[:m]
        want.append((i, len(text), hashlib.sha256((text[:len(text) - m] + start).encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:3] for r in got], key=key) == sorted(want, key=key)
    whole = [r for r in got if (r["doc_id"] or 0) >= 100 and r["n_chars"] > 200]
    assert sum(r["near_edited"] for r in whole) / len(whole) > 0.5 and sum(r["near_next"] for r in whole) / len(whole) < 0.1
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
