import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from querymill.llm import bpe_fold as B
from tests.llm.helpers import ODD

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("most", [0, 1000])
def test_ids_are_those_of_the_library(spark, library, most):
    rng = random.Random(3)
    signs = "ab CD1²é \u0085\n\t\x00 'sß漢字<|endoftext|>#Ωж　😀́" + "".join(map(chr, range(1, 256)))
    texts = [t if t is None or len(t) < 10_000 else t[:3000] + t[-300:] for t in ODD]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) + rng.choice(["", "  ", " \n", "'re", "the the"]) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(None, "x y", "z")] * 2, "doc_id long, text string, ids string")
    got = B.encode_and_decode(df, PATH, most).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "x y" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids), text
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_no_rows_and_no_python(spark):
    df = spark.range(0).selectExpr("id AS doc_id", "'x' AS text")
    made = B.with_ids(df, PATH)
    nodes = re.findall(r"(?m)^[\s:+*()\d-]*(\w+)", made._jdf.queryExecution().executedPlan().treeString())
    assert made.count() == 0 and nodes and not [n for n in nodes if "Python" in n or "Arrow" in n or "Pandas" in n]


def test_frequent_words_are_folded_by_tasks(spark, library, monkeypatch):
    """The driver sorts and folds none of them, and gets no more than asked; the literal of ranks stands in a plan once."""
    ranks, plans = B.Lookup(B.read_ranks(PATH), "int"), []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    texts = [" ".join(f"word{chr(97 + i)}" for i in range(20) for _ in range(i + 1)), None, "wordt " * 50]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = B.frequent(docs, ranks, 8)
    assert 0 < len(got) <= 8 and " wordt" in got and all(ids == library.encode_ordinary(word) for word, ids in got.items())
    assert plans and not [p for p in plans if "TakeOrdered" in p] and all(p.count(" Python") <= 3 for p in plans)
    assert B.frequent(docs, ranks, 0) == {} and B.frequent(docs.limit(0), ranks, 8) == {}


def test_values_are_bound_without_asking_for_types(spark):
    """An element of a transformed array asks for its type, through all that is nested in it, on every row."""
    ranks = B.Lookup({chr(i): i for i in range(256)} | {"bc": 256, "ab": 257}, "int")
    df = spark.createDataFrame([("abc",), ("ab",)], "text string")
    got = df.select("text", ranks.once("array<int>", lambda r: B.fold(B.as_bytes(F.col("text")), r)).alias("ids"))
    assert "transform(array(" not in got._jdf.queryExecution().analyzed().toString()
    assert {r["text"]: r["ids"] for r in got.collect()} == {"abc": [97, 256], "ab": [257]}
