"""Hooks: failures stay with their row, nothing is asked twice, the default embedding is stable."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from querymill.plans.resolve import embed
from querymill.providers import EMBEDDING_DIM, embed_hook, hashed_ngrams, text_hook


def test_failures_stay_with_their_row(spark):
    def hook(texts):
        if (texts == "bad").any():
            raise ValueError("bad text")
        return texts.str.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "b")], "i int, t string").coalesce(1)
    got = [tuple(r[0]) for r in df.orderBy("i").select(text_hook(hook)(F.col("t"))).collect()]
    assert got == [("A", None), (None, "bad text"), (None, None), ("B", None)]


def test_a_wrong_number_of_replies_is_a_failed_call(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "i int, t string").coalesce(1)
    for count in (1, 2, 4):
        def hook(texts, count=count):
            return [f"reply {t}" for t in texts] if len(texts) == 1 else ["lost"] * count

        got = [tuple(r[0]) for r in df.orderBy("i").select(text_hook(hook)(F.col("t"))).collect()]
        # Halves of two fail too, unless the count happens to be theirs.
        assert got[0] == ("reply t0", None) and (count == 2 or got[1:] == [("reply t1", None), ("reply t2", None)])


def test_failed_embedding_is_empty(spark):
    def hook(texts):
        if (texts == "bad").any():
            raise ValueError
        return [[1.0, 2.0]] * len(texts)

    df = spark.createDataFrame([(1, "a"), (2, "bad")], "i int, t string").coalesce(1)
    assert [r[0] for r in df.orderBy("i").select(embed_hook(hook)(F.col("t"))).collect()] == [[1.0, 2.0], []]


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "log"

    def hook(texts):
        with log.open("a") as out:
            out.writelines(f"{t}\n" for t in texts)
        return [[1.0]] * len(texts)

    df = spark.createDataFrame([(i, "hot" if i % 3 else f"cold {i}") for i in range(60)], "i int, query string")
    assert embed(df, hook).count() == 60
    embed(df, hook).write.format("noop").mode("overwrite").save()
    assert log.read_text().splitlines().count("hot") <= 2


def test_default_embedding():
    vectors = hashed_ngrams(pd.Series(["best places to visit", "Best places to VISIT", "docker resources", "", "😀"]))
    assert all(len(v) == EMBEDDING_DIM for v in vectors)
    assert np.allclose(vectors[0], vectors[1]) and abs(np.linalg.norm(vectors[0]) - 1) < 1e-6
    assert vectors[0] @ vectors[2] < 0.5
    near, far = hashed_ngrams(pd.Series(["best places to visit in spring", "how to cook pasta"]))
    assert vectors[0] @ near > vectors[0] @ far
