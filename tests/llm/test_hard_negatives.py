import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.llm import hard_negatives as H
from querymill.session import Scratch

NAN, INF = float("nan"), float("inf")


def brute_force(rows, is_anchor, rule=H.Mining()):
    rows = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(i, [math.floor(rule.scale * x) for x in v], label) for i, v, label in rows]
    out = Counter()
    for a, v, label in {(i, tuple(v), label) for i, v, label in whole if is_anchor(i)}:
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, w, other in whole)
        positives = [(i, -s) for s, i, other in scored if other == label and i != a][:rule.positives]
        for p, score in positives:
            fits = [(i, -s) for s, i, other in scored if other != label and rule.low * score <= -100 * s <= rule.high * score]
            out.update((a, p, n, i, score, s) for n, (i, s) in enumerate(fits[:rule.negatives], 1))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def random_rows(seed, n, dim, labels=3, coarse=2):
    """Few different components, so that many scores are equal."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-coarse, coarse + 3) / 4 for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def mined(spark, rows, **options):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in H.mine(Scratch(spark), frame(spark, rows), **options).select(*columns).collect())


@pytest.mark.parametrize("held,share", [(H.HELD, H.SHARE), (2, 40)])
def test_all_pairs_compared(spark, monkeypatch, held, share):
    """With ties, negative scores, and a grid of several groups and shares."""
    monkeypatch.setattr(H, "HELD", held)
    monkeypatch.setattr(H, "SHARE", share)
    monkeypatch.setattr(H, "TILE", 32)
    rows = random_rows(1, 300, 5)
    got = mined(spark, rows, anchors="vec_id % 30 = 0")
    assert got == brute_force(rows, lambda i: i % 30 == 0) and len(got) > 200


def test_odd_rows(spark):
    rows = random_rows(2, 60, 4) + [
        (None, [1.0, 1.0, 1.0, 1.0], 1), (100, None, 1), (200, [1.0, 1.0], None), (300, [1.0, None, 1.0, 1.0], 1), (400, [NAN] * 4, 1), (500, [INF, 0.0, 0.0, 0.0], 1),
        (600, [], 1), (700, [1.0], 1), (800, [1.0, 1.0, 1.0, 1.0, 5.0, 6.0], 1), (7, [2.0, 1.0, 0.5, 0.5], 2), (7, [2.0, 1.0, 0.5, 0.5], 2), (0, [1.0, 1.0, 1.0, 1.0], 0), (0, [1.0, 1.0, 1.0, 1.0], 0),
    ]
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 100 == 0)
    assert not mined(spark, rows[:0]) and not mined(spark, [r for r in rows[:60] if r[0] % 100])


def test_one_vector_and_one_label_may_hold_most_rows(spark):
    rows = [(i, [0.5, 0.25, 0.75], 1 if i % 3 else 2) for i in range(400)] + random_rows(3, 30, 3)
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 100 == 0)


def test_clashing_columns_and_other_types(spark):
    rows = random_rows(4, 120, 4)
    df = frame(spark, rows).withColumns({c: F.lit("own") for c in ("anchor", "scores", "side", "cell", "rank", "vec", "share", "group")}).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert Counter(tuple(r) for r in H.mine(Scratch(spark), df).collect()) == brute_force(rows, lambda i: i % 100 == 0)


def test_products_are_exact_and_take_as_many_primes_as_they_need():
    rng = np.random.default_rng(5)
    for size, dim in ((3, 4), (300, 64), (70_000, 2500), (10**6, 7)):
        a, b = rng.integers(-size, size + 1, (9, dim)), rng.integers(-size, size + 1, (11, dim))
        a[0], b[0], b[1] = size, size, -size
        system = H.Residues(dim * size * size)
        assert math.prod(system.primes) > 2 * dim * size * size >= math.prod(system.primes[:-1])
        assert (system.products(system.of(a.astype(float)), system.of(b.astype(float))) == a @ b.T).all()
    with pytest.raises(StopIteration):
        next(p for p in H.PRIMES if any(p % q == 0 for q in range(2, p)))


def test_scores_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_a_task_sends_no_more_than_its_anchors_ask_for(spark):
    df = frame(spark, random_rows(6, 400, 4)).withColumnRenamed("embedding", "vec")
    anchors = df.where("vec_id % 100 = 0").withColumn("anchor", F.col("vec_id")).withColumn("scores", F.lit(None).cast("array<long>"))
    sent = H._best(anchors, df, (2, 3), H.Residues(10**6), 4, H.Mining())
    assert sent.count() <= 4 * 3 * H.Mining().positives
