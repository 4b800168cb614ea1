"""Similarity join and judged matches against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querymill.functions import vectors as V
from querymill.operators.matching import judged_matches
from querymill.operators import similarity as S
from querymill.operators.similarity import similarity_approximate, similarity_join
from querymill.plans import sequential as Q
from querymill.plans.sequential import resolve_sequential, resolve_sequential_judged


def clustered(n, dim, seed, copies=0):
    """Vectors around a few directions, the last ``copies`` all the same."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = centres[rng.integers(6, size=n)] + 0.5 * rng.normal(size=(n, dim))
    if copies:
        rows[-copies:] = rows[0]
    return rows.astype(np.float32)


def brute(queries, store, k, threshold, metric="cosine", score="reference"):
    """{query: [keys best first]} and the scores, from plain loops."""
    found = {}
    for i, q in enumerate(queries):
        hits = []
        for j, s in enumerate(store):
            a, b = q.astype(float), s.astype(float)
            d = 1 - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) if metric == "cosine" else ((a - b) ** 2).sum()
            v = max(0.0, 1 - d * d / 2) if score == "reference" else 1 - d
            if v >= threshold:
                hits.append((-round(v, 9), j))
        if hits:
            found[i] = [(j, -v) for v, j in sorted(hits)[:k]]
    return found


def frames(spark, queries, store):
    def frame(name, vectors):
        return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{name} long, embedding array<float>")

    return frame("query_id", queries), frame("key", store)


def collected(joined):
    rows = {}
    for r in joined.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append((r["key"], pytest.approx(r["score"], abs=1e-9)))
    return rows


@pytest.mark.parametrize(
    ("threshold", "metric", "score", "block_rows", "cells"),
    [
        (0.85, "cosine", "reference", 10_000, 256), (0.85, "cosine", "reference", 40, 256), (0.9, "cosine", "cosine", 32, 5),
        (0.5, "sql2", "reference", 25, 8), (0.0, "cosine", "reference", 60, 3), (0.85, "cosine", "reference", 130, 256),
    ],
)
def test_join_equals_brute_force(spark, threshold, metric, score, block_rows, cells):
    queries, store = clustered(140, 8, 1, copies=40), clustered(120, 8, 1, copies=40)
    queries[3] = 0
    if metric == "sql2":
        queries, store = queries / 4, store / 4
    q, s = frames(spark, queries, store)
    got = collected(
        similarity_join(
            q, s, store_key="key", threshold=threshold, metric=metric, score=score, k=3,
            block_rows=block_rows, max_cells=cells,
        )
    )
    queries[3] = 1  # any vector: the zero vector is to match nothing
    want = brute(queries, store, 3, threshold, metric, score)
    want.pop(3, None)
    assert got == want


@pytest.mark.parametrize(("n_query", "n_store", "cells"), [(300, 300, 1), (300, 300, 5), (40, 500, 1), (500, 40, 1)])
def test_a_vector_is_sent_along_one_row_of_the_grid(spark, monkeypatch, n_query, n_store, cells):
    """Not to every block of the other side, and the result stays the same."""
    grids = []

    class Watched(S._Grid):
        def sent(self):
            grids.append(self)
            return super().sent()

    monkeypatch.setattr(S, "_Grid", Watched)
    monkeypatch.setattr(S, "MANY_PAIRS", n_query * n_store // 16)
    monkeypatch.setattr(S, "HELD_BLOCKS", 1000 if cells == 1 else 4)
    rng = np.random.default_rng(4)
    queries, store = (rng.normal(size=(n, 6)).astype(np.float32) for n in (n_query, n_store))
    q, s = frames(spark, queries, store)
    got = collected(similarity_join(q, s, store_key="key", threshold=0.9, k=3, block_rows=n_store // cells))
    assert got == brute(queries, store, 3, 0.9)
    (grid,) = grids
    tasks = grid.rows * grid.columns
    assert tasks >= 16 and grid.sent().count() <= (n_query + n_store) * 2 * np.sqrt(tasks)


def test_vectors_of_far_cells_are_not_sent(spark):
    rng = np.random.default_rng(5)
    store = np.eye(8)[rng.integers(8, size=400)] + 0.01 * rng.normal(size=(400, 8))
    q, s = frames(spark, store[:200].astype(np.float32), store.astype(np.float32))
    sides = S._sides(q, s, "query_id", "key", "embedding", "embedding", None, None, 3, None)
    centres = np.eye(8)
    query, stored = (S._assign(df, centres, "cosine").drop("radius") for df in (sides.query, sides.store))
    counts = {(side, r["cell"]): r["count"] for side, df in (("q", query), ("s", stored)) for r in df.groupBy("cell").count().collect()}
    near, S_FEW = np.eye(8, dtype=bool), S.FEW_PAIRS
    try:
        S.FEW_PAIRS = 1000
        all_, few = (S._Grid(query, stored, counts, n, 10).sent().count() for n in (near | True, near))
    finally:
        S.FEW_PAIRS = S_FEW
    assert few * 3 < all_


@pytest.mark.parametrize("n", [100_000, 600_000])
def test_small_blocks_do_not_copy_vectors_without_end(spark, n):
    nothing = spark.createDataFrame([], "cell int")
    grid = S._Grid(nothing, nothing, {("q", 0): n, ("s", 0): n}, np.ones((1, 1), dtype=bool), 100)
    # A group of queries fits a task, and each vector goes to a task for every so many of them.
    assert n / grid.rows <= S.HELD_ROWS and max(grid.rows, grid.columns) <= max(S.BLOCK_GROUPS, np.ceil(n / S.HELD_ROWS))


def test_a_probing_query_is_sent_once_to_a_task(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    q, s = frames(spark, vectors, vectors)
    sides = S._sides(q, s, "query_id", "key", "embedding", "embedding", None, None, 3, None)
    stored = S._assign(sides.store, np.eye(8), "cosine").drop("radius")
    query = S._probed(sides.query, np.eye(8), "cosine", 6)
    counts = {("s", r["cell"]): r["count"] for r in stored.groupBy("cell").count().collect()}
    grid = S._Grid(query, stored, counts | {("q", 0): 300}, np.eye(8, dtype=bool), 1000)
    assert grid.sent().where("side = 0").count() <= 300 * grid.columns


def test_a_task_keeps_few_matches_of_many():
    """All of 4,000 queries match all of 4,000 stored vectors."""
    import tracemalloc

    n, k = 4000, 3
    rng = np.random.default_rng(7)
    vec = pa.array(list((1 + 0.01 * rng.normal(size=(n, 4))).astype(np.float64)), pa.list_(pa.float64()))
    numbers, cells = pa.array(np.arange(n)), pa.array([[0]] * n, pa.list_(pa.int32()))
    asked = pa.RecordBatch.from_arrays([numbers, numbers, cells, pa.array(np.full(n, 1)), vec], names=["_v1", "_v2", "cells", "seq", "vec"])
    stored = pa.RecordBatch.from_arrays([cells, pa.array(np.full(n, 0)), numbers, vec], names=["cells", "seq", "s_key", "vec"])
    held = S._Held([asked], np.ones((1, 1), dtype=bool), "cosine", "reference", 0.85, k)
    tracemalloc.start()
    held.take(stored)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(b) for b in held.found(pa.int64())) == n * k and peak < 100e6


def recall(approximate, exact):
    pairs = {(q, key) for q, found in exact.items() for key, _ in found}
    return len(pairs & {(q, key) for q, found in approximate.items() for key, _ in found}) / len(pairs)


def test_approximate_join_finds_most(spark):
    from workloads.similarity import means, stored

    q = means(spark, "/root/testdata/sf0.01")
    s = stored(spark, "/root/testdata/sf0.01").withColumnRenamed("store_id", "key")
    exact, near = (collected(join(q, s, store_key="key")) for join in (similarity_join, similarity_approximate))
    assert recall(near, exact) >= 0.9
    # What it finds has its exact score, and all cells together give the exact result.
    assert {k for found in near.values() for k, _ in found} and all(
        dict(exact[i])[k] == v for i, found in near.items() for k, v in ((k, v.expected) for k, v in found) if k in dict(exact[i])
    )
    assert collected(similarity_approximate(q, s, store_key="key", cells=7, probes=7)) == exact


def test_approximate_join_of_few_or_no_vectors(spark):
    q, s = frames(spark, clustered(5, 4, 1, copies=3), clustered(4, 4, 1, copies=2))
    assert collected(similarity_approximate(q, s, store_key="key", probes=9)) == collected(similarity_join(q, s, store_key="key"))
    assert not collected(similarity_approximate(q, s.limit(0), store_key="key")) and not collected(similarity_approximate(q.limit(0), s, store_key="key"))


def test_edge_vectors(spark):
    query = [1.0, 0.0]
    store = [[1, 0], [0.9, np.sqrt(1 - 0.81)], [0.4524, np.sqrt(1 - 0.4524**2)], [0.4522, np.sqrt(1 - 0.4522**2)], [0, 1], [-1, 0], [0, 0], [], None, [1, 0, 0], [float("nan"), 1]]
    s = spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(store)], "key int, embedding array<float>")
    q = spark.createDataFrame([(1, query), (2, []), (3, None), (4, [0.0, 0.0])], "query_id int, embedding array<float>")
    got = similarity_join(q, s, store_key="key", k=20, dim=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["key"]) for r in got] == [(1, 0), (1, 1), (1, 2)]
    wide = similarity_join(q, s, store_key="key", k=20, dim=2, threshold=0.0).collect()
    assert {r["key"] for r in wide} == {0, 1, 2, 3, 4, 5}


def test_vector_columns(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    got = row.select(
        V.cosine_distance(F.col("a"), F.col("b")), V.squared_l2_distance(F.col("a"), F.col("b")),
        V.distance_to_score(F.lit(0.5)), V.distance_to_score(F.lit(2.0)), V.clamp_confidence(F.lit(1.2)),
    ).first()
    assert got[0] == pytest.approx(0.04) and tuple(got)[1:] == (2.0, 0.875, 0.0, 1.0)


def test_no_join_without_a_key(spark):
    q, s = frames(spark, clustered(30, 8, 1), clustered(30, 8, 2))
    for block in (1000, 7):
        joined = similarity_join(q, s, store_key="key", block_rows=block)
        plan = joined._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def candidates(spark):
    rows = [(1, "q one", r, 1 - r / 100, f"k{r}", f"stored {r}") for r in range(1, 6)] + [(2, "q two", 1, 0.9, "k9", "bad")]
    return spark.createDataFrame(rows, "query_id int, query string, rank int, score double, query_hash string, stored_query string")


def test_judge_takes_first_accepted(spark, tmp_path):
    log = tmp_path / "calls"

    def judge(asked, stored):
        with log.open("a") as out:
            out.writelines(f"{s}\n" for s in stored)
        if (stored == "bad").any():
            raise ValueError("no answer")
        return ['{"is_similar": %s, "confidence": %s}' % ("true", 0.9 if s in ("stored 3", "stored 5") else 0.7) for s in stored]

    got = judged_matches(candidates(spark), judge).collect()
    assert [(r["query_id"], r["query_hash"], r["semantic_similarity"]) for r in got] == [(1, "k3", 0.9)]
    assert "stored 4" not in log.read_text()
    many = judged_matches(candidates(spark), judge, limit=2).orderBy("rank").collect()
    assert [r["query_hash"] for r in many] == ["k3", "k5"]


def test_no_judge_takes_top(spark):
    got = judged_matches(candidates(spark), None).orderBy("query_id").collect()
    assert [(r["query_id"], r["query_hash"]) for r in got] == [(1, "k1"), (2, "k9")]


def loop(queries, store, threshold):
    """The same by asking one query after another."""
    saved, out = list(store), {}
    for qid, key, vec in queries:
        hit = next((k for k, _ in saved if k == key), None)
        if hit is not None:
            out[qid] = ("exact_hit", key)
            continue
        best = None
        for pos, (k, v) in enumerate(saved):
            a, b = np.asarray(vec, float), np.asarray(v, float)
            d = 1 - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
            value = max(0.0, 1 - d * d / 2)
            rank = (-round(value, 9), pos if pos >= len(store) else -1, k)
            if value >= threshold and (best is None or rank < best[0]):
                best = (rank, k)
        if best:
            out[qid] = ("similar_hit", best[1])
        else:
            out[qid] = ("miss", None)
            saved.append((key, vec))
    return out


@pytest.mark.parametrize(("seed", "block_rows"), [(3, 1000), (4, 15)])
def test_sequential_equals_loop(spark, seed, block_rows):
    rng = np.random.default_rng(seed)
    vectors = clustered(40, 3, seed, copies=8)
    keys = [f"h{k}" for k in rng.integers(25, size=40)]
    store = [(f"s{j}", v) for j, v in enumerate(clustered(3, 3, seed + 10))] + [("h1", clustered(1, 3, 99)[0])]
    rows = [(i, keys[i], vectors[i]) for i in range(40)]
    q = spark.createDataFrame(
        [(i, i, k, [float(x) for x in v]) for i, k, v in rows], "query_id int, arrival int, query_hash string, embedding array<float>"
    )
    s = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in store], "query_hash string, embedding array<float>")
    got = {
        r["query_id"]: (r["outcome"], r["matched_hash"])
        for r in resolve_sequential(q, s, threshold=0.97, block_rows=block_rows).collect()
    }
    assert got == loop(rows, store, 0.97)


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_chain_ends_in_few_rounds(spark, monkeypatch, shuffled):
    """1,000 queries, each like the one before only; and chains that meet where the order is another."""
    n, rounds = 1000, []
    plain = Q._leaders
    monkeypatch.setattr(Q, "_leaders", lambda *a: rounds.append(1) or plain(*a))
    angle = np.arange(n) * (1.8 * np.pi / n)
    arrival = np.random.default_rng(6).permutation(n) if shuffled else np.arange(n)
    q = spark.createDataFrame([(i, int(arrival[i]), f"h{i}", [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)], "query_id int, arrival int, query_hash string, embedding array<double>")
    s = spark.createDataFrame([], "query_hash string, embedding array<double>")
    step = 1.8 * np.pi / n
    got = {r["query_id"]: r["outcome"] for r in resolve_sequential(q, s, threshold=float(np.cos(1.5 * step)), score="cosine").collect()}
    misses = set()
    for i in np.argsort(arrival):
        if not misses & {i - 1, i + 1}:
            misses.add(int(i))
    assert {i for i, o in got.items() if o == "miss"} == misses and set(got.values()) == {"miss", "similar_hit"}
    assert len(rounds) <= 30


def judged_loop(queries, store, threshold, accepts, k):
    """Asking one query after another, with a judge that walks the k best rows."""
    saved, out = [(key, text, vec, -1) for key, text, vec in store], {}
    for qid, key, text, vec in queries:
        if any(key == other for other, *_ in saved):
            out[qid] = ("exact_hit", key)
            continue
        near = []
        for other, stored, v, seq in saved:
            a, b = np.asarray(vec, float), np.asarray(v, float)
            d = 1 - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
            value = max(0.0, 1 - d * d / 2)
            if value >= threshold:
                near.append((-round(value, 9), seq, other, stored))
        hit = next((other for _, _, other, stored in sorted(near)[:k] if accepts(text, stored)), None)
        out[qid] = ("similar_hit", hit) if hit else ("miss", None)
        if not hit:
            saved.append((key, text, vec, qid))
    return out


def test_judged_sequence_equals_loop(spark, tmp_path):
    """Twenty random inputs at once, each in dimensions of its own, so that none is near another."""
    inputs, dim, log = 20, 3, tmp_path / "calls"

    def accepts(a, b):
        return (len(a) + len(b)) % 3 == 0

    def judge(asked, stored):
        with log.open("a") as out:
            out.writelines(f"{a}|{b}\n" for a, b in zip(asked, stored))
        return ['{"is_similar": %s, "confidence": 0.9}' % str((len(a) + len(b)) % 3 == 0).lower() for a, b in zip(asked, stored)]

    rows, store, want = [], [], {}
    for seed in range(inputs):
        rng = np.random.default_rng(seed)

        def placed(v):
            return [0.0] * (dim * seed) + [float(x) for x in v] + [0.0] * (dim * (inputs - 1 - seed))

        n = 30
        vectors, forms = clustered(n, dim, seed, copies=int(rng.integers(10))), rng.integers(18, size=n)
        mine = []
        for i in range(n):
            # A hash may come with several texts and vectors, as a text asked again in other case does.
            same = forms[i] % 3 == 0
            text = f"{seed} " + "x" * int(forms[i] if same else rng.integers(6))
            mine.append((1000 * seed + i, f"{seed}-h{forms[i]}", text, placed(vectors[forms[i]] if same else vectors[i])))
        kept = [(f"{seed}-s{j}", f"{seed} stored " + "y" * j, placed(v)) for j, v in enumerate(clustered(4, dim, seed))] + [(f"{seed}-h1", f"{seed} held", placed(vectors[1]))]
        want |= judged_loop(mine, kept, 0.9, accepts, 3)
        rows, store = rows + mine, store + kept
    q = spark.createDataFrame([(i, i, h, t, v) for i, h, t, v in rows], "query_id int, arrival int, query_hash string, query string, embedding array<double>")
    s = spark.createDataFrame(store, "query_hash string, query string, embedding array<double>")
    got = {r["query_id"]: (r["outcome"], r["matched_hash"]) for r in resolve_sequential_judged(q, s, judge, threshold=0.9, k=3).collect()}
    assert got == want and {o for o, _ in want.values()} == {"exact_hit", "similar_hit", "miss"}
    asked = log.read_text().split("\n")[:-1]
    assert len(asked) == len(set(asked))


def test_judged_lists_are_written_without_their_texts(spark, monkeypatch):
    written, plain = [], Q.cut
    monkeypatch.setattr(Q, "cut", lambda df: written.append(df.columns) or plain(df))
    schema = "query_id int, arrival int, query_hash string, query string, embedding array<double>"
    q = spark.createDataFrame([(i, i, f"h{i}", None if i == 3 else "a" * (i + 1), [1.0, i / 100]) for i in range(6)], schema)
    s = spark.createDataFrame([("s", "aaaa", [1.0, 0.0])], "query_hash string, query string, embedding array<double>")
    judge = lambda asked, stored: ['{"is_similar": %s, "confidence": 0.9}' % str(len(a) == len(b or "")).lower() for a, b in zip(asked, stored)]
    got = {r["query_id"]: r["outcome"] for r in resolve_sequential_judged(q, s, judge, threshold=0.9, k=9).collect()}
    assert got == {0: "miss", 1: "miss", 2: "miss", 3: "miss", 4: "miss", 5: "miss"}
    lists = [columns for columns in written if "rank" in columns or "accepted" in columns]
    assert lists and not any({"query", "entry_query"} & set(columns) for columns in lists)


def test_judged_queries_let_in_by_parts_equal_the_loop(spark, tmp_path, monkeypatch):
    """Some seventy queries at once, of six hundred."""
    rounds, plain = [], Q._settled
    monkeypatch.setattr(Q, "LET_IN", 70)
    monkeypatch.setattr(Q, "_settled", lambda undecided, *a: rounds.append(undecided.count()) or plain(undecided, *a))
    test_judged_sequence_equals_loop(spark, tmp_path)
    assert len(rounds) > 5 and max(rounds) <= 100


def test_a_judged_chain_ends_in_few_rounds(spark, monkeypatch):
    """Queries each like the one before only, which the judge accepts: every second one is saved."""
    n, rounds, plain = 14, [], Q._settled
    monkeypatch.setattr(Q, "_settled", lambda *a: rounds.append(1) or plain(*a))
    step = np.pi / n
    rows = [(i, i, f"h{i}", f"q{i}", [float(np.cos(i * step)), float(np.sin(i * step))]) for i in range(n)]
    q = spark.createDataFrame(rows, "query_id int, arrival int, query_hash string, query string, embedding array<double>")
    s = spark.createDataFrame([], "query_hash string, query string, embedding array<double>")
    judge = lambda asked, stored: ['{"is_similar": true, "confidence": 0.9}'] * len(asked)
    got = {r["query_id"]: (r["outcome"], r["matched_hash"]) for r in resolve_sequential_judged(q, s, judge, threshold=float(np.cos(1.5 * step)), score="cosine", k=3).collect()}
    assert got == {i: ("similar_hit", f"h{i - 1}") if i % 2 else ("miss", None) for i in range(n)}
    assert len(rounds) <= 2


def test_stored_vectors_that_come_later_are_not_multiplied(monkeypatch):
    n, dim, pairs, plain = 4096, 4, [], S._Held._product
    monkeypatch.setattr(S._Held, "_product", lambda self, ours, theirs, *a: pairs.append(len(ours) * len(theirs)) or plain(self, ours, theirs, *a))
    vec = pa.array(list(np.random.default_rng(8).normal(size=(n, dim))), pa.list_(pa.float64()))
    numbers, cells = pa.array(np.arange(n)), pa.array([[0]] * n, pa.list_(pa.int32()))
    held = S._Held([pa.RecordBatch.from_arrays([numbers, numbers, cells, numbers, vec], names=["_v1", "_v2", "cells", "seq", "vec"])], np.ones((1, 1), dtype=bool), "cosine", "reference", 0.99, 3)
    for low in range(0, n, 256):
        held.take(pa.RecordBatch.from_arrays([x.slice(low, 256) for x in (cells, numbers, numbers, vec)], names=["cells", "seq", "s_key", "vec"]))
    assert sum(pairs) < 0.6 * n * n
    unit = S._unit(np.array(vec.to_pylist()), "cosine")
    close = np.tril(np.maximum(0, 1 - (1 - unit @ unit.T) ** 2 / 2) >= 0.99, -1).sum(axis=1)
    assert sum(len(b) for b in held.found(pa.int64())) == np.minimum(close, 3).sum()
