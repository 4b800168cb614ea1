import random

import pytest
from pyspark.sql import functions as F

from querymill.llm import components as C, jaccard_join as J
from querymill.session import Scratch
from tests.llm.helpers import ODD, components, multiset, shingles


def run(spark, rows, rule):
    with Scratch(spark) as scratch:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return multiset(J.classes(scratch, df, rule).select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, words, share):
    return [w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words]


def corpus(seed):
    """Groups of near copies with chains, a passage that many texts share, and unrelated texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for _ in range(8):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 7, 12, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            rows.append(" ".join(base))
            base = edited(rng, base, 0.03)
    for _ in range(25):
        text = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        rows.append(" ".join(text[:20] + passage + text[20:]))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "rule"), [(1, J.Rule(4, 85)), (2, J.Rule(5, 80)), (3, J.Rule(2, 60, 2))])
def test_equals_comparing_all_pairs(spark, seed, rule):
    rows = corpus(seed)
    assert run(spark, rows, rule) == multiset(components(rows, rule.words, rule.percent))


def test_no_link_across_components_is_lost_in_mixed_buckets(spark):
    """Every text shares its first words, so the leader's bucket holds several components that later comparisons must join."""
    head = [f"h{i}" for i in range(20)]
    rows = [(i, " ".join(head[: 20 - i] + [f"t{j}" for j in range(i)] + [f"u{i // 2}"])) for i in range(16)]
    rule = J.Rule(1, 75, 3)
    assert run(spark, rows, rule) == multiset(components(rows, 1, 75))


def link_counts(rows, n, percent):
    """(doc_id, number of other sets that its set links with), all pairs compared."""
    sets = [shingles(t, n) for _, t in rows]

    def linked(a, b):
        both = len(a & b)
        return a != b and both and 100 * both >= percent * (len(a) + len(b) - both)

    return multiset((d, sum(bool(linked(s, other)) for other in set(sets))) for (d, _), s in zip(rows, sets))


@pytest.mark.parametrize(("seed", "rule"), [(1, J.Rule(4, 85)), (3, J.Rule(2, 60, 2))])
def test_every_link_is_counted(spark, seed, rule):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    near = [" ".join(edited(rng, base, rng.choice([0.003, 0.01, 0.02]))) for _ in range(60)]  # one bucket holds far more than its leaders
    rows = corpus(seed) + list(enumerate([*near, near[0], *ODD[:6]], 1000))
    want = link_counts(rows, rule.words, rule.percent)
    assert max(n for _, n in want) > 10
    with Scratch(spark) as scratch:
        got = J.classes(scratch, spark.createDataFrame(rows, "doc_id long, text string"), rule, count_links=True).collect()
    assert multiset((r["doc_id"], r["n_links"]) for r in got) == want
    assert multiset((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == multiset(components(rows, rule.words, rule.percent))


def test_components_alone_do_not_need_all_pairs_of_a_group(spark, monkeypatch):
    rng, compared, plain = random.Random(9), [], J._compare
    base = [f"b{i}" for i in range(150)]
    rows = list(enumerate({" ".join(edited(rng, base, 0.01)) for _ in range(300)}))
    monkeypatch.setattr(J, "_compare", lambda scratch, pairs, *rest: compared.append(pairs.count()) or plain(scratch, pairs, *rest))
    monkeypatch.setattr(J, "_within", None)
    assert run(spark, rows, J.Rule(4, 85)) == multiset(components(rows, 4, 85))
    assert len(rows) > 150 and sum(compared) < len(rows) * (len(rows) - 1) / 2 / 4


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "one two three four five six"), (None, None), (50, "One two THREE four five six"), (50, "one two three four five six"), (3, "other text"), (3, "other text")]
    rule = J.Rule(4, 85)
    assert run(spark, rows, rule) == multiset(components(rows, 4, 85))
    assert run(spark, [(None, "a b c d e"), (None, "a b c d e")], rule) == multiset([(None, 2, None)] * 2)
    assert not run(spark, [], rule)


def test_one_of_each(spark):
    rows = [(5, "a b c d e f", "x"), (2, "A b c d e f", "y"), (9, "a b c d e f", "z"), (7, None, "n"), (8, "", "e"), (2, "A b c d e f", "y"), (None, "q r s t u v", "k"), (None, "q r s t u v", "k")]
    with Scratch(spark) as scratch:
        df = spark.createDataFrame(rows, "doc_id long, text string, `token.v` string")
        got = J.one_of_each(scratch, df)
        assert got.columns == df.columns
        assert multiset(got.collect()) == multiset([rows[1], rows[3], rows[4], rows[6]])


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {}
    for a, b in links:
        if a is not None and a != b:
            group = {a, b} | {x for x in root if root[x] in (root.get(a), root.get(b))}
            for x in group:
                root[x] = min(group)
    for _ in range(60):
        for a, b in links:
            if a in root and b in root:
                low = min(root[a], root[b])
                for x in [y for y in root if root[y] in (root[a], root[b])]:
                    root[x] = low
    with Scratch(spark) as scratch:
        got = C.components(scratch, spark.createDataFrame(links, "a long, b long")).collect()
        assert {r["node"]: r["root"] for r in got} == root and len(got) == len(root)
        assert not C.components(scratch, spark.createDataFrame([], "a long, b long")).collect()


def test_scratch_tables_are_removed(spark, tmp_path):
    import os

    with Scratch(spark) as scratch:
        assert scratch.cut(spark.range(5)).count() == 5
        assert os.path.isdir(scratch.root)
    assert not os.path.exists(scratch.root)
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_rows_alone_with_their_token_are_not_shuffled_again(spark, monkeypatch):
    """Of 400 different texts and three that are alike, few rows of the first order's buckets reach the joins; equal texts bring one of each."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(60)) for _ in range(400)]
    near = " ".join(f"w{i}" for i in range(60))
    texts += [near, near, near + " more"]
    sifted, perhaps = [], J._perhaps

    def seen(rows, column, bits):
        out = perhaps(rows, column, bits).cache()
        sifted.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(J, "_perhaps", seen)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.classes(Scratch(spark), docs, J.Rule(4, 85)).collect()}
    assert got == {i: min(i, 400) for i in range(403)}
    ((every, kept),) = sifted
    assert every > 3000 and 0 < kept < every / 10


def test_settled_buckets_go_no_further(spark, monkeypatch):
    """Buckets of up to three members are settled by their leaders; of the others, those in which one component meets leave."""
    across, members = J._across, []
    monkeypatch.setattr(J, "_across", lambda scratch, met, *rest: members.append(met.count()) or across(scratch, met, *rest))
    few = [(i, "all of these share this start " + " ".join(f"w{i}x{j}" for j in range(3 if i < 2 else 40))) for i in range(3)]
    many = [(i, " ".join(f"u{j}" for j in range(60)) + f" end{i}") for i in range(10, 40)]
    rows = few + many
    with Scratch(spark) as scratch:
        got = J.classes(scratch, spark.createDataFrame(rows, "doc_id long, text string"), J.Rule(words=4, percent=85)).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(components(rows, 4, 85))
    assert members[0] > 0 and members[0] % len(many) == 0 and members[1:] == [0, 0]
