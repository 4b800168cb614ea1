import numpy as np

from querymill.llm import quality_rules as Q
from querymill.session import Scratch
from tests.llm.helpers import LONG, ODD, multiset, statistics

SF = "/root/testdata/sf0.1"


def test_statistics(spark):
    texts = [*ODD, "a b c d e f g h " * 3, "x\nx\n \n \ny\nx ", "a b c d e f g h i\na b c d e f g h i\n#|<", LONG + "\n" + LONG]
    texts += [r["text"] for r in spark.read.parquet(f"{SF.replace('0.1', '0.001')}/documents.parquet").collect()]
    got = Q.with_statistics(spark.createDataFrame([(t, 7) for t in texts], "text string, n_words int")).collect()
    assert [tuple(r[1:]) for r in got] == [statistics(t) for t in texts] and got[0].__fields__ == ["text", *Q.STATS]


def vector(n, chars, symbols, lines, repeated):
    n = max(n, 1)
    return [np.log(n), np.log(max(chars, 1) / n), np.sqrt(symbols / n), np.log1p(lines), np.sqrt(repeated / n)]


def plain_estimate(x):
    """The same concentration steps on one group held in memory."""
    least = np.square(Q.LEAST_SPREAD)

    def median(v):
        return np.sort(v)[(len(v) - 1) // 2]

    centre = np.array([median(np.floor(x[:, i] * 100 + 0.5) / 100) for i in range(5)])
    spread = np.array([median(np.floor(np.abs(x[:, i] - centre[i]) * 100 + 0.5) / 100) for i in range(5)])
    precision = np.diag(1 / (np.square(spread * 1.4826) + least))
    for step in range(Q.STEPS + 1):
        away = x - centre
        d = np.einsum("ij,jk,ik->i", away, precision, away)
        bins = np.floor(np.log2(np.maximum(d, 2.0 ** -20)) * Q.BINS)
        share = Q.CORE if step < Q.STEPS else 0.5
        ordered = np.sort(bins)
        last = ordered[int(np.ceil(len(x) * share)) - 1]
        if step == Q.STEPS:
            return centre, precision / max(1.0, 2 ** ((last + 1) / Q.BINS) / Q.MEDIAN)
        core = x[bins <= last]
        centre = core.mean(axis=0)
        precision = np.linalg.inv(np.cov(core.T, bias=True) + np.diag(least))


def test_verdicts_equal_an_estimate_in_memory(spark):
    rng = np.random.default_rng(4)
    rows = []
    for lang, source, n in (("en", "a", 900), (None, "a", 300), ("en", None, 120), ("en", "b", 110), ("de", "c", 50)):
        for i in range(n):
            words = int(rng.integers(25, 400))
            symbols = int(rng.integers(0, 4)) if i % 17 else words * 3
            lines = int(rng.integers(0, 2)) if i % 29 else 60
            rows.append((len(rows), lang, source, words, words * int(rng.integers(5, 7)), symbols, lines, 0))
    rows.append((len(rows), "en", "a", 10, 50, 0, 0, 0))
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    with Scratch(spark) as scratch:
        got = {r["doc_id"]: (r["kept"], r["distance"]) for r in Q.judge(scratch, df).collect()}
        again = {r["doc_id"]: r["kept"] for r in Q.judge(scratch, df.repartition(7)).collect()}
    assert len(got) == len(rows) and again == {k: v[0] for k, v in got.items()}
    groups = {"big": [], "none": [], "pool": [], "few": []}
    for r in rows[:-1]:
        groups["big" if r[1:3] == ("en", "a") else "none" if r[1] is None else "pool" if r[1] == "en" else "few"].append(r)
    for name, members in groups.items():
        x = np.array([vector(*r[3:]) for r in members])
        if name == "few":
            assert all(got[r[0]] == (True, None) for r in members)
            continue
        centre, precision = plain_estimate(x)
        d = np.sqrt(np.einsum("ij,jk,ik->i", x - centre, precision, x - centre))
        assert np.allclose([got[r[0]][1] for r in members], d, rtol=1e-6)
        assert [got[r[0]][0] for r in members] == (d <= Q.CUT_OFF ** 0.5).tolist()
        assert 0 < np.mean(d > Q.CUT_OFF ** 0.5) < 0.15
    assert got[len(rows) - 1][0] is False


def test_bad_texts_go_and_good_ones_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    with Scratch(spark) as scratch:
        judged = Q.judge(scratch, scratch.cut(Q.with_statistics(docs, without=["text"])))
        rows = judged.join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] and not r["base_failed"]]) > 0.999
    assert np.mean([r["kept"] for r in rows if not r["quality"]]) < 0.1


def test_odd_rows(spark):
    rows = [(i, t, None, "s", "own") for i, t in enumerate(ODD)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    with Scratch(spark) as scratch:
        got = Q.judge(scratch, Q.with_statistics(df))
        assert got.columns == ["doc_id", "text", "lang", "source", *Q.STATS, "base_failed", "distance", "kept"]
        assert multiset(got.select("doc_id", "kept").collect()) == multiset([(i, False) for i in range(len(ODD))] * 2)
        assert Q.judge(scratch, Q.with_statistics(df.limit(0))).count() == 0
