import hashlib
import random
from collections import defaultdict

from querymill.llm import chat_format as C
from tests.llm.helpers import LONG, ODD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(seed):
    rng = random.Random(seed)
    signs = ["\\", "#", "##", "###", "<", "</turn>", "</turn>\n", "### assistant: ", ":", "\n", "a", "é漢😀", "$1", " "]
    text = lambda: rng.choice([None, "".join(rng.choice(signs) for _ in range(rng.randrange(12)))])
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Assistant", None, "a: b\\", "x</turn>\n"]), text()) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(100, t, "assistant", t_) for t, t_ in enumerate(ODD)] + [(None, 1, "assistant", "no id"), (None, None, "user", "first"), (7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, None, "assistant", "x"), (101, 0, "user", LONG), (101, 1, "assistant", LONG)]
    return rows


def key(row):
    return tuple((v is not None, v) if v is not None else (False,) for v in row)


def test_what_is_read_back_is_what_was_said(spark):
    rows = rows_of(1)
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, example string").repartition(3)
    by = defaultdict(list)
    for c, *rest in rows:
        by[c].append(tuple(rest))
    got = {r["conv_id"]: r for r in C.read_back(C.examples(df)).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=key)
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        assert tuple(got[c])[1:5] == (len(turns), sha(said), len(loss), sha(loss)), c


def test_every_reply_is_an_example_with_all_turns_before_it(spark):
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = C.examples(df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    by, out = defaultdict(list), defaultdict(list)
    for c, *rest in rows:
        by[c].append(tuple(rest))
    loss = C.unescaped(C.F.substr("text", C.F.col("loss_start") + 1, C.F.col("loss_end") - C.F.col("loss_start")))
    for r in made.select("conv_id", "example", "last", loss.alias("loss"), C.turns_of(C.F.col("text")).alias("turns")).collect():
        out[r["conv_id"]].append(r)
    for c, turns in by.items():
        turns.sort(key=key)
        want = [([(r or "", t or "") for _, r, t in turns[:i + 1]], turns[i][2] or "") for i in range(len(turns)) if turns[i][1] == "assistant"]
        if turns[-1][1] != "assistant":
            want.append(([(r or "", t or "") for _, r, t in turns], ""))
        got = sorted(out[c], key=lambda r: r["example"])
        assert [([tuple(t) for t in r["turns"]], r["loss"]) for r in got] == want
        assert [r["last"] for r in got] == [False] * (len(want) - 1) + [True]


def test_no_rows(spark):
    assert C.read_back(C.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
