import os
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

from querymill.llm import toxicity as T
from tests.llm.helpers import LONG, ODD

SF = "/root/testdata/sf0.1"
ROOT = Path(__file__).resolve().parents[2]


def plain_ftrl(rows, rates, bits):
    """The update rule one coordinate at a time."""
    z, n = {}, {}
    size = 1 << bits

    def weight(i):
        if abs(z.get(i, 0)) <= rates.l1:
            return 0.0
        return (np.sign(z[i]) * rates.l1 - z[i]) / ((rates.beta + np.sqrt(n[i])) / rates.alpha + rates.l2)

    for hashes, label in rows:
        at = [*map(int, sorted(set(T.features(hashes, bits).tolist()))), size]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in at:
            step = (np.sqrt(n.get(i, 0) + g * g) - np.sqrt(n.get(i, 0))) / rates.alpha
            z[i] = z.get(i, 0) + g - step * w[i]
            n[i] = n.get(i, 0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_learner_follows_the_rule():
    rng = random.Random(1)
    rows = [(np.array([rng.randrange(1, 40) for _ in range(rng.randrange(0, 9))], np.uint64), rng.randrange(2)) for _ in range(200)]
    learner = T.Ftrl(10, T.Rates(l1=0.5))
    for hashes, label in rows:
        learner.learn(hashes, label)
    got = learner.model()
    want = plain_ftrl(rows, T.Rates(l1=0.5), 10)
    assert set(got.coordinate) == set(want) and np.allclose(got.weight, [want[i] for i in got.coordinate])


def test_held_out_texts_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = T.judge(docs, labels, without=["text"])
    assert judged.columns == ["doc_id", "lang", "source", "n_chars", "score", "held_out", "predicted"]
    rows = judged.where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.01


@pytest.mark.parametrize(("sf", "caught", "wrong"), [("sf0.001", 0.5, 2), ("sf0.01", 0.6, 0)])
def test_few_labels_leave_clean_texts_alone(spark, sf, caught, wrong):
    """Of the texts that labels were learned from nearly all toxic ones are caught; of held-out ones, a handful, most."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.judge(docs, labels, without=["text"]).join(labels, "doc_id").select("toxic", "held_out", "predicted").collect()
    assert sum(r["predicted"] for r in rows if not r["toxic"] and r["held_out"]) <= wrong
    assert np.mean([r["predicted"] for r in rows if r["toxic"] and not r["held_out"]]) > 0.85
    assert np.mean([r["predicted"] for r in rows if r["toxic"] and r["held_out"]]) >= caught


def test_executors_do_not_need_the_package(tmp_path):
    """As the driver runs it: only the entry module finds the package, the workers do not."""
    script = tmp_path / "run.py"
    script.write_text(f"""
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spec = importlib.util.spec_from_file_location("__spark_entry__", "{ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
print("rows", entry.queries()["op3_toxicity"](spark, "/root/testdata/sf0.001").count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]


def test_odd_rows(spark):
    rows = [(i, t, "own") for i, t in enumerate(ODD)] + [(None, "scum idiot", None), (3, "a", "again"), (3, "a", "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (3, 1), (3, 0), (8, 0)], "doc_id long, toxic int")
    got = T.judge(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(ODD))}
    unlabelled = T.judge(docs, labels.limit(0)).collect()
    assert np.allclose([r["score"] for r in unlabelled], T.PRIOR) and not any(r["predicted"] for r in unlabelled)
    assert T.judge(docs.limit(0), labels).count() == 0
    assert len(LONG) > 300_000
