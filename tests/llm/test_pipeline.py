"""The pipeline, stage by stage, against plain forms of what each stage decides."""

from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from querymill.llm import packing, quality_rules as Q
from querymill.llm.queries import byte_bpe
from tests.llm.helpers import components, multiset, statistics

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents, and what every stage leaves of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(500)
    out = [docs]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert [s.columns for s in stages[:4]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "best-fit packing"]


def test_toxic_texts_go_and_clean_ones_stay(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = {r["doc_id"] for r in stages[1].select("doc_id").collect()}
    rows = stages[0].join(labels, "doc_id").select("doc_id", "toxic").collect()
    assert np.mean([r["doc_id"] in left for r in rows if not r["toxic"]]) > 0.99
    assert np.mean([r["doc_id"] in left for r in rows if r["toxic"]]) < 0.4


def test_failing_texts_go(spark, stages):
    left = multiset(stages[2].collect())
    assert not left - multiset(stages[1].collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    kept = {r["doc_id"] for r in stages[2].select("doc_id").collect()}
    for r in stages[1].collect():
        n, _, _, _, repeated = statistics(r["text"])
        if n < Q.MIN_WORDS or 100 * repeated > Q.MAX_REPEATED * n:
            assert r["doc_id"] not in kept
        elif quality.get(r["doc_id"]) == 1:
            assert r["doc_id"] in kept


def test_one_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want = {least for _, _, least in components(rows, 5, 80)}
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(want)


def test_every_remaining_text_is_packed_whole(stages):
    encode, tokens = packing._encoder(byte_bpe()), defaultdict(int)
    packed = stages[4].collect()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    assert tokens == {r["doc_id"]: len(encode(r["text"])) + 1 for r in stages[3].collect()}
    assert len({r["sequence_id"] for r in packed}) <= sum(tokens.values()) / 1024 * 1.1 + 1


def test_registered():
    names = E.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))


def test_without_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
