"""What the physical plans must and must not contain."""

import re
from pathlib import Path

import pytest

from querymill.functions import text as X
from querymill.plans.resolve import classify
from querymill.sources.store import insert_results, new_rows, scan_store
from tests.test_store import rows
from workloads import CASES
from workloads.store import hashed
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["exact_result_join", "unanswered_queries", "similarity_topk", "similarity_in_blocks", "links_of_both_engines", "query_pages"])
def test_no_all_pairs_join(spark, name):
    text = plan(CASES[name].run(spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_insert_reads_keys_only(spark, tmp_path):
    path = str(tmp_path / "store")
    insert_results(spark, path, rows(spark, ["aa1", "bb2"]))
    schemas = re.findall(r"ReadSchema: (\S+)", plan(new_rows(scan_store(spark, path), rows(spark, ["cc3"]))))
    assert schemas == ["struct<query_hash:string>"]


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(hashed(spark, SF_DIR))
    assert "EqualTo(role,user)" in text
    counted = plan(CASES["counters"].run(spark, SF_DIR))
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in counted


@pytest.mark.parametrize("name", ["normalize_query", "clean_text", "classify_heuristic", "truncate_content", "valid_urls", "url_domain"])
def test_text_rules_stay_in_the_jvm(spark, name):
    text = plan(CASES[name].run(spark, SF_DIR))
    assert "Python" not in text and "*(1)" in text and "Exchange" not in text


def test_rules_are_worked_out_once(spark):
    asked = spark.read.parquet(f"{SF_DIR}/conversations.parquet").withColumn("query", X.normalize_query(F.col("text")))
    text = plan(classify(asked).select("status", "confidence", "reason"))
    assert text.count("regexp_replace") == 1


def test_ranking_is_cut_before_the_shuffle(spark):
    for name in ("similarity_topk", "rows_to_insert"):
        assert re.search(r"WindowGroupLimit .*Partial", plan(CASES[name].run(spark, SF_DIR))), name


def test_nothing_unbounded_reaches_the_driver():
    """Every collect in the library is one of the bounded ones, each with its bound beside it."""
    root = Path(__file__).resolve().parents[1] / "querymill"
    # The training-text package is held to this by its own tests.
    files = [p for p in root.rglob("*.py") if p.parent.name != "llm"]
    found = {p.name: len(re.findall(r"\.(?:collect|toPandas|toLocalIterator)\(", p.read_text())) for p in files}
    assert {k: v for k, v in found.items() if v} == {"similarity.py": 3, "store.py": 2, "search_index.py": 3}
    text = "".join(p.read_text() for p in files)
    assert "localCheckpoint" not in text and "crossJoin" not in text
