"""Store, history and statistics on small rows."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querymill.operators.answers import nest_pages, page_rollup
from querymill.operators.history import contains_term, list_history
from querymill.operators.stats import access_rollup, stats_full, stats_reference
from querymill.plans.reports import stats
from querymill.schemas import RESULT_STORE, SCRAPED_CONTENT
from querymill.sources import search_index as I, store as S


def rows(spark, keys, query="q", day=1):
    data = [
        (k, f"{query} {k}", "valid", 0.8, "r", [], None, [1.0], dt.datetime(2024, 1, day, 0, i), 1.5, 2, 30, f"{query} {k} | text")
        for i, k in enumerate(keys)
    ]
    return spark.createDataFrame(data, RESULT_STORE)


def keys(df):
    return sorted(r["query_hash"] for r in df.select("query_hash").collect())


def test_compact_keeps_rows_in_fewer_files(spark, tmp_path):
    path = tmp_path / "store"
    for i in range(4):
        S.insert_results(spark, str(path), rows(spark, [f"aa{i}", f"bb{i}"]))
    before = len(list(path.rglob("*.parquet")))
    want = sorted(map(str, S.scan_store(spark, str(path)).drop("created_at").collect()))
    S.compact(spark, str(path))
    assert sorted(map(str, S.scan_store(spark, str(path)).drop("created_at").collect())) == want
    assert len(list(path.rglob("*.parquet"))) == 2 < before
    S.compact(spark, str(tmp_path / "absent"))


class Lost(Exception):
    """The driver is lost."""


@pytest.mark.parametrize("write", ["delete", "compact", "clear"])
def test_a_driver_lost_at_any_step_loses_no_row(spark, tmp_path, monkeypatch, write):
    """After every single call on the file system: readers see all rows from before or all from after, and the next writer goes on from there."""
    run = {
        "delete": lambda path: S.delete_results(spark, path, rows(spark, ["aa1", "bb1", "cc1", "cc2"])),
        "compact": lambda path: S.compact(spark, path), "clear": lambda path: S.clear(spark, path),
    }[write]
    before = ["aa1", "aa2", "bb1", "bb2", "cc1", "cc2", "dd1"]
    after = {"delete": ["aa2", "bb2", "dd1"], "compact": before, "clear": []}[write]
    seen, step, ended = [], 0, False
    while not ended:
        path, calls = str(tmp_path / f"store{step}"), []
        S.insert_results(spark, path, rows(spark, before))
        with monkeypatch.context() as patch:
            for name in ("rename", "delete"):
                plain = getattr(S._files, name)

                def call(self, *args, plain=plain):
                    if len(calls) == step:
                        raise Lost
                    calls.append(args)
                    return plain(self, *args)

                patch.setattr(S._files, name, call)
            try:
                run(path)
                ended = True
            except Lost:
                pass
        seen.append(keys(S.scan_store(spark, path)))
        assert seen[-1] in (before, after)
        S.repair(spark, path)
        assert keys(S.scan_store(spark, path)) == seen[-1] and not [p for p in (tmp_path / f"store{step}").iterdir() if p.name.startswith(("_swap", "_done"))]
        S.insert_results(spark, path, rows(spark, ["aa1", "aa2", "ee1"]))
        assert keys(S.scan_store(spark, path)) == sorted({*seen[-1], "aa1", "aa2", "ee1"})
        step += 1
    assert step > 3 and seen[0] == before and seen[-1] == after


def test_an_insert_reads_only_the_partitions_it_writes_to(spark, tmp_path):
    path = str(tmp_path / "store")
    S.insert_results(spark, path, rows(spark, [f"{i:02x}a" for i in range(48)]))
    fresh = rows(spark, ["05a", "05b", "0aq"]).withColumn(S.PREFIX, S.hash_prefix())
    held = S._held(S.scan_store(spark, path), fresh)
    assert keys(held) == ["05a", "0aa"]
    scan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [hash_prefix" in scan and "ReadSchema: struct<query_hash:string>" in scan
    files = spark.read.option("basePath", path).parquet(path).where(F.col(S.PREFIX).isin("05", "0a")).select(F.input_file_name()).distinct().count()
    assert files == 2
    S.insert_results(spark, path, fresh.drop(S.PREFIX))
    assert S.scan_store(spark, path).count() == 50


def test_insert_delete_clear(spark, tmp_path):
    path = str(tmp_path / "store")
    assert S.scan_store(spark, path).count() == 0
    S.insert_results(spark, path, rows(spark, ["aa1", "aa2", "bb1"]))
    S.insert_results(spark, path, rows(spark, ["aa1", "cc1", "cc1"], "changed", 2))
    stored = {r["query_hash"]: r["query"] for r in S.scan_store(spark, path).collect()}
    assert stored == {"aa1": "q aa1", "aa2": "q aa2", "bb1": "q bb1", "cc1": "changed cc1"}
    S.delete_results(spark, path, rows(spark, ["bb1", "aa2", "zz9"]))
    assert keys(S.scan_store(spark, path)) == ["aa1", "cc1"]
    S.delete_results(spark, path, rows(spark, ["zz9"]))
    S.insert_results(spark, path, rows(spark, ["bb1"]))
    assert keys(S.scan_store(spark, path)) == ["aa1", "bb1", "cc1"]
    size = S.store_size(spark, path).first()
    files = [p for p in (tmp_path / "store").rglob("*.parquet")]
    assert tuple(size) == (3, sum(p.stat().st_size for p in files))
    assert keys(S.lookup(S.scan_store(spark, path), rows(spark, ["aa1", "nope"]))) == ["aa1"]
    S.clear(spark, path)
    assert S.scan_store(spark, path).count() == 0
    assert S.store_size(spark, path).first()["total_entries"] == 0


def test_lookup_reads_key_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    S.insert_results(spark, path, rows(spark, ["aa1", "bb1"]))
    one = S.scan_store(spark, path).where(F.col(S.PREFIX) == "aa")
    assert "PartitionFilters: [isnotnull(hash_prefix" in one._jdf.queryExecution().executedPlan().toString()


def test_record_round_trip(spark):
    page = [("u", "t", "body", 4, dt.datetime(2024, 1, 1), True, None, "success")]
    df = rows(spark, ["aa"]).withColumn("scraped_content", F.lit(None)).drop("scraped_content")
    pages = spark.createDataFrame([("aa", page)], f"query_hash string, scraped_content {S.STORED_RECORD['scraped_content'].dataType.simpleString()}")
    back = S.decode_result(S.encode_result(df.join(pages, "query_hash"))).select("result.*").first()
    assert back["query"] == "q aa" and back["created_at"] == dt.datetime(2024, 1, 1) and back["embedding"] == [1.0]
    assert tuple(back["scraped_content"][0]) == page[0] and back["classification"]["status"] == "valid"


def test_history(spark):
    store = rows(spark, ["k1", "k2", "k3"]).unionByName(rows(spark, ["k4"], "Other", 5))
    assert [r["id"] for r in list_history(store, 2).collect()] == ["k4", "k3"]
    assert [r["id"] for r in list_history(store, 2, "Q K").collect()] == ["k3", "k2"]
    assert list_history(store, 10, "TEXT").count() == 4
    assert list_history(store, None).count() == 4


OUTCOME = "outcome string, status string, pages_scraped int, execution_time double, query_hash string, matched_hash string, ts timestamp"
LOG = [
    ("miss", "valid", 3, 2.0, "a", None), ("exact_hit", "valid", None, None, "a", "a"), ("similar_hit", "valid", None, None, "b", "a"),
    ("invalid", "invalid", None, None, "c", None), ("unsaved", "valid", 2, 1.0, "d", None), ("failed", "valid", 0, 1.0, "e", None),
]


def test_counters(spark, tmp_path):
    log = spark.createDataFrame([(*r, dt.datetime(2024, 1, 1, i)) for i, r in enumerate(LOG)], OUTCOME)
    ref = stats_reference(log).first()
    assert (ref["total_queries"], ref["valid_queries"], ref["invalid_queries"], ref["cache_hits"], ref["cache_misses"]) == (1, 1, 0, 1, 1)
    assert (ref["total_pages_scraped"], ref["average_execution_time"], ref["cache_hit_rate"], ref["success_rate"]) == (3, 2.0, 50.0, 100.0)
    full = stats_full(log).first()
    assert (full["total_queries"], full["invalid_queries"], full["cache_hits"], full["cache_misses"]) == (6, 1, 2, 3)
    none = stats_reference(log.where("false")).first()
    assert (none["total_queries"], none["cache_hit_rate"], none["average_execution_time"], none["success_rate"]) == (0, 0.0, 0.0, 0.0)
    assert [tuple(r)[:2] for r in access_rollup(log).collect()] == [("a", 2)]
    path = str(tmp_path / "store")
    S.insert_results(spark, path, rows(spark, ["aa1"]))
    report = stats(spark, log, path).first()
    assert report["total_entries"] == 1 and report["cache_size_mb"] > 0 and report["last_updated"] == dt.datetime(2024, 1, 1, 5)


def test_hot_query_keeps_order(spark):
    data = [("hot", i, f"u{i}", "t", "x" * i, i, dt.datetime(2024, 1, 1), i % 2 == 0, None, "success") for i in range(200)]
    names = ["query_hash", "position", *SCRAPED_CONTENT.fieldNames()]
    scraped = spark.createDataFrame(data, ", ".join(f"{n} {t}" for n, t in zip(names, ["string", "int", *[f.dataType.simpleString() for f in SCRAPED_CONTENT.fields]])))
    got = nest_pages(scraped.repartition(4), limit=5).first()
    assert [p["url"] for p in got["scraped_content"]] == [f"u{i}" for i in range(5)]
    assert len(nest_pages(scraped).first()["scraped_content"]) == 200
    assert "WindowGroupLimit" in nest_pages(scraped, limit=5)._jdf.queryExecution().executedPlan().toString()
    roll = page_rollup(scraped).first()
    assert (roll["pages_scraped"], roll["success_rate"]) == (100, 0.5)


@pytest.mark.parametrize(("days", "left"), [(None, 3), (2, 1), (30, 3)])
def test_ttl(spark, days, left):
    store = rows(spark, ["k1", "k2"]).unionByName(rows(spark, ["k3"], day=9))
    assert S.not_expired(store, days, F.lit("2024-01-10 00:00:00").cast("timestamp")).count() == left


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path):
    texts = ["The quick Brown fox", "brown", "BROWN bread", "bro wn", None, "", "ab", "İstanbul straße", "漢字かな交じり", "x" * 5000 + "needle" + "y" * 5000, "%_\\ odd", "😀 smile 😀"]
    df = spark.createDataFrame([(f"{i:02d}", t, "own Brown" if i == 6 else None) for i, t in enumerate(texts)], "key string, a string, b string")
    path = str(tmp_path / "grams")
    for part in (df.where("key < '05'"), df.where("key >= '05'"), df.where("key = '02'")):
        I.add_to_index(part, path, "key", "a", "b")
    for term in ("brown", "rown b", "BROWN", "own", "no such", "İstan", "istan", "straße", "漢字か", "needle", "xxn", "%_\\", "😀 s", "br", "", "   "):
        want = sorted(r["key"] for r in df.where(contains_term(term, "a", "b")).collect())
        assert sorted(r["key"] for r in I.search(df, path, term, "key", "a", "b").collect()) == want, term


def test_postings_are_the_trigrams_made_batch_by_batch(spark, monkeypatch):
    texts = ["The quick Brown fox", None, "", "ab", "İstanbul straße Σας", "漢字かな交じり", "😀 smile 😀", "aaaa\x00\x7f\x80\u07ff\u0800\uffff\U00010000", "abcabc"]
    df = spark.createDataFrame([(i % 8, t, "own abc" if i % 2 else None) for i, t in enumerate(texts)] + [(None, "null key", None)], "key int, a string, b string")
    want = df.select("key", F.explode(F.array_union(I.trigrams(F.col("a")), I.trigrams(F.coalesce("b", F.lit(""))))).alias("gram"))
    for most in (1 << 16, 4):
        monkeypatch.setattr(I, "POSTINGS", most)
        got = I.postings(df, "key", "a", "b")
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_indexed_search_reads_little(spark, tmp_path):
    store, path = str(tmp_path / "store"), str(tmp_path / "grams")
    rng = random.Random(1)
    data = rows(spark, [f"{i:02x}{i}" for i in range(50)]).withColumn("document", F.concat(F.lit("text "), F.sha2("query_hash", 256), F.lit(" end")))
    S.insert_results(spark, store, data)
    I.add_to_index(S.scan_store(spark, store), path, "query_hash", "query", "document")
    held = S.scan_store(spark, store)
    term = rng.choice(held.collect())["document"][9:19]
    got = I.search(held, path, term, "query_hash", "query", "document")
    assert keys(got) == keys(held.where(contains_term(term, "query", "document"))) and got.count() == 1
    plan = I.candidates(spark, path, term)._jdf.queryExecution().executedPlan().toString()
    asked = re.search(r"PartitionFilters: \[bucket#\d+ IN \(([\d,]+)\)", plan)[1].split(",")
    sizes = Counter()
    for file in (tmp_path / "grams" / "keys").rglob("*.parquet"):
        sizes[file.parent.name] += file.stat().st_size
    assert "PushedFilters: [In(gram" in plan and 8 * sum(sizes[f"bucket={b}"] for b in asked) < sum(sizes.values())
    assert re.search(r"PartitionFilters: \[[^\]]*hash_prefix", got._jdf.queryExecution().executedPlan().toString())
