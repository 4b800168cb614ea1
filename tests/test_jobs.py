"""Resolve, answer, ingest and the stream, end to end on small rows."""

import datetime as dt
import hashlib
import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from querymill.defaults import MAX_SOURCES
from querymill.plans.answer import answer, export_json, ingest
from querymill.plans.resolve import resolve
from querymill.schemas import RESULT_STORE
from querymill.sources.store import insert_results, scan_store
from querymill.streaming import jobs as J
from querymill.streaming.jobs import resolve_stream, rolling_counters, suppress_repeats, suppress_repeats_timed

QUERIES = "query_id bigint, arrival bigint, ts timestamp, query string, embedding array<float>"


def sha(text):
    return hashlib.sha256(text.lower().encode()).hexdigest()


def store(spark):
    data = [
        (sha("known query"), "known query", "valid", 0.8, "r", [], None, [1.0, 0.0], dt.datetime(2024, 1, 1), 1.0, 0, 0, "known query"),
        (sha("other query"), "other query", "valid", 0.8, "r", [], None, [0.8, 0.6], dt.datetime(2024, 1, 1), 1.0, 0, 0, "other query"),
    ]
    return spark.createDataFrame(data, RESULT_STORE)


ASKED = [
    (1, "  KNOWN   query ", [0.0, 1.0]), (2, "call my mum", [1.0, 0.0]), (3, "nearly known", [0.9, 0.1]),
    (4, "brand new", [-1.0, 0.1]), (5, "Brand  NEW", [-1.0, 0.1]), (6, "nearly known", [0.9, 0.1]),
    (7, "no vector", []), (8, "ab", [1.0, 0.0]),
]


def asked(spark):
    return spark.createDataFrame([(i, i, dt.datetime(2024, 1, 1, 0, i), q, v) for i, q, v in ASKED], QUERIES)


def outcomes(df):
    return {r["query_id"]: (r["outcome"], r["matched_hash"]) for r in df.collect()}


WANT = {
    1: ("exact_hit", sha("known query")), 2: ("invalid", None), 3: ("similar_hit", sha("known query")), 4: ("miss", None),
    5: ("exact_hit", sha("brand new")), 6: ("similar_hit", sha("known query")), 7: ("miss", None), 8: ("invalid", None),
}


def test_resolve(spark):
    got = resolve(asked(spark), store(spark))
    assert outcomes(got) == WANT
    said = {r["query_id"]: r["message"] for r in got.collect()}
    assert said[3] == "Found similar query: 'known query' (similarity: 1.00)"
    assert said[1] == "Found cached result for your query"
    assert said[2] == "Invalid query: Query appears to be a personal command or too short"


def test_resolve_judged(spark):
    def judge(queries, stored):
        return ['{"is_similar": %s, "confidence": 0.9, "reason": "why"}' % str(s == "other query").lower() for s in stored]

    got = resolve(asked(spark), store(spark), judge=judge)
    rows = {r["query_id"]: r for r in got.collect()}
    assert rows[3]["matched_hash"] == sha("other query") and rows[3]["semantic_similarity"] == 0.9
    assert rows[3]["semantic_reason"] == "why" and rows[3]["message"] == "Found semantically similar query: 'other query'"

    def broken(queries, stored):
        raise RuntimeError("down")

    assert outcomes(resolve(asked(spark), store(spark), judge=broken))[3] == ("miss", None)


def test_resolve_without_store_and_with_hooks(spark):
    plain = asked(spark).drop("embedding")
    assert {o for o, _ in outcomes(resolve(plain, store(spark), use_store=False)).values()} == {"unsaved", "invalid"}
    got = resolve(
        plain, store(spark), embedder=lambda texts: [[0.0, 1.0] if "new" in t.lower() else [1.0, 0.0] for t in texts],
        classifier=lambda texts: ['{"status": "invalid", "confidence": 1, "reason": "no"}' if t == "ab" else "?" for t in texts],
    )
    found = outcomes(got)
    assert found[4] == ("similar_hit", sha("other query")) and found[7] == ("similar_hit", sha("known query"))
    assert {r["query_id"]: r["error"] for r in got.collect()}[8] == "no"


def links(spark):
    rows = [(4, "a", i, f"Link {i}", f"http://x/{i}", None) for i in range(1, 4)] + [(4, "b", 1, "", "http://x/9", None)]
    return spark.createDataFrame(rows, "query_id bigint, engine string, position int, title string, url string, snippet string")


def pages(spark):
    text = "A first sentence that is long enough to lead the whole summary. Then a key sentence of fitting length here. End."
    rows = [(1, "http://x/1", f"<title>One</title><body>{text}</body>", 200), (2, "http://x/2", "<body>gone</body>", 500), (9, "http://x/9", f"<title>Nine</title><body>{text}</body>", 200)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, http_status int")


AS_OF = "2024-02-01 00:00:00"


def misses(spark):
    rows = resolve(asked(spark), store(spark)).where("outcome = 'miss'")
    return rows.drop("message", "error")


def test_answer_and_ingest(spark, tmp_path):
    got = {r["query_id"]: r for r in answer(misses(spark), links(spark), pages(spark), F.lit(AS_OF)).collect()}
    assert got[7]["success"] is False and got[7]["error"] == "Web scraping failed" and got[7]["summary"] is None
    content = got[4]["scraped_content"]
    assert [(p["url"], p["title"], p["success"], p["error_message"]) for p in content] == [
        ("http://x/1", "Link 1", True, None), ("http://x/2", "Link 2", False, "HTTP 500"),
        ("http://x/3", "Link 3", False, "HTTP No response"), ("http://x/9", "Nine", True, None),
    ]
    lead = "A first sentence that is long enough to lead the whole summary."
    assert got[4]["summary"]["summary"] == f"Based on the available sources for 'brand new': {lead} {lead}"
    assert got[4]["summary"]["sources"] == ["http://x/1", "http://x/9"]
    path = str(tmp_path / "store")
    for _ in range(2):
        ingest(spark, path, answer(misses(spark), links(spark), pages(spark), F.lit(AS_OF)))
    saved = scan_store(spark, path).collect()
    assert [(r["query_hash"], r["pages_scraped"], r["execution_time"]) for r in saved] == [(sha("brand new"), 2, 0.0)]
    assert saved[0]["document"].startswith("brand new | Based on")


def test_answer_with_model(spark):
    def model(prompts):
        return ['{"summary": "made", "key_points": ["%s"], "confidence": 0.9}' % p.count("--- Source") for p in prompts]

    got = {r["query_id"]: r for r in answer(misses(spark), links(spark), pages(spark), F.lit(AS_OF), model=model).collect()}
    assert tuple(got[4]["summary"])[:4] == ("made", ["2"], ["http://x/1", "http://x/9"], 0.9)


def test_export_nested(spark):
    df = spark.createDataFrame([([(dt.datetime(2024, 1, 1), "x.000000")], None)], "a array<struct<t:timestamp,s:string>>, b struct<t:timestamp>")
    assert export_json(df).first()["json"] == '{"a":[{"t":"2024-01-01T00:00:00","s":"x.000000"}]}'


def test_export(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 2, 3, 4, 5)), (2, dt.datetime(2024, 1, 1))], "id int, at timestamp")
    assert [r["json"] for r in export_json(df).collect()] == ['{"id":1,"at":"2024-01-01T02:03:04.000005"}', '{"id":2,"at":"2024-01-01T00:00:00"}']


def test_stream_equals_batch_and_survives_a_rerun(spark, tmp_path):
    path, out, feed = (str(tmp_path / n) for n in ("store", "out", "feed"))
    insert_results(spark, path, store(spark))
    asked(spark).coalesce(1).write.parquet(feed)
    stream = spark.readStream.schema(asked(spark).schema).parquet(feed)
    writer = resolve_stream(stream, path, out, links(spark), pages(spark), lambda: F.lit(AS_OF))

    def run(state):
        query = writer.option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start()
        query.awaitTermination()

    folder = spark.conf.get("spark.checkpoint.dir")
    before = {p for p in os.listdir(folder) if p.startswith("cut-")}
    run("state")
    assert {p for p in os.listdir(folder) if p.startswith("cut-")} == before
    assert outcomes(spark.read.parquet(out)) == WANT
    assert scan_store(spark, path).count() == 3
    # The same batch once more, as after a lost driver: outcomes and store stay as they are.
    run("fresh-state")
    assert outcomes(spark.read.parquet(out)) == WANT
    assert scan_store(spark, path).count() == 3


def test_steady_repeats_come_again_after_the_horizon(spark, tmp_path):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for key, day in (("a", 1), ("a", 7), ("clock", 16), ("a", 10)):
        spark.createDataFrame([(key, dt.datetime(2024, 1, day))] * 3, "query_hash string, ts timestamp").write.mode("append").parquet(feed)
        job = suppress_repeats(spark.readStream.schema("query_hash string, ts timestamp").parquet(feed), "7 days")
        job.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["query_hash"], r["ts"].day) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1), ("a", 10), ("clock", 16)]


def kept_of_batches(spark, tmp_path, batches, horizon):
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    schema = "query_hash string, ts timestamp"
    for batch in batches:
        spark.createDataFrame([(key, dt.datetime(2024, 1, day)) for key, day in batch], schema).coalesce(1).write.mode("append").parquet(feed)
        job = suppress_repeats(spark.readStream.schema(schema).parquet(feed), horizon)
        job.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r["query_hash"], r["ts"].day) for r in spark.read.parquet(out).collect())


def test_a_late_row_does_not_hide_a_timely_one(spark, tmp_path):
    got = kept_of_batches(spark, tmp_path, [[("clock", 14)], [("h", 9), ("h", 17)]], "4 days")
    assert got == [("clock", 14), ("h", 17)]


def test_repeats_of_a_hot_hash_move_the_watermark_on(spark, tmp_path):
    batches = [[("a", 1)] + [("a", 16)] * 50, [("a", 17)], [("a", 18)]]
    assert kept_of_batches(spark, tmp_path, batches, "4 days") == [("a", 1), ("a", 17)]


def test_stream_drops_late_rows_and_repeats(spark, tmp_path):
    schema = "outcome string, status string, pages_scraped int, execution_time double, query_hash string, ts timestamp"
    rows = [("miss", "valid", 1, 1.0, "a", dt.datetime(2024, 1, 1, h)) for h in (0, 1, 2, 9)]
    batches = [rows, [("miss", "valid", 1, 1.0, "a", dt.datetime(2024, 1, 1, 0, 30)), ("exact_hit", "valid", 0, 0.0, "a", dt.datetime(2024, 1, 2))]]
    feed = str(tmp_path / "feed")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(feed)
        for name, job in (("w", lambda s: rolling_counters(s, "1 hour", late="1 hour")), ("r", lambda s: suppress_repeats(s, "30 days"))):
            counted = job(spark.readStream.schema(schema).parquet(feed))
            counted.writeStream.format("parquet").option("path", str(tmp_path / name)).option(
                "checkpointLocation", str(tmp_path / f"{name}-state")
            ).trigger(availableNow=True).start().awaitTermination()
    windows = spark.read.parquet(str(tmp_path / "w")).orderBy("window_start").collect()
    assert [(r["window_start"].hour, r["cache_misses"]) for r in windows] == [(0, 1), (1, 1), (2, 1), (9, 1)]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    assert MAX_SOURCES == 5


def test_settled_outcomes_can_be_counted_and_delivered(spark, tmp_path):
    from querymill.operators.stats import stats_full
    from querymill.plans.respond import respond, settle

    path = str(tmp_path / "store")
    insert_results(spark, path, store(spark))
    resolved = resolve(asked(spark), store(spark))
    answers = answer(resolved.where("outcome = 'miss'").drop("message", "error"), links(spark), pages(spark), F.lit(AS_OF))
    settled = settle(resolved, answers)
    ingest(spark, path, answers)
    before, after = outcomes(resolved), outcomes(settled)
    lost = {r["query_hash"] for r in answers.collect() if not r["success"]}
    hashes = {r["query_id"]: r["query_hash"] for r in resolved.collect()}
    assert lost and len(after) == len(before)
    for q, (kind, matched) in before.items():
        fails = hashes[q] in lost and kind in ("miss", "exact_hit")
        assert after[q] == (("failed", None) if fails else (kind, matched))
    counted = stats_full(settled).first()
    kinds = [k for k, _ in after.values()]
    assert (counted["total_queries"], counted["cache_misses"], counted["total_pages_scraped"]) == (len(after), sum(k in ("miss", "failed") for k in kinds), 2)
    rows = {r["query_id"]: r for r in respond(settled, answers, scan_store(spark, path)).collect()}
    assert len(rows) == len(after)
    for q, (kind, matched) in after.items():
        r = rows[q]
        assert (r["cache_hit"], r["success"]) == (kind in ("exact_hit", "similar_hit"), kind in ("exact_hit", "similar_hit", "miss"))
        assert (r["result"] is None) == (kind in ("invalid", "failed")) or kind not in ("invalid", "failed")
        if r["cache_hit"]:
            assert r["result"]["query_hash"] == matched
    assert rows[4]["result"]["summary"]["sources"] == ["http://x/1", "http://x/9"]
    assert rows[3]["similar_query_used"] and rows[7]["message"] == "Failed to scrape any web content for your query"


def test_requests_without_text_are_invalid(spark):
    rows = [(1, 1, dt.datetime(2024, 1, 1), None, [1.0, 0.0]), (2, 2, dt.datetime(2024, 1, 1), " \t", [1.0, 0.0])]
    empty = spark.createDataFrame(rows, "query_id bigint, arrival bigint, ts timestamp, query string, embedding array<float>")
    assert outcomes(resolve(empty, store(spark))) == {1: ("invalid", None), 2: ("invalid", None)}


def test_timers_suppress_what_the_plain_operator_does(spark, tmp_path):
    """Horizon of three days, late rows, one hot hash, batches whose rows come in order of time."""
    rng, batches = random.Random(3), []
    for start in range(1, 25, 4):
        rows = [(rng.choice("abcdef"), start + rng.random() * 4) for _ in range(12)] + [("hot", start + i / 100) for i in range(300)]
        rows += [(rng.choice("abg"), max(1.0, start - 6 + rng.random()))] * 2
        batches.append(sorted(rows, key=lambda r: r[1]))
    schema, feed = "query_hash string, ts timestamp", str(tmp_path / "feed")
    got = {}
    for name, job in (("plain", lambda f: suppress_repeats(f, "3 days")), ("timed", lambda f: suppress_repeats_timed(f, "3 days", salts=4))):
        for i, batch in enumerate(batches):
            if name == "plain":
                rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for k, d in batch]
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
                time.sleep(0.02)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
        job(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
        got[name] = sorted((r["query_hash"], r["ts"]) for r in spark.read.schema(schema).parquet(str(tmp_path / name)).collect())
    assert got["timed"] == got["plain"]
    assert sum(k == "hot" for k, _ in got["timed"]) > 1 and len(got["timed"]) < sum(map(len, batches)) / 10


def test_a_group_of_many_hashes_hands_on_the_first_of_each(monkeypatch):
    """One call for all hashes of a group; where they do not fit, a hash may come out again, but never later than its first."""
    rng = random.Random(5)
    parts = [pd.DataFrame([(f"h{rng.randrange(50)}", rng.randrange(10**6)) for _ in range(40)], columns=["query_hash", "ts"]) for _ in range(30)]
    every = pd.concat(parts)
    want = every.groupby("query_hash")["ts"].min().to_dict()
    for most, calls in ((1 << 16, 1), (300, 1), (60, 100)):
        monkeypatch.setattr(J, "HELD_ROWS", most)
        out = list(J.FirstOfBatch("query_hash", ["ts"]).handleInputRows((0, 0), iter(parts), None))
        got = pd.concat(out)
        assert got.groupby("query_hash")["ts"].min().to_dict() == want and len(out) <= calls
        assert len(out) > 1 or len(got) == len(want)


def test_kept_counters_equal_those_of_the_whole_log(spark, tmp_path):
    """Five batches, one of them run twice, one empty."""
    from querymill.operators.stats import access_rollup, stats_full, stats_reference
    from querymill.plans.tally import keep, kept_access, kept_counters

    rng = random.Random(4)
    kinds = ["invalid", "exact_hit", "similar_hit", "miss", "unsaved", "failed"]
    rows = [(rng.choice(kinds), rng.choice(["valid", "invalid"]), rng.randrange(5), rng.randrange(8) / 4, rng.choice("abc"), rng.choice(["m", None]), dt.datetime(2024, 1, 1 + i % 20)) for i in range(200)]
    schema = "outcome string, status string, pages_scraped int, execution_time double, query_hash string, matched_hash string, ts timestamp"
    log, path = spark.createDataFrame(rows, schema), str(tmp_path / "tally")
    for batch in (0, 1, 2, 2, 3):
        keep(spark.createDataFrame(rows[batch * 50:batch * 50 + 50], schema), path, batch, "query_hash")
    keep(log.limit(0), path, 4, "query_hash")
    for full, plain in ((True, stats_full), (False, stats_reference)):
        assert sorted(kept_counters(spark, path, "query_hash", full=full).collect()) == sorted(plain(log, "query_hash").collect())
        assert kept_counters(spark, path, full=full).collect() == plain(log).collect()
    assert sorted(kept_access(spark, path).collect()) == sorted(access_rollup(log).collect())
