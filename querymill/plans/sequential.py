"""Resolve queries as if they were asked one after another, each answer visible to the next.

A query is a miss if no stored row and no earlier miss answers it, else it follows the best of them. Without a judge every row that is similar enough
answers, and the misses are the lexicographically first maximal independent set of the similarity graph; it is
found in rounds, of which a random order needs O(log^2 n) (Blelloch, Fineman, Shun, SPAA 2012). Where queries form a chain, each like the one before, rounds
alone would settle one query at a time: there every query with a single undecided earlier neighbour points to it, pointers are doubled until they reach one
that is settled, and the number of steps, odd or even, tells what it is. The
graph is never written down: a round only asks, per undecided query, for two earlier undecided queries that are similar, which is a similarity join with k = 2.

With a judge a query asks about its k best rows only, in their order, and which ones these are depends on what was saved before. A round settles the queries for which
this makes no difference any more; the earliest undecided one always is. Most undecided queries are not saved in the end, and a list full of them settles little; so of many
queries the first are let in, and the next when few of those are undecided. Lists and verdicts are the work, and are made by all tasks; one task goes through the lists of those let in.
"""

import math
import operator
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from querymill.defaults import JUDGE_THRESHOLD, MAX_CANDIDATES, SIMILARITY_THRESHOLD
from querymill.functions.replies import parse_verdict
from querymill.operators.matching import accepts
from querymill.operators.similarity import similarity_join
from querymill.providers import TextHook, text_hook
from querymill.session import cut

# Judged queries that are let in at once, at least; the next ones are when this share of that is undecided.
LET_IN, FEW_LEFT = 1 << 17, 1 / 4


def resolve_sequential(
    queries: DataFrame,
    store: DataFrame,
    *,
    threshold: float = SIMILARITY_THRESHOLD,
    metric: str = "cosine",
    score: str = "reference",
    block_rows: int | None = None,
) -> DataFrame:
    """Rows (query_id, outcome, matched_hash, similarity_score).

    ``queries`` holds valid queries with ``query_id``, ``arrival`` (unique, not negative),
    ``query_hash`` and ``embedding``; ``store`` holds ``query_hash`` and ``embedding``.
    """
    extra = {"block_rows": block_rows} if block_rows else {}

    def nearest(asked: DataFrame, stored: DataFrame, store_key: str, k: int = 1) -> DataFrame:
        return similarity_join(
            asked, stored, store_key=store_key, query_seq="arrival", store_seq="seq",
            threshold=threshold, metric=metric, score=score, k=k, **extra,
        )

    rows = cut(
        queries.select("query_id", F.col("arrival").cast("bigint").alias("arrival"), "query_hash", "embedding")
        .join(store.select("query_hash", F.lit(True).alias("_stored")), "query_hash", "left")
    )
    fresh = rows.where(F.col("_stored").isNull()).drop("_stored")
    # Only the first query of a hash can be the miss: if it follows a row, so do its repeats, unless
    # they are worded or embedded differently, in which case each stands for itself.
    heads = fresh.groupBy("query_hash", "embedding").agg(F.min(F.struct("arrival", "query_id")).alias("_at"))
    heads = heads.select("query_hash", "embedding", "_at.arrival", "_at.query_id")
    base = store.select("query_hash", "embedding", F.lit(-1).cast("bigint").alias("seq"))
    followed = nearest(heads, base, "query_hash").select("query_id")
    undecided = cut(heads.join(followed, "query_id", "left_anti"))
    leaders = [undecided.limit(0)]
    while undecided.take(1):
        earlier = undecided.select(F.col("query_id").alias("other_id"), "embedding", F.col("arrival").alias("seq"))
        ready = cut(undecided.join(_leaders(undecided, nearest(undecided, earlier, "other_id", k=2)), "query_id", "left_semi"))
        leaders.append(ready)
        behind = nearest(
            undecided, ready.select(F.col("query_id").alias("other_id"), "embedding", F.col("arrival").alias("seq")),
            "other_id",
        ).select("query_id")
        left = undecided.join(ready.select("query_id"), "query_id", "left_anti")
        left = left.join(ready.select("query_hash"), "query_hash", "left_anti")
        undecided = cut(left.join(behind, "query_id", "left_anti"))

    misses = reduce(DataFrame.unionByName, leaders).select("query_hash", "embedding", F.col("arrival").alias("seq"))
    saved = misses.select("query_hash", F.col("seq").alias("_saved"))
    placed = rows.join(saved, "query_hash", "left")
    exact = F.col("_stored").isNotNull() | (F.col("arrival") > F.col("_saved"))
    first = F.col("arrival") == F.col("_saved")
    asked = placed.where(~F.coalesce(exact | first, F.lit(False)))
    best = nearest(asked, base.unionByName(misses), "query_hash").select(
        "query_id", F.col("query_hash").alias("matched_hash"), F.col("score").alias("similarity_score")
    )
    joined = placed.join(best, "query_id", "left")
    return joined.select(
        "query_id",
        F.when(F.coalesce(exact, F.lit(False)), "exact_hit").when(first, "miss").otherwise("similar_hit").alias("outcome"),
        F.when(F.coalesce(exact, F.lit(False)), F.col("query_hash")).otherwise(F.col("matched_hash")).alias("matched_hash"),
        "similarity_score",
    )


def _leaders(undecided: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id) of the undecided queries that are misses for certain. ``near``: for each, up to two earlier undecided ones (other_id) that are similar.

    A query without one is a miss; with a single one it is what that one is not; with two, or behind another of its hash, it waits.
    """
    found = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("other_id").alias("only"))
    known = undecided.select("query_id").join(found, "query_id", "left").join(_repeats(undecided).withColumn("behind", F.lit(True)), "query_id", "left")
    free = F.col("behind").isNull()
    single = free & F.coalesce(F.col("n") == 1, F.lit(False))
    # Where a query's pointer leads, whether by an odd number of steps, and whether what stands there is settled; roots point to themselves.
    steps = cut(known.select("query_id", F.when(single, F.col("only")).otherwise(F.col("query_id")).alias("up"), single.alias("odd"), (free & F.col("n").isNull()).alias("settled")))
    while steps.where("query_id <> up").take(1):
        next_ = steps.select(F.col("query_id").alias("up"), F.col("up").alias("far"), F.col("odd").alias("more"), F.col("settled").alias("there"))
        jumped = cut(steps.join(next_, "up").select("query_id", F.col("far").alias("up"), (F.col("odd") != F.col("more")).alias("odd"), F.col("there").alias("settled"), (F.col("far") != F.col("up")).alias("moved")))
        steps = jumped.drop("moved")
        if not jumped.where("moved").take(1):
            break
    return steps.where("settled AND NOT odd").select("query_id")


def _repeats(undecided: DataFrame) -> DataFrame:
    """Queries that wait for an earlier undecided one of the same hash."""
    first = cut(undecided.groupBy("query_hash").agg(F.min("arrival").alias("_first")))
    return undecided.join(first, "query_hash").where(F.col("arrival") > F.col("_first")).select("query_id")


def resolve_sequential_judged(
    queries: DataFrame,
    store: DataFrame,
    judge: TextHook,
    *,
    threshold: float = SIMILARITY_THRESHOLD,
    judge_threshold: float = JUDGE_THRESHOLD,
    k: int = MAX_CANDIDATES,
    metric: str = "cosine",
    score: str = "reference",
    block_rows: int | None = None,
) -> DataFrame:
    """Rows (query_id, outcome, matched_hash, similarity_score, semantic_similarity).

    As ``resolve_sequential``, with the texts (``query``) of both sides: a query walks its ``k`` best rows, stored or saved by an earlier miss, and follows the first that
    the judge accepts. The judge must answer equal texts alike; it is asked once about each pair of texts.

    In a round, a query's list holds its best rows that are saved for certain and, for the undecided queries before it, the first of each text. It is no miss if the judge accepts a
    saved row that is among the first k of that list, whatever becomes of the undecided ones. It is a miss if the judge accepts none that could be
    among the first k if the undecided ones are not saved.
    """
    extra = {"block_rows": block_rows} if block_rows else {}
    listed = 2 * k + 1

    def best(asked: DataFrame, entries: DataFrame, k: int) -> DataFrame:
        found = similarity_join(
            asked, entries, store_key="entry", query_seq="arrival", store_seq="seq",
            threshold=threshold, metric=metric, score=score, k=k, **extra,
        )
        marks = entries.select("entry", F.col("query_hash").alias("entry_hash"), F.col("text").alias("entry_text"), "saved")
        return cut(found.join(marks, "entry").join(asked.select("query_id", "query_hash", "text"), "query_id"))

    def entries_of(rows: DataFrame, kind: str, seq: Column, name: str, saved: bool) -> DataFrame:
        key = F.concat(F.lit(kind), F.col(name).cast("string"))
        return rows.select(key.alias("entry"), "query_hash", "text", "embedding", seq.cast("bigint").alias("seq"), F.lit(saved).alias("saved"))

    # Lists and verdicts go by a text's digest; the texts themselves are joined to new pairs only.
    texts = cut(queries.select("query").unionByName(store.select("query")).select(_digest("query").alias("text"), "query").dropDuplicates(["text"]))
    rows = cut(
        queries.select("query_id", F.col("arrival").cast("bigint").alias("arrival"), "query_hash", _digest("query").alias("text"), "embedding")
        .join(store.select("query_hash", F.lit(True).alias("_stored")), "query_hash", "left")
    )
    base = cut(entries_of(store.withColumn("text", _digest("query")), "s", F.lit(-1), "query_hash", True))
    verdicts = _Verdicts(judge, judge_threshold, texts)
    waiting = cut(rows.where(F.col("_stored").isNull()).drop("_stored"))
    parts = _parts(waiting, LET_IN)
    undecided, leaders, sure = waiting.limit(0), waiting.limit(0), []
    while parts or undecided.take(1):
        if parts and undecided.count() <= FEW_LEFT * LET_IN:
            let_in = waiting.where(parts.pop(0)).join(leaders.select("query_hash").distinct(), "query_hash", "left_anti")
            undecided = cut(undecided.unionByName(let_in))
            continue
        placed = cut(undecided.withColumn("_at", F.min(F.struct("arrival", "query_id")).over(Window.partitionBy("query_hash", "text", "embedding"))))
        firsts = placed.select("query_hash", "text", "embedding", "_at.*").dropDuplicates(["query_hash", "text", "embedding"])
        open_ = entries_of(firsts, "u", F.col("arrival"), "query_id", False)
        entries = cut(base.unionByName(entries_of(leaders, "l", F.col("arrival"), "query_hash", True)).unionByName(open_))
        lists = verdicts.of(best(undecided, entries, listed))
        settled = cut(_settled(placed, lists, k, listed))
        sure.append(settled.where("match IS NOT NULL").select("query_id", "match"))
        new = cut(undecided.join(settled.where("miss").select("query_id"), "query_id", "left_semi"))
        leaders = cut(leaders.unionByName(new))
        left = undecided.join(settled.select("query_id"), "query_id", "left_anti")
        undecided = cut(left.join(new.select("query_hash").distinct(), "query_hash", "left_anti"))

    saved = leaders.select("query_hash", F.col("arrival").alias("_saved"))
    placed = rows.join(saved, "query_hash", "left")
    exact = F.coalesce(F.col("_stored").isNotNull() | (F.col("arrival") > F.col("_saved")), F.lit(False))
    first = F.coalesce(F.col("arrival") == F.col("_saved"), F.lit(False))
    # Only queries behind one that might still have been saved when they were settled walk their rows once more.
    asked = placed.where(~exact & ~first).drop("_stored", "_saved")
    if sure:
        asked = asked.join(reduce(DataFrame.unionByName, sure).select("query_id"), "query_id", "left_anti")
    walked = verdicts.of(best(cut(asked), cut(base.unionByName(entries_of(leaders, "l", F.col("arrival"), "query_hash", True))), k)).where("accepted")
    every = reduce(DataFrame.unionByName, [*sure, walked.select("query_id", _match().alias("match"))])
    match = every.groupBy("query_id").agg(F.min("match").alias("_match"))
    similar = ~exact & ~first
    return placed.join(match, "query_id", "left").select(
        "query_id",
        F.when(exact, "exact_hit").when(first, "miss").otherwise("similar_hit").alias("outcome"),
        F.when(exact, F.col("query_hash")).when(similar, F.col("_match.entry_hash")).alias("matched_hash"),
        F.when(similar, F.col("_match.score")).alias("similarity_score"), F.when(similar, F.col("_match.confidence")).alias("semantic_similarity"),
    )


def _parts(waiting: DataFrame, most: int) -> list[Column]:
    """Conditions that part the queries by arrival, ``most`` of them or about so many to each."""
    parts = max(1, math.ceil(waiting.count() / most))
    if parts == 1:
        return [F.lit(True)]
    bounds = waiting.agg(F.percentile_approx("arrival", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    part = F.coalesce(reduce(operator.add, [(F.col("arrival") > bound).cast("int") for bound in bounds], F.lit(0)), F.lit(0))
    return [part == i for i in range(len(bounds) + 1)]


def _match() -> Column:
    return F.struct("rank", "entry_hash", "score", "confidence")


def _settled(undecided: DataFrame, lists: DataFrame, k: int, listed: int) -> DataFrame:
    """(query_id, miss, match) of the undecided queries whose list leaves no doubt. ``match``: the row a query follows, unless an undecided one might come before.

    They are settled in one task, by arrival, and what a query turns out to be counts for those behind it: as many as are let in, whatever the input.
    """
    own = F.col("entry_hash") == F.col("query_hash")  # if that is saved, the query is an exact hit
    row = F.struct("rank", "saved", "accepted", F.when(~F.col("saved"), F.col("entry")).alias("open"), _match().alias("match"))
    walk = lists.groupBy("query_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(~own, row))).alias("list"))  # no more than ``listed``
    known = undecided.select("query_id", "arrival", "query_hash", F.concat(F.lit("u"), F.col("_at.query_id").cast("string")).alias("text_of")).join(walk, "query_id", "left")
    known = known.withColumn("list", F.coalesce("list", F.array().cast(walk.schema["list"].dataType)))
    out = T.StructType([*known.select("query_id", "list").schema, T.StructField("miss", T.BooleanType()), T.StructField("hit", T.BooleanType()), T.StructField("at", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = _Queue(k, listed)
        for batch in batches:
            found = queue.take(batch)
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate((pa.bool_(), pa.bool_(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("list"), *columns], names=out.names)

    told = known.repartition(1).sortWithinPartitions("arrival").mapInArrow(run, out)
    return told.where("miss OR hit").select("query_id", "miss", F.get("list", F.col("at"))["match"].alias("match"))


class _Queue:
    """Settles queries one after another; those that are in doubt stay undecided."""

    def __init__(self, k: int, listed: int):
        self.k, self.listed = k, listed
        # By hash the first arrival that is saved or in doubt; whether a query that stands for its text and vector is saved, or None if one of these is in doubt.
        self.saved, self.doubted, self.kept = {}, {}, {}

    def take(self, batch: pa.RecordBatch) -> list[tuple]:
        """(miss, hit, place of the row it follows in its list) of each."""
        lists = batch.column("list")
        ends, rows = lists.value_lengths().to_numpy().cumsum().tolist(), lists.flatten()
        saved, accepted, opened = (rows.field(name).to_pylist() for name in ("saved", "accepted", "open"))
        queries = zip(*(batch.column(name).to_pylist() for name in ("arrival", "query_hash", "text_of", "n")), [0, *ends], ends)
        return [self._next(*query[:4], [*zip(saved[query[4]:query[5]], accepted[query[4]:query[5]], opened[query[4]:query[5]])]) for query in queries]

    def _next(self, arrival, key, text_of, n, entries) -> tuple:
        def before(arrivals: dict) -> bool:
            return key is not None and arrival is not None and arrivals.get(key, arrival) < arrival

        if before(self.saved):  # an exact hit
            self.kept.setdefault(text_of, False)
            return False, False, None
        place, ahead, hit, open_, doubt, at = 0, 0, False, False, False, None
        for i, (saved, accepted, other) in enumerate(entries):
            if not saved:
                saved = self.kept.get(other)
                if saved is False:
                    continue
            if accepted:
                if saved and place < self.k:
                    hit, at = True, i if at is None and not doubt else at
                open_, doubt = open_ or ahead < self.k, doubt or not saved
            place, ahead = place + 1, ahead + bool(saved)
        whole = n is None or n < self.listed or ahead >= self.k
        miss = whole and not open_ and not before(self.doubted)
        if miss:
            # Where an earlier query of the text and vector is none, its place in the lists is not that of this one.
            self.kept[text_of] = None if text_of in self.kept else True
            self.saved.setdefault(key, arrival)
        elif hit:
            self.kept.setdefault(text_of, False)
        else:
            self.kept[text_of] = None
            self.doubted.setdefault(key, arrival)
        return miss, hit, at


def _digest(query: str) -> Column:
    """128 bits that stand for a text; those of a null text are none."""
    return F.coalesce(F.unhex(F.md5(F.col(query))), F.lit(b"")).alias("text")


class _Verdicts:
    """What the judge said about pairs of texts; every pair is asked about once."""

    def __init__(self, judge: TextHook, threshold: float, texts: DataFrame):
        self.hook, self.threshold, self.texts, self.known = text_hook(judge), threshold, texts, []

    def of(self, lists: DataFrame) -> DataFrame:
        """``lists`` (text, entry_text: digests of ``texts``, and others) with ``accepted`` and ``confidence``."""
        pair = ["text", "entry_text"]
        # Written, so that the few pairs of a late round go to what is known, and not the other way round.
        pairs = cut(lists.select(*pair).distinct())
        told = [cut(reduce(DataFrame.unionByName, self.known).join(pairs, pair, "left_semi"))] if self.known else []
        new = pairs.join(told[0], pair, "left_anti") if told else pairs
        entry = self.texts.select(F.col("text").alias("entry_text"), F.col("query").alias("entry_query"))
        asked = cut(new.join(self.texts, "text").join(entry, "entry_text")).withColumn("_reply", self.hook(F.col("query"), F.col("entry_query")))
        said = asked.withColumn("_said", parse_verdict(F.col("_reply.reply"), F.col("_reply.error")))
        self.known.append(cut(said.select(*pair, accepts(F.col("_said"), self.threshold).alias("accepted"), F.col("_said.confidence").alias("confidence"))))
        return cut(lists.join(reduce(DataFrame.unionByName, [*told, self.known[-1]]), pair))
