"""The query feed as a stream: resolve and save, rolling counters, repeat suppression."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from querymill.operators.stats import stats_reference
from querymill.plans.answer import answer, ingest
from querymill.plans.resolve import resolve
from querymill.plans.tally import keep
from querymill.session import Scratch
from querymill.sources.store import _files, scan_store


def resolve_stream(
    feed: DataFrame,
    store_path: str,
    outcomes_path: str,
    links: DataFrame,
    pages: DataFrame,
    as_of: Callable[[], Column] = F.current_timestamp,
    model=None,
    **options,
) -> DataStreamWriter:
    """Resolve each micro-batch against the store as of its start, then save its answered misses.

    A batch first writes its outcomes under its number and then saves what they call a miss. A batch
    that is run again finds its outcomes and only repeats the save, which adds nothing twice.
    Start the returned writer with a ``checkpointLocation``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{outcomes_path}/batch_id={batch_id}"
        with Scratch(spark):  # nothing a batch sets aside outlives it
            if not _files(spark, target).exists(f"{target}/_SUCCESS"):
                resolve(batch, scan_store(spark, store_path), **options).write.mode("overwrite").parquet(target)
            misses = spark.read.parquet(target).where(F.col("outcome") == "miss").drop("message", "error")
            ingest(spark, store_path, answer(misses, links, pages, as_of(), model=model))

    return feed.writeStream.foreachBatch(run)


def tally_stream(outcomes: DataFrame, path: str, *group: str) -> DataStreamWriter:
    """Keep the counters of an outcome feed batch by batch, see ``plans.tally``."""
    return outcomes.writeStream.foreachBatch(lambda batch, batch_id: keep(batch, path, batch_id, *group))


def rolling_counters(
    outcomes: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "1 hour"
) -> DataFrame:
    """Counters per event-time window; rows later than the watermark are dropped."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = stats_reference(outcomes.withWatermark("ts", late), span.alias("window"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *[c for c in counted.columns if c != "window"],
    )


def end_of_feed(rows: DataFrame, after: str) -> DataFrame:
    """A single row with nothing but a time, ``after`` the last of ``rows``: a heartbeat that moves the watermark past them.

    Sent as the last batch of a feed that ends, with ``after`` longer than a window and the allowed lateness together, it lets all open windows come out; its own window
    stays open, and so never does.
    """
    ts = rows.schema["ts"].dataType
    last = rows.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts"))
    return last.select(*[(F.col("ts").cast(ts) if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema.fields])


def suppress_repeats(feed: DataFrame, horizon: str = "7 days") -> DataFrame:
    """One query of each hash until the watermark has passed it by the horizon; then the hash may come again.

    Every row reaches the watermark and the state: which rows are late, and when a hash may come again, depends on rows
    that are no longer first of their hash, so nothing can be cut before the shuffle. All rows of a hash meet in one task.
    """
    return feed.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["query_hash"])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SALTS = 16
# Groups that keys are dealt to before each has one of its own, and rows of a group that a task holds.
DEALT, HELD_ROWS = 64, 1 << 16


class FirstOfBatch(StatefulProcessor):
    """The earliest row of each ``key`` in a micro-batch, of those that are not late; keeps nothing.

    A group may hold many keys. With more of them than fit, a key's row may come out once for every HELD_ROWS of its group.
    """

    def __init__(self, key: str, order: list[str]):
        self.key, self.order = key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for part in rows:  # one Arrow batch at a time
            parts, held = [*parts, part], held + len(part)
            if held >= HELD_ROWS:
                firsts = self.firsts(parts)
                if 2 * len(firsts) > HELD_ROWS:
                    yield firsts
                    firsts = firsts.head(0)
                parts, held = [firsts], len(firsts)
        if held:
            yield self.firsts(parts)

    def firsts(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat([p for p in parts if len(p)]) if len(parts) > 1 else parts[0]
        return every if len(every) == 1 else every.sort_values(self.order, kind="stable").drop_duplicates(self.key)

    def close(self) -> None:
        pass


class OncePerHorizon(FirstOfBatch):
    """That row, unless one of the key came out whose timer has not gone off yet."""

    def __init__(self, key: str, order: list[str], horizon_ms: int):
        super().__init__(key, order)
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.out = handle.getValueState("out", "until long")

    def handleInputRows(self, key, rows, timerValues):
        if self.out.exists():
            for _ in rows:
                pass
            return
        firsts = list(super().handleInputRows(key, rows, timerValues))  # of a single key, one
        for first in firsts:
            micros = int(pd.Timestamp(first[self.order[0]].iloc[0]).value) // 1000
            until = -(-micros // 1000) + self.horizon_ms
            self.out.update((until,))
            self.handle.registerTimer(until)
            yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.out.clear()
        return iter([])


def suppress_repeats_timed(feed: DataFrame, horizon: str = "7 days", key: str = "query_hash", order: tuple[str, ...] = (), salts: int = SALTS) -> DataFrame:
    """As ``suppress_repeats``, with state and a timer of its own for each hash, and no hash whole in one task.

    Of the rows of a hash in a micro-batch the earliest that is not late comes out (ties by the columns of ``order``), and no other until the watermark has
    passed it by the horizon. Hashes are first dealt to DEALT groups, and the rows of each by their content to ``salts`` parts, each of which hands on one row of a hash per
    micro-batch (see ``FirstOfBatch``); so however often a hash is asked, the task that holds its state reads few rows of it, and only the hashes that are left cost a call and
    a look into the state. Late rows are told from the watermark that all rows move. ``ts`` is the event time. Needs the RocksDB state store, which this sets for the session;
    start the result in append mode.
    """
    spark = feed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    millis = int(spark.range(1).select((F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {horizon})") / 1000).cast("long")).first()[0])
    by = ["ts", *order]
    names = feed.columns
    dealt = F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int")
    salted = feed.withWatermark("ts", horizon).withColumns({"_salt": dealt, "_group": F.pmod(F.xxhash64(key), F.lit(DEALT)).cast("int")})
    few = salted.groupBy("_group", "_salt").transformWithStateInPandas(FirstOfBatch(key, by), feed.schema, "Append", "EventTime", eventTimeColumnName="ts")
    return few.groupBy(key).transformWithStateInPandas(OncePerHorizon(key, by, millis), feed.schema, "Append", "EventTime")
