"""N-gram Jaccard join by multiple-global-order filtering, and the classes that its links make.

Two sets can only be as alike as the threshold asks if they share a token of their prefixes, whatever total order the tokens are sorted by. Several
orders are used. All put tokens that are common in the corpus last, by a table of counts of fixed size; among
equally common ones each has its own random order. Pairs meet in the first order's buckets, and must also share a token
under every other order, and as many as linked sets of their sizes must share, before their whole sets are compared.

Texts with equal sets are one vertex. Links within a bucket are not all enumerated: every vertex is first
compared with up to four leaders of the bucket (in small buckets those are all pairs), and what this settles (same component, or too far apart by the triangle inequality, which
Jaccard distance obeys) is not compared again. No link between components is lost. Where links are counted, all pairs of a bucket that the
filters leave are settled instead, those inside a component too.

Tokens and sets are 64-bit hashes; two different ones share a value with a chance of one in 2^64.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from querymill.llm.arrow import with_columns
from querymill.llm.components import components
from querymill.llm.words import chunks, mix, shingle_set, words_of
from querymill.session import Scratch

COUNT_BITS = 21  # the table of counts has 2^21 places, whatever the corpus
COUNT_BLOCK = 1 << 13
COUNT_AT_ONCE = 1 << 21
SMALL = 200_000  # rows of two numbers that are broadcast, at most: a few megabytes
HAND = 32  # members of a bucket that are compared with one another at a time
FILTER_BITS = 1 << 23  # of the bitmap of rows whose sets are needed
CROWDED_BITS = 1 << 26  # of the bitmap of tokens that several vertices have
SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


class Rule(NamedTuple):
    """Sets link when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    orders: int = 3

    def prefix(self, n: int) -> int:
        """Tokens that cannot all be missing from a set that links with one of size n."""
        return n - -(-n * self.percent // 100) + 1


def _sets(chunk, words: int) -> Iterator[np.ndarray]:
    found = words_of(chunk, fold=True)
    for a, b in zip(found.first, found.first[1:]):
        yield shingle_set(found.hashes[a:b], words)


def _key(shingles: np.ndarray) -> int:
    """A set's own hash."""
    total = mix(np.array([shingles.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(shingles)), len(shingles)], np.uint64))
    return int(mix(total[:1] + total[1:2] * np.uint64(3) + total[2:] * np.uint64(5)).view(np.int64)[0])


def with_sets(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` (text and others) without text, with set_size and set_key (null if the text has no words)."""

    def make(batches):
        for (texts,) in batches:
            sizes, keys = [], []
            for chunk in chunks(texts):
                for s in _sets(chunk, words):
                    sizes.append(len(s))
                    keys.append(_key(s) if len(s) else None)
            yield [pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())]

    return with_columns(docs, ["text"], [("set_size", "long"), ("set_key", "long")], make, without=["text"])


def commonness(docs: DataFrame, words: int) -> np.ndarray:
    """How common the tokens at each place of the table are: 0, or the logarithm of the count beyond what chance would put there.

    Each task counts all its tokens and hands on its table in blocks; blocks are added up in the shuffle. Only the
    finished table, of fixed size, reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting, many = np.zeros(1 << COUNT_BITS, np.uint32), [], 0

        def add_up():
            places, counts = np.unique(np.concatenate(waiting), return_counts=True)
            table[places] += counts.astype(np.uint32)

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                waiting += [(s >> np.uint64(64 - COUNT_BITS)).astype(np.uint32) for s in _sets(chunk, words)]
                many += len(chunk.data)
                if many > COUNT_AT_ONCE * 8:
                    add_up()
                    waiting, many = [], 0
        if waiting:
            add_up()
        for block, counts in enumerate(table.reshape(-1, COUNT_BLOCK)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts.astype(_narrow(counts)).tobytes()])], names=["block", "counts"])

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = np.zeros(COUNT_BLOCK, np.int64), None
        for batch in tables:
            block = batch.column(0)[:1]
            for counts in batch.column(1).to_pylist():
                total += np.frombuffer(counts, f"<u{len(counts) // COUNT_BLOCK}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([block, pa.array([total.tobytes()])], names=["block", "counts"])

    schema = "block int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect()
    table = np.zeros(1 << COUNT_BITS, np.int64)
    for block, counts in rows:
        table[block * COUNT_BLOCK:(block + 1) * COUNT_BLOCK] = np.frombuffer(counts, np.int64)
    usual = table.mean()
    beyond = table - (usual + 4 * np.sqrt(usual))
    return np.where(beyond > 0, 1 + np.log2(1 + np.maximum(beyond, 0)), 0).astype(np.uint8)


def _narrow(counts: np.ndarray) -> str:
    return next(f"<u{size}" for size in (1, 2, 4, 8) if counts.max() < 1 << 8 * size)


def _prefix(shingles: np.ndarray, order: int, common: np.ndarray, rule: Rule) -> np.ndarray:
    """The first tokens of a set in one of the orders, in that order."""
    rank = (mix(shingles ^ np.uint64(SALTS[order])) >> np.uint64(8)) | (common[shingles >> np.uint64(64 - COUNT_BITS)].astype(np.uint64) << np.uint64(56))
    k = rule.prefix(len(shingles))
    first = np.arange(len(rank)) if k >= len(rank) else np.argpartition(rank, k - 1)[:k]
    return shingles[first[np.argsort(rank[first])]]


def _meetings(docs: DataFrame, common, rule: Rule) -> DataFrame:
    """(token, v, n, pos): every vertex, with its size, by the prefix tokens of its set in the first order and their places from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                sets = [s for s in _sets(chunk, rule.words) if len(s)]
                if sets:
                    tokens = [_prefix(s, 0, common.value, rule) for s in sets]
                    lengths = [len(t) for t in tokens]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.repeat(np.array([_key(s) for s in sets], np.int64), lengths)),
                        pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), lengths)),
                        pa.array(np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in lengths])),
                    ], names=["token", "v", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, v long, n int, pos int")


def classes(scratch: Scratch, docs: DataFrame, rule: Rule = Rule(), count_links: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, row (a hash of id and text), and stays.

    With ``count_links`` also n_links: how many other sets, each once however many texts have it, the text's set links with.

    component_id is the smallest doc_id that links reach. Texts without words, null ones among them, are linked with nothing: each
    is a component of its own. A row without an id keeps its links: its component_id is that of its component, or null if
    no row of it has an id. Rows that share an id are rows like any others. Words are folded A-Z. ``stays`` marks one text
    of each component: that with the smallest id, of several the one that hashes lowest.
    """
    texts = docs.select("doc_id", "text")
    seen = scratch.cut(with_sets(texts.withColumn("row", F.xxhash64("doc_id", "text")), rule.words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    vertices = scratch.cut(seen.where("set_key IS NOT NULL").groupBy(F.col("set_key").alias("v")).agg(first.alias("first")))
    linked = links(scratch, texts, vertices.select("v", "first.row"), rule, every=count_links)
    roots = scratch.cut(components(scratch, linked))
    rooted = scratch.cut(vertices.join(roots, F.col("v") == F.col("node"), "left").select("v", "first", F.coalesce("root", "v").alias("root")))
    chosen = scratch.cut(rooted.groupBy("root").agg(F.min("first").alias("chosen")))
    # Written, so that the rows of a large class or component can be split in the joins.
    named = scratch.cut(rooted.select("v", "root").join(chosen, "root").select("v", "chosen"))
    counted = []
    if count_links:
        ends = linked.select(F.col("a").alias("v")).unionByName(linked.select(F.col("b").alias("v")))
        named = scratch.cut(named.join(scratch.cut(ends.groupBy("v").agg(F.count("*").alias("n_links"))), "v", "left"))
        counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    alone = F.col("set_key").isNull()
    return seen.join(named, F.col("set_key") == F.col("v"), "left").select(
        "doc_id", F.col("set_size").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("chosen.doc_id")).alias("component_id"),
        "row", (alone | (F.col("row") == F.col("chosen.row"))).alias("stays"), *counted,
    )


def one_of_each(scratch: Scratch, docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with one row for each component, the one that ``classes`` marks.

    Of rows with one id and one text, one stays. Texts without words all stay but for such repeats.
    """
    names, row = docs.columns, "row of jaccard_join"
    staying = classes(scratch, docs, rule).where("stays").select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, F.xxhash64("doc_id", "text")).join(staying, row, "left_semi").dropDuplicates([row]).select(*[f"`{n}`" for n in names])


def links(scratch: Scratch, texts: DataFrame, vertices: DataFrame, rule: Rule, every: bool = False) -> DataFrame:
    """(a, b): links between vertices, each once: enough of them to connect every two that links connect, or every one."""
    common = texts.sparkSession.sparkContext.broadcast(commonness(texts, rule.words))  # 2^21 bytes
    meetings = scratch.cut(_meetings(texts, common, rule))
    # Most tokens have a single vertex; they go before anything but two numbers of each is shuffled.
    crowded = scratch.cut(meetings.groupBy("token").agg(F.min("v").alias("x"), F.max("v").alias("y")).where("x <> y").select("token"))
    # Equal texts bring equal rows; one of each goes on.
    inside = scratch.cut(_perhaps(meetings, "token", _bitmap(crowded, "token", CROWDED_BITS)).join(crowded, "token", "left_semi").distinct())
    scratch.drop(meetings, crowded)
    one, by = F.struct("v", "n", "pos"), F.xxhash64("v")
    shared = inside.groupBy("token").agg(F.min(one).alias("x"), F.max(one).alias("y"), F.min_by(one, by).alias("z"), F.max_by(one, by).alias("w"), F.count("*").alias("members"))
    # Written, so that the members of a large bucket can be split in the join.
    shared = scratch.cut(shared.select("token", F.col("x.v").alias("leader"), F.array_distinct(F.array("x", "y", "z", "w")).alias("leaders"), "members"))
    # With at most one member that does not lead, all pairs of a bucket are those with a leader.
    met = scratch.cut(inside.join(shared, "token").select("token", "v", "n", "pos", "leader", "leaders", (F.col("members") > F.size("leaders") + 1).alias("more")))
    scratch.drop(inside, shared)

    led = met.select("v", "n", "pos", F.explode("leaders").alias("to")).where("v <> to.v").where(_fits(rule, "n", "to.n", "pos", "to.pos"))
    stars = scratch.cut(led.select(F.least("v", "to.v").alias("a"), F.greatest("v", "to.v").alias("b")).distinct())
    compared = _compare(scratch, stars, texts, vertices, common, rule)
    known = compared.where("d IS NOT NULL").select(F.col("a").alias("leader"), F.col("b").alias("v"), "d")
    placed = scratch.cut(
        met.where("more").select("token", "v", "n", "pos", "leader").join(known, ["leader", "v"], "left")
        .select("token", "v", "n", "pos", F.when(F.col("v") == F.col("leader"), 0.0).otherwise(F.col("d")).alias("d"))
    )
    scratch.drop(met)
    if every:
        pairs = _within(scratch, placed, compared, rule)
        new = scratch.cut(pairs.where("NOT sure").select("a", "b"))
        more = _compare(scratch, new, texts, vertices, common, rule)
        return scratch.cut(compared.unionByName(more).where("linked").select("a", "b").unionByName(pairs.where("sure").select("a", "b")))
    # Twice every member is first compared with a few others of its buckets, which joins most of what links join; then all that may still link.
    for sampled in (1, 2, 0):
        pairs, placed = _across(scratch, placed, compared, rule, sampled)
        new = scratch.cut(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"))
        compared = scratch.cut(compared.unionByName(_compare(scratch, new, texts, vertices, common, rule)))
    return compared.where("linked").select("a", "b")


def _within(scratch: Scratch, placed: DataFrame, compared: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, sure): all pairs of members (token, v, n, pos, d) of a bucket that are not compared yet and may link, by sizes, places and the distances from their leaders.

    ``sure``: they do link, as both lie so near one leader that the triangle inequality leaves no doubt.
    """
    side = [placed.select("token", F.col("v").alias(s), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), F.col("d").alias(f"d{s}")) for s in "ab"]
    reach = 1 - rule.percent / 100
    fits = side[0].join(side[1], "token").where("a < b").where(_fits(rule, "na", "nb", "pa", "pb"))
    pairs = fits.groupBy("a", "b").agg(F.max(F.expr("abs(da - db)")).alias("least"), F.min(F.expr("da + db")).alias("most"))
    pairs = pairs.where(f"coalesce(least <= {reach + 1e-9}, true)").select("a", "b", F.expr(f"coalesce(most <= {reach - 1e-9}, false)").alias("sure"))
    return scratch.cut(pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"))


def _across(scratch: Scratch, placed: DataFrame, compared: DataFrame, rule: Rule, sampled: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of members of a bucket that lie in different components and may link, by their sizes and their distances d from the leader.

    ``sampled``: not all of them; a bucket is dealt, by a hash of that number, into hands of about HAND members, and pairs come from within a hand.
    The second table has the members, as ``placed`` has, of the buckets in which several components meet: components only grow, so the others are done.
    """
    roots = scratch.cut(components(scratch, compared.where("linked").select("a", "b")))
    rooted = scratch.cut(placed.select("token", "v", "n", "pos", "d").join(roots, F.col("v") == F.col("node"), "left").select("token", "v", "n", "pos", F.coalesce("root", "v").alias("root"), "d"))
    # Where only one component meets, nothing is left to compare.
    mixed = scratch.cut(rooted.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token"))
    open_ = scratch.cut(rooted.join(mixed, "token", "left_semi"))
    scratch.drop(placed, rooted)
    reach, p = 1 - rule.percent / 100 + 1e-9, rule.percent
    if sampled:
        hands = scratch.cut(open_.groupBy("token").agg(F.greatest(F.lit(1), F.floor(F.count("*") / HAND)).alias("hands")))
        dealt = open_.join(hands, "token").withColumn("hand", F.pmod(F.xxhash64(F.lit(sampled), "token", "v"), F.col("hands")))
        side = [dealt.select("token", "hand", F.col("root").alias(f"r{s}"), F.col("v").alias(s), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), F.col("d").alias(f"d{s}")) for s in "ab"]
        met_twice = side[0].join(side[1], ["token", "hand"]).where("ra < rb")
    else:
        groups = scratch.cut(open_.groupBy("token", "root").agg(
            F.min("pos").alias("p0"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min(F.coalesce("d", F.lit(0.0))).alias("d0"), F.max(F.coalesce("d", F.lit(1.0))).alias("d1"),
        ))
        x, y = groups.alias("x"), groups.alias("y")
        may = scratch.cut(x.join(y, F.expr(
            f"x.token = y.token AND x.root < y.root AND 100 * x.n1 >= {p} * y.n0 AND 100 * y.n1 >= {p} * x.n0 AND x.d0 <= y.d1 + {reach} AND y.d0 <= x.d1 + {reach} "
            f"AND (100 + {p}) * (x.n1 + 1 - x.p0) >= {p} * (x.n0 + y.n0) AND (100 + {p}) * (y.n1 + 1 - y.p0) >= {p} * (x.n0 + y.n0)"
        )).select(F.expr("x.token AS token"), F.expr("x.root AS ra"), F.expr("y.root AS rb")))
        side = [open_.select("token", F.col("root").alias(f"r{s}"), F.col("v").alias(s), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), F.col("d").alias(f"d{s}")) for s in "ab"]
        met_twice = may.join(side[0], ["token", "ra"]).join(side[1], ["token", "rb"])
    fits = met_twice.where(_fits(rule, "na", "nb", "pa", "pb")).where(f"coalesce(abs(da - db) <= {reach}, true)")
    return fits.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), open_


def _fits(rule: Rule, n: str, m: str, i: str, j: str) -> str:
    """Whether sets of n and m tokens may link through a token that is i-th of the one and j-th of the other.

    Linked sets share at least p * (n + m) / (100 + p) tokens; before the first that they share neither has more than it can spare.
    """
    p = rule.percent
    return (
        f"100 * {n} >= {p} * {m} AND 100 * {m} >= {p} * {n} "
        f"AND (100 + {p}) * ({n} + 1 - {i}) >= {p} * ({n} + {m}) AND (100 + {p}) * ({m} + 1 - {j}) >= {p} * ({n} + {m})"
    )


def _bitmap(keys: DataFrame, column: str, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits with those of the keys' remainders set."""
    at = F.pmod(column, F.lit(size)) + 1  # positions of bitmaps begin at 1
    made = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for bucket, part in made.collect():
        low = (bucket - 1) * len(part)
        bits[low:low + len(part)] = np.frombuffer(part, np.uint8)[:len(bits) - low]
    return bits


def _marked(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the keys whose bit is set."""
    place = keys % (8 * len(bits))
    return np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)


def _perhaps(rows: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows whose key may be one of those of a bitmap: all that are, and few others as long as the bitmap has room."""
    carried = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _marked(batch.column(column).to_numpy(), carried.value)
            if len(keep):
                yield batch.take(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


def _whole_sets(texts: DataFrame, wanted: DataFrame, common, rule: Rule) -> DataFrame:
    """(v, n, orders, tokens) of the wanted vertices, by the row that stands for each.

    ``orders`` holds, for each order, 16 bits of every prefix token. A bitmap of 2^23 bits, whatever the corpus, spares the
    shuffle most rows that no vertex wants.
    """
    bits = _bitmap(wanted, "row", FILTER_BITS)
    carried = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            keep = _marked(rows, carried.value)
            if not len(keep):
                continue
            kept = batch.take(pa.array(keep))
            for chunk in chunks(kept.column(1)):
                found = [(r, s) for r, s in zip(rows[keep[chunk.low:chunk.high]], _sets(chunk, rule.words)) if len(s)]
                orders = [[np.sort(_prefix(s, k, common.value, rule).astype(np.uint16)).tobytes() for k in range(rule.orders)] for _, s in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(r) for r, _ in found], pa.int64()), pa.array([_key(s) for _, s in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int32()),
                    pa.array(orders, pa.list_(pa.binary())), pa.array([s.tobytes() for _, s in found], pa.binary()),
                ], names=["row", "v", "n", "orders", "tokens"])

    keyed = texts.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    return keyed.mapInArrow(run, "row long, v long, n int, orders array<binary>, tokens binary").join(_carried(wanted), ["row", "v"]).drop("row")


def _carried(pairs: DataFrame) -> DataFrame:
    """A written table of two numbers a row: broadcast if it has no more than SMALL rows, which spares the shuffle of whole sets; else as it is."""
    return F.broadcast(pairs) if pairs.count() <= SMALL else pairs


def _compare(scratch: Scratch, pairs: DataFrame, texts: DataFrame, vertices: DataFrame, common, rule: Rule) -> DataFrame:
    """(a, b, d, linked) of pairs (a, b): d is the Jaccard distance, null where a filter already parts them.

    The filters of all orders are intersected on the prefixes alone; only pairs that pass them all are joined with their
    whole sets. Each pair comes with both sides, so a vertex in many pairs is split among tasks. ``pairs`` is read more than once.
    """
    ends = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    wanted = scratch.cut(vertices.join(ends, "v", "left_semi").select("v", "row"))
    sets = scratch.cut(_whole_sets(texts, wanted, common, rule))

    def with_both(pairs, *names):
        carried = _carried(pairs)
        a, b = (carried.join(sets.select(F.col("v").alias(s), *[F.col(n).alias(f"{n}_{s}") for n in names]), s) for s in "ab")
        return a.join(b, ["a", "b"])

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist())
            orders = zip(batch.column("orders_a").to_pylist(), batch.column("orders_b").to_pylist())
            passed = [_may_link(n, m, x, y, rule) for (n, m), (x, y) in zip(sizes, orders)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(passed, pa.bool_())], names=["a", "b", "passed"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("tokens_a"), batch.column("tokens_b")
            distances, linked = [], []
            for i in range(len(batch)):
                x, y = (np.frombuffer(side[i].as_buffer(), np.uint64) for side in (left, right))
                both = _shared(x, y)
                union = len(x) + len(y) - both
                distances.append(1 - both / union)
                linked.append(100 * both >= rule.percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(distances, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "d", "linked"])

    sifted = scratch.cut(with_both(pairs, "n", "orders").mapInArrow(sift, "a long, b long, passed boolean"))
    passed = scratch.cut(sifted.where("passed").select("a", "b").distinct())
    verified = with_both(passed, "tokens").select("a", "b", "tokens_a", "tokens_b").mapInArrow(verify, "a long, b long, d double, linked boolean")
    parted = sifted.where("NOT passed").select("a", "b", F.lit(None).cast("double").alias("d"), F.lit(False).alias("linked"))
    compared = scratch.cut(verified.unionByName(parted).distinct())
    scratch.drop(sets, wanted, sifted)
    return compared


def _may_link(n: int, m: int, x: list[bytes], y: list[bytes], rule: Rule) -> bool:
    """Whether prefixes of sets of n and m tokens share as many tokens under every order as those of linked sets must.

    Linked sets share at least t = percent * (n + m) / (100 + percent) tokens. Take the prefix that ends first in the order: of its tokens no
    more are missing from the other set than its own set has beyond t, and the ones that are in the other set are in the other's prefix.
    """
    p, small, large = rule.percent, min(n, m), max(n, m)
    if 100 * small < p * large:
        return False
    needed = -(-p * (n + m) // (100 + p)) - -(-p * large // 100) + 1
    return all(_shared(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)) >= needed for a, b in zip(x, y))


def _shared(sorted_: np.ndarray, other: np.ndarray) -> int:
    at = np.searchsorted(sorted_, other)
    at[at == len(sorted_)] = 0
    return int(np.count_nonzero(sorted_[at] == other))


