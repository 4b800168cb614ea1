"""Byte-level BPE encoding and decoding by higher-order functions.

A word is folded over its array of byte strings: each step merges the leftmost pair of lowest rank, which one constant map of ranks
tells, and looks up only the two pairs that this changes. Decoding puts the pieces of the ids together. No Python runs on
the rows.

Words repeat by Zipf's law, so the corpus is counted first, and each of its most frequent words is folded once, into a second
constant map of bounded size; the rest are folded where they stand. That map saves time only: it changes no result.
"""

import base64
import json
import zlib
from copy import copy

from pyspark.sql import Column, DataFrame, functions as F

from querymill.session import cut

FREQUENT = 1 << 17  # words in the map of frequent ones
NO_RANK = (1 << 31) - 1
ONE_BYTE = "ISO-8859-1"  # bytes are held as characters of this set: keys of Spark's literal maps are strings
# The vocabularies' pattern with common beginnings joined; (?U) makes white space Unicode's. A fixed value.
PATTERN = r"(?U)'(?:[stmd]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+(?!\S)|\s+"


def words(text: Column) -> Column:
    """Matches of the pattern in a text, in order: together the whole of it. A null text has none.

    Letters and numbers are those of the JVM's Unicode version (13 in Java 17); newer ones count as signs.
    """
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def as_bytes(word: Column) -> Column:
    """The UTF-8 bytes of a word, written as a string with a character for each."""
    return F.decode(word.cast("binary"), ONE_BYTE)


def read_ranks(path: str) -> dict[str, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token).decode(ONE_BYTE): int(rank) for token, rank in map(bytes.split, lines)}


def _constant(value, kind: str) -> Column:
    """One value that the optimizer folds into a literal of the query."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


class Lookup:
    """A literal map, parted by checksum, because a map of Spark is searched from its beginning."""

    def __init__(self, entries: dict[str, object], kind: str, bits: int = 14):
        self.mask = (1 << bits) - 1
        parts: list[dict] = [{} for _ in range(1 << bits)]
        for key, value in entries.items():
            parts[zlib.crc32(key.encode()) & self.mask][key] = value
        self.parts = _constant(parts, f"array<map<string,{kind}>>")

    def __getitem__(self, key: Column) -> Column:
        part = F.get(self.parts, F.crc32(key.cast("binary")).bitwiseAND(F.lit(self.mask)).cast("int"))
        return F.element_at(part, key)

    def once(self, kind: str, body) -> Column:
        """``body`` (of type ``kind``) of this map, the literal of which stands in the plan once, however often it is asked."""

        def bound(parts: Column) -> Column:
            named = copy(self)
            named.parts = parts
            return body(named)

        return _let(self.parts, kind, bound)


def _let(value: Column, kind: str, body) -> Column:
    """``body``, of type ``kind``, of a value that is worked out once. An element of a transformed array would do, but asks for its type through the whole body on every row."""
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def fold(word: Column, ranks: Lookup) -> Column:
    """Ids of a word (its bytes as characters), as an array of int. Steps are as many as merges, each as long as the word then is.

    A piece is one number, the rank of what it makes with the next piece before its own start, so that the least number is the leftmost pair of lowest
    rank. Two pieces of nothing stand at the end.
    """
    size, unknown = F.length(word), F.lit(NO_RANK << 32)

    def piece(start: Column, end: Column) -> Column:
        return F.shiftleft(F.coalesce(ranks[F.substring(word, start + 1, end - start)], F.lit(NO_RANK)).cast("long"), 32) + start

    def low(piece: Column) -> Column:
        return piece.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")

    def step(pieces: Column, _: Column) -> Column:
        lowest = F.array_min(pieces)

        def start(i: Column) -> Column:
            return low(F.get(pieces, i))

        def merge(i: Column) -> Column:
            after = start(i + 1)
            before = F.when(i > 1, F.array(piece(start(i - 2), after))).otherwise(none)
            own = F.when(after < size, piece(start(i - 1), start(i + 2))).otherwise(unknown + start(i - 1))
            return F.concat(F.slice(pieces, 1, F.greatest(i - 2, F.lit(0))), before, F.array(own), F.slice(pieces, i + 2, F.size(pieces)))

        return F.when(lowest >= unknown, pieces).otherwise(_let(low(lowest), "array<long>", lambda at: _let(1 + F.size(F.filter(pieces, lambda p: low(p) < at)), "array<long>", merge)))

    none = F.array().cast("array<long>")
    single = F.transform(F.sequence(F.lit(0), size - 2), lambda i: piece(i, i + 2))
    ends = [unknown + size - 1, unknown + size, unknown + size]
    # Words are mostly frequent or whole tokens; the fold is for the rest. Single bytes are tokens.
    last = F.aggregate(F.sequence(F.lit(2), size), F.concat(single, F.array(*ends)), step)
    starts = F.transform(last, low)
    folded = _let(starts, "array<int>", lambda s: F.transform(F.slice(s, 1, F.size(s) - 2), lambda p, i: ranks[F.substring(word, p + 1, F.get(s, i + 1) - p)]))
    return _let(ranks[word], "array<int>", lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(folded))


def frequent(docs: DataFrame, ranks: Lookup, most: int = FREQUENT) -> dict[str, list[int]]:
    """Ids of the most frequent words of all texts, none of them long, at most ``most``: no more than that reaches the driver.

    Words of one class of counts (a 16th of a power of two) are in or out together, so that which they are is told from the sizes of the classes.
    """
    counted = docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    often = F.floor(16 * F.log2("n")).cast("int").alias("often")
    held = cut(counted.where("n > 1").where(F.length("word") <= 64).select("word", often))
    least = None
    for row in held.groupBy("often").count().orderBy(F.desc("often")).collect():  # at most 16 for each power of two
        most -= row["count"]
        if most < 0:
            break
        least = row["often"]
    if least is None:
        return {}
    top = held.where(F.col("often") >= least).select("word").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    return {r["word"]: r["ids"] for r in top.select("word", ranks.once("array<int>", lambda r: fold(as_bytes(F.col("word")), r)).alias("ids")).collect()}


def with_ids(docs: DataFrame, path: str, most: int = FREQUENT) -> DataFrame:
    """``docs`` (text and any others) with ``ids``, an array of int: the ids of each whole text by the ranks at ``path``; none for a null or empty text.

    An own column of that name is replaced. One word's cost grows with the square of its length.
    """
    ranks = Lookup(read_ranks(path), "int")
    known = Lookup(frequent(docs, ranks, most), "array<int>")

    def ids(known: Lookup, ranks: Lookup) -> Column:
        return F.transform(words(F.col("text")), lambda w: F.coalesce(known[w], _let(as_bytes(w), "array<int>", lambda b: fold(b, ranks))))

    kind = "array<array<int>>"
    return docs.withColumn("ids", F.flatten(known.once(kind, lambda k: ranks.once(kind, lambda r: ids(k, r)))))


def decoded(ids: Column, path: str) -> Column:
    """The bytes that ids stand for: their pieces one after another."""
    ranks = read_ranks(path)
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    shown = _constant(pieces, "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(shown, i)), ""), ONE_BYTE)


def written(ids: Column, size: int) -> Column:
    """Ids below ``size`` as little-endian unsigned 32-bit integers, one after another."""
    shown = _constant([i.to_bytes(4, "little").decode(ONE_BYTE) for i in range(size)], "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(shown, i)), ""), ONE_BYTE)


def encode_and_decode(docs: DataFrame, path: str, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs`` (doc_id, text); see ``with_ids``."""
    size = max(read_ranks(path).values()) + 1
    return with_ids(docs.select("doc_id", "text"), path, most).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written(F.col("ids"), size), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), path), 256).alias("decoded_sha256"),
    )
