"""Best-fit packing of token sequences by large-item matching.

Items over a third of the capacity lie at most two to a bin: the largest are matched greedily with the largest that
still fit beside them. The smaller items then go, largest first, into the tightest gaps that hold them. Lengths are whole
numbers up to the capacity, so the packing is worked out for the counts of each length, of which there are no more than the capacity, and
every item finds its place by its number among those of its length. Nothing else is gathered anywhere, and a
length that a third of all items have costs no more than any other.
"""

import functools
import re
import zlib
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from querymill.llm.arrow import with_columns
from querymill.session import Scratch

CAPACITY = 1024
END = 2  # id after each document


class Tokenizer(NamedTuple):
    """Files of one vocabulary: the tokenizer's own, and its ranks for the faster library."""

    path: str
    ranks: str
    pattern: str


# Printable ASCII and Latin-1 letters, marks and digits, whose classes no Unicode version changes.
PLAIN = re.compile("[\t\n\r -~\xa1-\xff]*")


@functools.lru_cache(maxsize=2)
def _encoder(files: Tokenizer):
    """Texts to ids, as the tokenizer's own library gives them.

    Plain texts go to the rank library, whose ids are the same and come several times faster; others, and those that
    hold a special string, to the tokenizer itself.
    """
    import base64

    import tiktoken
    import tokenizers

    own = tokenizers.Tokenizer.from_file(files.path)
    with open(files.ranks, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in own.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not any(s in text for s in special):
            return fast.encode_ordinary(text)
        return own.encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, files: Tokenizer, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``docs`` (text and any others) without text, a row for each piece: piece, start, length, ids_crc32, and its place among those of its length.

    A document is its ids and ``end``; a null or empty text is ``end`` alone. Only longer ones than the capacity are cut, the first
    piece taking what is left over. ``task`` and ``number`` say which piece of its length it is: the number counts within the task.
    Own columns of these names are replaced.
    """
    names = ["piece", "start", "length", "ids_crc32", "number"]

    def make(batches):
        encode, task, counts = _encoder(files), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for (texts,) in batches:
            rows = []
            for text in pc.fill_null(texts, ""):
                ids = np.array([*encode(text.as_py()), end], np.uint32)
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                found = []
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    found.append((i, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), int(counts[b - a])))
                    counts[b - a] += 1
                rows.append([dict(zip(names, f)) for f in found])
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
            yield [pa.array(rows, kind), pa.array(np.full(len(rows), task, np.int32))]

    listed = "array<struct<piece:long,start:long,length:long,ids_crc32:long,number:long>>"
    docs = docs.drop(*names)
    made = with_columns(docs, ["text"], [("pieces of packing", listed), ("task", "int")], make, without=["text"])
    kept = [f"`{n}`" for n in made.columns if n != "pieces of packing"]
    return made.select(*kept, F.explode("pieces of packing").alias("piece of packing")).select(*kept, *[F.col(f"piece of packing.{n}").alias(n) for n in names])


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(bins, lengths in them) for so many items of each length; there are at most a few times ``capacity`` entries."""
    left = defaultdict(int, counts)
    groups: list[tuple[int, list[int]]] = []
    large = sorted((n for n in counts if n * 3 > capacity), reverse=True)
    fits = set(large)
    for n in large:
        while left[n]:
            # The largest that fits beside it: there may be many of both.
            mate = next((m for m in range(min(n, capacity - n), capacity // 3, -1) if m in fits and left[m] > (m == n)), 0)
            k = left[n] if not mate else left[n] // 2 if mate == n else min(left[n], left[mate])
            groups.append((k, [n, mate] if mate else [n]))
            left[n] -= k
            if mate:
                left[mate] -= k
    gaps: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for k, inside in groups:
        gaps[capacity - sum(inside)].append((k, inside))
    for n in sorted((n for n in counts if n * 3 <= capacity), reverse=True):
        items = counts[n]
        while items:
            gap = next((g for g in range(n, capacity) if gaps[g]), capacity)
            k, inside = gaps[gap].pop() if gap < capacity else (items, [])
            each = min(gap // n, items)
            used = min(k, items // each)
            gaps[gap - each * n].append((used, inside + [n] * each))
            if used < k and inside:
                gaps[gap].append((k - used, inside))
            items -= used * each
    return [g for same in gaps.values() for g in same]


def pack(scratch: Scratch, placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``placed`` must be a table, not a plan that numbers the pieces anew each time it is read."""
    sizes = scratch.cut(placed.groupBy("task", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots, bins = defaultdict(list), 0
    used: dict[int, int] = defaultdict(int)
    for k, inside in plan(counts, capacity):
        offset = 0
        for n in inside:
            slots[n].append((used[n], bins, offset))
            used[n] += k
            offset += n
        bins += k
    tables = {n: np.array(rows, np.int64) for n, rows in slots.items()}
    carried = placed.sparkSession.sparkContext.broadcast(tables)  # bounded by the capacity, see plan()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = scratch.cut(sizes.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")))
    numbered = placed.join(starts, ["task", "length"]).withColumn("rank of packing", F.col("before") + F.col("number")).drop("before", "task", "number")

    def make(batches):
        for lengths, ranks in batches:
            lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                table = carried.value[n]
                row = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
                sequence[at], offset[at] = row[:, 1] + ranks[at] - row[:, 0], row[:, 2]
            yield [pa.array(sequence), pa.array(offset)]

    made = with_columns(numbered, ["length", "rank of packing"], [("sequence_id", "long"), ("offset", "long")], make, without=["rank of packing"])
    return made.select(*[f"`{n}`" for n in placed.columns if n not in ("task", "number")], "sequence_id", "offset")


def pack_documents(scratch: Scratch, docs: DataFrame, files: Tokenizer, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every document of ``docs`` (text and any others) as the pieces that ``pieces`` describes, each with its sequence_id and offset.

    Sequences hold at most ``capacity`` ids, pieces in them follow one another from 0 without gaps. Repeated rows are packed as often
    as they come; without rows there are no sequences. All other columns are kept, with their piece.
    """
    return pack(scratch, scratch.cut(pieces(docs, files, capacity, end)), capacity)
