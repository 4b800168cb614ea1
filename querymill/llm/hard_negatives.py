"""Hard-negative mining by exact inner products in a residue number system.

Components are whole numbers. Their matrices are taken modulo several small primes, multiplied in float32, where every sum stays below 2^24 and so is exact, and
the signed scores are put together from the remainders (Chinese remainders, digit by digit in mixed radix). As many primes are used as the largest possible score asks for.

Anchors meet all rows in a grid: anchors are dealt into groups that a task can hold, rows into shares, and each task takes one group and streams one
share past it, block by block. It keeps the best few of every anchor, so what leaves a task depends on its anchors alone. The first pass finds the positives, the
second the negatives in the window of scores that each positive opens.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from querymill.session import Scratch

HELD = 1 << 14  # anchors that a task holds
SHARE = 1 << 12  # rows of a share at least; there are no more shares than cores or, beyond, than LARGEST asks for
LARGEST = 1 << 18
TILE = 1024  # anchors and rows of one product
INNER = 1000  # components that are summed before the sum is reduced: 1000 * 125 * 125 < 2^24
PRIMES = [p for p in range(251, 2, -2) if all(p % q for q in range(3, 16, 2) if q < p)]
LEAST = np.iinfo(np.int64).min


class Mining(NamedTuple):
    """A negative of a positive: low * positive score <= 100 * negative score <= high * positive score, all whole numbers."""

    scale: int = 256
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


class Residues:
    """Exact inner products of whole-numbered vectors whose products are at most ``bound`` in size."""

    def __init__(self, bound: int):
        self.bound, self.primes, product = bound, [], 1
        for p in PRIMES:
            if product > 2 * bound:
                break
            self.primes.append(p)
            product *= p

    def of(self, matrix: np.ndarray) -> list[np.ndarray]:
        """Remainders between -p/2 and p/2 for each prime."""
        return [(matrix - p * np.rint(matrix / p)).astype(np.float32) for p in self.primes]

    def products(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Scores of every row of ``left`` with every row of ``right``."""
        total, radix, digits = np.zeros((len(left[0]), len(right[0])), np.int64), 1, []
        for i, (p, a, b) in enumerate(zip(self.primes, left, right)):
            digit = np.full(total.shape, self.bound % p, np.int32)  # scores plus the bound, which are never negative
            for low in range(0, a.shape[1], INNER):
                digit += (a[:, low:low + INNER] @ b[:, low:low + INNER].T).astype(np.int32) % p
            for q, known in zip(self.primes[:i], digits):
                digit = (digit - known) % p * pow(q, -1, p)
            digits.append(digit % p)
            total += digits[i] * np.int64(radix)
            radix *= p
        return total - self.bound


class Best:
    """The ``k`` rows with the highest scores, ties by id, of each of several owners."""

    def __init__(self, owners: int, k: int):
        self.k, self.least = k, np.full(owners, LEAST)  # a score below an owner's least is not needed any more
        self.owner, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = place < self.k
        full = place == self.k - 1
        self.least[owner[full]] = score[full]
        self.owner, self.score, self.id = owner[kept], score[kept], ids[kept]


def _matrix(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component; a shorter vector counts as zero beyond its end."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), dim))
    out[np.arange(dim) < lengths[:, None]] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


class Group:
    """The anchors of a task, and the best rows of each so far."""

    def __init__(self, parts: list[pa.RecordBatch], system: Residues, dim: int, rule: Mining):
        held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        self.system, self.dim, self.rule, self.held = system, dim, rule, held
        self.id, self.label = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
        self.residues = system.of(_matrix(held.column("vec"), dim, rule.scale))
        windows = held.column("scores").to_pylist()
        self.mining = windows[0] is not None
        if self.mining:
            # Window w belongs to the positive ``slot[w]`` of anchor ``owner[w]``.
            self.first = np.cumsum([0, *map(len, windows)])
            self.owner = np.repeat(np.arange(len(windows)), np.diff(self.first))
            self.slot = np.arange(len(self.owner)) - self.first[self.owner]
            self.positive = np.array([s for w in windows for s in w], np.int64)
            self.low, self.high = -(-rule.low * self.positive // 100), rule.high * self.positive // 100
            self.best = Best(len(self.owner), rule.negatives)
        else:
            self.best = Best(len(windows), rule.positives)

    def take(self, rows: pa.RecordBatch) -> None:
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        theirs = self.system.of(_matrix(rows.column("vec"), self.dim, self.rule.scale))
        for low in range(0, len(self.id), TILE):
            tile = slice(low, low + TILE)
            scores = self.system.products([r[tile] for r in self.residues], theirs)
            same = self.label[tile, None] == labels
            if self.mining:
                self._negatives(low, scores, same, ids)
            else:
                needed = same & (scores >= self.best.least[tile, None]) & (self.id[tile, None] != ids)
                at, row = np.nonzero(needed)
                self.best.add(at + low, scores[at, row], ids[row])

    def _negatives(self, low: int, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> None:
        n = len(scores)
        bottom = np.maximum(self.low, self.best.least)
        at = slice(*self.first[[low, low + n]])
        lowest, highest = np.full(n, -LEAST - 1), np.full(n, LEAST)
        np.minimum.at(lowest, self.owner[at] - low, bottom[at])
        np.maximum.at(highest, self.owner[at] - low, self.high[at])
        anchor, row = np.nonzero(~same & (scores >= lowest[:, None]) & (scores <= highest[:, None]))
        score, ids, anchor = scores[anchor, row], ids[row], anchor + low
        for slot in range(self.rule.positives):
            window = self.first[anchor] + slot
            there = window < self.first[anchor + 1]
            w, s, i = window[there], score[there], ids[there]
            fits = (s >= bottom[w]) & (s <= self.high[w])
            self.best.add(w[fits], s[fits], i[fits])

    def found(self) -> pa.RecordBatch:
        best = self.best
        owner, slot, positive = (self.owner[best.owner], self.slot[best.owner], self.positive[best.owner]) if self.mining else (best.owner, best.owner * 0, best.owner * 0)
        anchor = self.held.column("anchor").to_numpy()[owner]
        columns = [anchor, slot, positive, best.id, best.score]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "slot", "positive_score", "id", "score"])


def mine(scratch: Scratch, vectors: DataFrame, anchors: str = "vec_id % 100 = 0", rule: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, embedding, label) that fit ``anchors``.

    A row's components are floor(scale * x); its score with an anchor is their inner product, higher ones first, ties by smaller vec_id. Positives are the first few
    other rows of the anchor's label, negatives of a positive the first few rows of other labels in its window; rank counts them from 1.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Vectors of unequal length are compared as if the shorter went on with
    zeros. A repeated row counts as often as it is there, but equal anchors are one anchor, and rows with the anchor's vec_id are not its positives.
    Without rows or without anchors there is no result. Scores must stay below 2^56; vectors too long for that are an error. Other columns are not read.
    """
    sound = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where(sound).withColumnRenamed("embedding", "vec")
    sizes = F.max(F.size("vec")), F.max(F.expr("array_max(transform(vec, x -> abs(double(x))))"))
    n, n_anchors, dim, largest = rows.agg(F.count("*"), F.count_if(F.expr(anchors)), *sizes).first()
    bound = (dim or 0) * (math.ceil(rule.scale * (largest or 0.0)) + 1) ** 2
    if bound >= 1 << 56:
        raise ValueError("components are too large for exact scores")
    system = Residues(bound)
    chosen = rows.where(anchors).distinct().withColumn("anchor", F.monotonically_increasing_id())
    chosen = scratch.cut(chosen.withColumn("scores", F.lit(None).cast("array<long>")))
    cells = max(1, -(-n_anchors // HELD)), _shares(rows, n)

    ranked = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = _best(chosen, rows, cells, system, dim or 0, rule).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= rule.positives)
    places = F.sort_array(F.collect_list(F.struct("place", "id", "score")))  # no more than rule.positives
    positives = scratch.cut(near.groupBy("anchor").agg(places.alias("places")))
    asking = scratch.cut(chosen.drop("scores").join(positives, "anchor").withColumn("scores", F.col("places.score")))

    ranked = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    hard = _best(asking.drop("places"), rows, cells, system, dim or 0, rule).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= rule.negatives)
    return hard.join(asking.select("anchor", F.col("vec_id").alias("anchor_id"), "places"), "anchor").select(
        "anchor_id", F.expr("element_at(places, cast(slot + 1 as int)).id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def _shares(rows: DataFrame, n: int) -> int:
    return max(1, min(-(-n // SHARE), max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LARGEST))))


def _best(anchors: DataFrame, rows: DataFrame, cells: tuple[int, int], system: Residues, dim: int, rule: Mining) -> DataFrame:
    """(anchor, slot, positive_score, id, score): the best rows of each share for every anchor, or for every window of it if it has ``scores``."""
    groups, shares = cells
    every = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))) for k in cells]
    left = anchors.select("*", F.lit(0).alias("side"), F.pmod(F.xxhash64("anchor"), F.lit(groups)).alias("group"), every[1].alias("share"))
    # Dealt by number, as one id may have any number of rows.
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shares))
    right = rows.select("*", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("array<long>").alias("scores"), F.lit(1).alias("side"), dealt.alias("share"), every[0].alias("group"))
    both = left.unionByName(right).withColumn("cell", (F.col("group") * shares + F.col("share")).cast("int")).drop("group", "share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, group = None, [], None
        for batch in batches:
            keys = batch.column("cell").to_numpy() * 2 + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                at, side = divmod(int(keys[low]), 2)
                if at != cell:
                    if group:
                        yield group.found()
                    cell, waiting, group = at, [], None
                part = batch.slice(low, high - low)
                if side == 0:
                    waiting.append(part)
                    continue
                if group is None and waiting:
                    group = Group(waiting, system, dim, rule)
                for start in range(0, len(part) if group else 0, TILE):
                    group.take(part.slice(start, TILE))
        if group:
            yield group.found()

    placed = both.repartitionById(groups * shares, "cell").sortWithinPartitions("cell", "side")
    return placed.mapInArrow(run, "anchor long, slot long, positive_score long, id long, score long")
