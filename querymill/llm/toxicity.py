"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Every coordinate has its own learning rate, and L1 holds all but the telling ones at exactly zero, so that the
fitted weights are a few thousand numbers which every task can carry.
"""

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from querymill.llm.arrow import with_columns
from querymill.llm.words import FACTOR, chunks, mix, words_of

BITS = 20  # 2^20 coordinates: the bound on the size of a model
FIT_ROWS = 40_000  # labelled rows that a model is fitted on, at most
THRESHOLD = 0.3
PASSES, PASS_ROWS = 5, 5_000  # few rows are learned again, until so many have been seen, but no more often than this
PRIOR = 0.05  # how likely label 1 is before any label is seen; it weighs as much as one label


class Rates(NamedTuple):
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.5


class Model(NamedTuple):
    """Weights that are not zero, by ascending coordinate."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray


def features(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates of single words, of pairs of neighbours, and of pairs that skip a word."""
    pair = hashes[:-1] * FACTOR[0] + hashes[1:] * FACTOR[1]
    skip = hashes[:-2] * FACTOR[2] + hashes[2:] * FACTOR[3]
    return mix(np.concatenate([hashes, pair, skip])) >> np.uint64(64 - bits)


class Ftrl:
    """The learner: sums of gradients, and of their squares, for each coordinate and the bias (the last), which adds to ``start``."""

    def __init__(self, bits: int, rates: Rates, start: float = 0.0):
        self.bits, self.rates, self.start = bits, rates, start
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        r, z = self.rates, self.z[at]
        w = (np.sign(z) * r.l1 - z) / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2)
        w[np.abs(z) <= r.l1] = 0.0
        return w

    def learn(self, hashes: np.ndarray, label: int) -> np.ndarray:
        at = np.append(np.unique(features(hashes, self.bits)).astype(np.int64), 1 << self.bits)
        self.step(at, label)
        return at

    def step(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = _sigmoid(self.start + w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rates.alpha * w
        self.n[at] = n + g * g

    def model(self) -> pd.DataFrame:
        w = self.weights(np.arange(len(self.z)))
        kept = np.flatnonzero(w)
        return pd.DataFrame({"coordinate": kept.astype(np.int64), "weight": w[kept]})


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, bits: int = BITS, rates: Rates = Rates()) -> Model:
    """Learn ``label`` (0 or 1) of ``labels`` (doc_id, label) from the whole texts of ``docs`` (doc_id, text).

    At most ``rows`` labelled rows are used, those whose id hashes lowest, which is a random sample that neither order
    nor source decides; they are read in that order by one task, a batch at a time. Rows without an id or a label teach nothing;
    a null text is empty; an id with several labels or texts is learned from each. The bias starts at the log-odds of these labels, and without any
    rows all scores are PRIOR. Fewer rows than PASS_ROWS are gone through again, up to PASSES times. What reaches the driver is bounded by the number of coordinates.
    """
    sample = (
        labels.where("label IS NOT NULL AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("id_"), F.col("label").cast("int").alias("label_"), F.xxhash64("doc_id").alias("order_"))
        .orderBy("order_", "id_", "label_")
        .limit(rows)
    )
    n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label_"), F.lit(0))).first()
    start = float(np.log((ones + PRIOR) / (n - ones + 1 - PRIOR)))
    passes = max(1, min(PASSES, PASS_ROWS // max(n, 1)))
    # Bounded by ``rows``: three numbers each.
    joined = docs.select(F.col("doc_id").alias("id_"), "text").join(F.broadcast(sample), "id_")
    read = joined.select("order_", "id_", "label_", "text").repartitionByRange(1, "order_").sortWithinPartitions("order_", "id_", "label_", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Ftrl(bits, rates, start), []
        for batch in batches:
            truth = batch.column("label_").to_numpy()
            for chunk in chunks(batch.column("text")):
                words = words_of(chunk, fold=True)
                for i in range(chunk.high - chunk.low):
                    at = learner.learn(words.hashes[words.first[i]:words.first[i + 1]], truth[chunk.low + i])
                    if passes > 1:  # fewer than PASS_ROWS rows, of 2^20 coordinates at most
                        seen.append((at.astype(np.int32), truth[chunk.low + i]))
        for _ in range(passes - 1):
            for at, label in seen:
                learner.step(at, label)
        yield pa.RecordBatch.from_pandas(learner.model(), preserve_index=False)

    found = read.mapInArrow(learn, "coordinate long, weight double").toPandas().sort_values("coordinate")
    bias = start + found.weight[found.coordinate == 1 << bits].sum()
    found = found[found.coordinate < 1 << bits]
    return Model(bits, float(bias), found.coordinate.to_numpy(np.int64), found.weight.to_numpy())


def score(docs: DataFrame, model: Model, name: str = "score", without: Sequence[str] = ()) -> DataFrame:
    """``docs`` (text and any other columns) with a column ``name``: how likely label 1 is, from 0 to 1.

    A feature counts once for a text, however often it is found. A null text is scored as an empty one. An own
    column of that name is replaced.
    """
    # Bounded by the number of coordinates. A plain tuple: executors may not have this package, and so not its classes.
    carried = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def make(batches):
        bits, bias, index, weight = carried.value
        weights = np.zeros(1 << bits)
        weights[index] = weight
        for (texts,) in batches:
            yield [pa.array([s for chunk in chunks(texts) for s in _scores(chunk, weights, bits, bias)], pa.float64())]

    return with_columns(docs, ["text"], [(name, "double")], make, without)


def _scores(chunk, weights: np.ndarray, bits: int, bias: float) -> Iterator[float]:
    words = words_of(chunk, fold=True)
    for i in range(chunk.high - chunk.low):
        at = features(words.hashes[words.first[i]:words.first[i + 1]], bits)
        at = at[weights[at] != 0]
        yield float(_sigmoid(bias + weights[np.unique(at)].sum()))


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from: a quarter, by the checksum of the id as text. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = FIT_ROWS, without: Sequence[str] = ()) -> DataFrame:
    """``docs`` with score, held_out and predicted (1 from ``threshold`` on), by a model of ``labels`` (doc_id, toxic).

    Own columns of these names are replaced. All rows stay, repeated ones as well, and all other columns but those of ``without``.
    """
    taught = labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs.select("doc_id", "text"), taught, rows)
    scored = score(docs.drop("held_out", "predicted"), model, without=without)
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
