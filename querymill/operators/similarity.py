"""Top-k similarity join: for each query vector, the k best stored vectors above a threshold.

Both sides are dealt into groups, and the groups make a grid: a task takes one group of queries, holds it, and streams one group of stored vectors past it, block by
block. It keeps the k best of every query, so what leaves it depends on its queries alone. Nothing is broadcast or sent to one task whole:

* copies of a vector are folded first (k smallest keys on the stored side, one row on the query
  side), so a vector shared by a third of all rows costs no more than any other;
* a vector is sent to every task of its row or column of the grid, the square root of the number of tasks where both sides are alike;
* on large inputs vectors are sorted into cells around sampled centres, groups are ranges of cells, and by the triangle
  inequality only pairs of cells close enough to hold a match are compared; a vector goes only to tasks that have such a cell for it;
* a crowded cell is split among groups by hash of the row.

``similarity_join`` is exact. ``similarity_approximate`` looks only into the stored cells whose centres, found by k-means, are nearest to the query.
"""

import json
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from querymill.defaults import MAX_CANDIDATES, SIMILARITY_THRESHOLD
from querymill.functions.vectors import METRICS, SCORES, is_vector, largest_distance
from querymill.session import cut

BLOCK_ROWS = 8192
MAX_CELLS = 256
# A task holds the queries of so many blocks; small blocks part the queries into no more than so many groups, as long as a task can hold a group's rows.
HELD_BLOCKS, BLOCK_GROUPS, HELD_ROWS = 4, 8, 1 << 15
# Queries and stored vectors of one product: what a task works on beside what it holds. Of so many of its pairs each is worked out on its own.
PRODUCT_ROWS, PRODUCT_STORED, SINGLE_PAIRS = 256, 2048, 1 << 12
# Pairs that are worth a task of their own, and that a task should not exceed.
FEW_PAIRS, MANY_PAIRS = 1 << 20, 1 << 32
# Up to so many pairs of blocks are compared sooner than sorted into cells.
CELL_PAIRS = 2
# Scores closer than this count as equal, so that order never hangs on summation order.
SCORE_DIGITS = 9
# Slack for rounding when cells are ruled out, and when pairs are.
ANGLE_SLACK, PAIR_SLACK = 1e-6, 1e-9
# The approximate join: k-means sees so many vectors for each cell, and a query looks into this share of all cells.
SAMPLED_PER_CELL = 64
PROBED_SHARE = 1 / 3

_VECTOR = ["_v1", "_v2"]


def similarity_join(
    queries: DataFrame,
    store: DataFrame,
    *,
    query_key: str = "query_id",
    store_key: str = "query_hash",
    query_vec: str = "embedding",
    store_vec: str = "embedding",
    query_seq: str | None = None,
    store_seq: str | None = None,
    threshold: float = SIMILARITY_THRESHOLD,
    k: int = MAX_CANDIDATES,
    metric: str = "cosine",
    score: str = "reference",
    dim: int | None = None,
    block_rows: int = BLOCK_ROWS,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Rows (query_key, store_key, score, distance, rank), rank 1..k by score, ties by key.

    With ``query_seq`` and ``store_seq`` only stored rows of a smaller sequence number match, and
    ties go to the smallest of them. Vectors of another length than ``dim`` (default: the stored
    vectors' most common one), null, zero or non-finite vectors match nothing.
    """
    _known(metric, score)
    sides = _sides(queries, store, query_key, store_key, query_vec, store_vec, query_seq, store_seq, k, dim)
    cells = min(max_cells, math.ceil(sides.n_store / block_rows)) if sides.n_query * sides.n_store > CELL_PAIRS * block_rows**2 else 1
    query, stored = sides.query.withColumn("cell", F.lit(0)), sides.store.withColumn("cell", F.lit(0))
    counts, near = {("q", 0): sides.n_query, ("s", 0): sides.n_store}, np.ones((1, 1), dtype=bool)
    if cells > 1:
        centres = _centres(sides.store, cells, metric)
        query, stored = cut(_assign(sides.query, centres, metric)), cut(_assign(sides.store, centres, metric))
        spread = {
            (r["side"], r["cell"]): (r["rows"], r["radius"])
            for r in query.select(F.lit("q").alias("side"), "cell", "radius")
            .unionByName(stored.select(F.lit("s").alias("side"), "cell", "radius"))
            .groupBy("side", "cell")
            .agg(F.count("*").alias("rows"), F.max("radius").alias("radius"))
            .collect()  # at most two rows per centre
        }
        counts = {key: rows for key, (rows, _) in spread.items()}
        q_radius, s_radius = ([spread.get((side, c), (0, -math.inf))[1] for c in range(len(centres))] for side in "qs")
        gaps = _pairwise(centres, centres, metric) - np.array(q_radius)[:, None] - np.array(s_radius)
        near = gaps <= _reach(threshold, metric, score)
        query, stored = query.drop("radius"), stored.drop("radius")
    found = _match(_Grid(query, stored, counts, near, block_rows), metric, score, threshold, k)
    return _ranked(sides, found, query_key, store_key, k)


def similarity_approximate(
    queries: DataFrame,
    store: DataFrame,
    *,
    query_key: str = "query_id",
    store_key: str = "query_hash",
    query_vec: str = "embedding",
    store_vec: str = "embedding",
    threshold: float = SIMILARITY_THRESHOLD,
    k: int = MAX_CANDIDATES,
    metric: str = "cosine",
    score: str = "reference",
    dim: int | None = None,
    block_rows: int = BLOCK_ROWS,
    cells: int | None = None,
    probes: int | None = None,
) -> DataFrame:
    """As ``similarity_join``, but a query is compared only with the stored vectors of the ``probes`` cells nearest to it.

    Every stored vector is in the cell of its nearest centre. Centres come from k-means (Spark's) over a fixed pseudo-random choice of at most SAMPLED_PER_CELL stored vectors for
    each of ``cells`` (default: the square root of the number of stored vectors, MAX_CELLS at most). ``probes`` is by default a share (PROBED_SHARE) of all cells. Rows that
    come out have their exact score; rows may be missing, and those of all cells are the exact join's.
    """
    _known(metric, score)
    sides = _sides(queries, store, query_key, store_key, query_vec, store_vec, None, None, k, dim)
    cells = min(MAX_CELLS, math.ceil(math.sqrt(sides.n_store))) if cells is None else cells
    centres = _trained(sides.store, max(1, cells), metric)
    probes = math.ceil(PROBED_SHARE * len(centres)) if probes is None else min(probes, len(centres))
    stored = cut(_assign(sides.store, centres, metric).drop("radius"))
    query = cut(_probed(sides.query, centres, metric, max(1, probes)))
    counts = {("s", r["cell"]): r["count"] for r in stored.groupBy("cell").count().collect()}  # a row per centre
    grid = _Grid(query, stored, counts | {("q", 0): sides.n_query}, np.eye(max(1, len(centres)), dtype=bool), block_rows)
    return _ranked(sides, _match(grid, metric, score, threshold, k), query_key, store_key, k)


class _Sides(NamedTuple):
    asked: DataFrame  # q_key and the identity of its vector
    query: DataFrame  # folded: q_seq, vec and identity
    store: DataFrame  # folded: s_key, s_seq, vec and identity
    n_query: int
    n_store: int


def _sides(queries, store, query_key, store_key, query_vec, store_vec, query_seq, store_seq, k, dim) -> _Sides:
    """Both sides without what cannot match and without copies of a vector."""
    stored = store.where(is_vector(F.col(store_vec))).select(
        F.col(store_key).alias("s_key"),
        (F.col(store_seq) if store_seq else F.lit(0)).cast("bigint").alias("s_seq"),
        F.col(store_vec).alias("vec"),
    )
    asked = queries.where(is_vector(F.col(query_vec))).select(
        F.col(query_key).alias("q_key"),
        (F.col(query_seq) if query_seq else F.lit(1)).cast("bigint").alias("q_seq"),
        F.col(query_vec).alias("vec"),
    )
    if dim is None:
        lengths = stored.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("rows"))
        usual = lengths.agg(F.max(F.struct("rows", (-F.col("dim")).alias("dim"))).alias("top"))
        dim = usual.select(F.coalesce(-F.col("top.dim"), F.lit(0))).first()[0]
    n_store, n_query = (df.agg(F.count_if(F.size("vec") == dim)).first()[0] for df in (stored, asked))

    identity = [F.xxhash64("vec").alias("_v1"), F.xxhash64(F.lit(1), "vec").alias("_v2")]
    stored = stored.where(F.size("vec") == dim).select("*", *identity)
    asked = asked.where(F.size("vec") == dim).select("*", *identity)
    copies = Window.partitionBy(*_VECTOR).orderBy("s_seq", "s_key")
    folded_store = stored.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")
    folded_query = asked.select("q_seq", "vec", *_VECTOR).dropDuplicates([*_VECTOR, "q_seq"])
    return _Sides(asked.drop("vec"), folded_query, folded_store, n_query, n_store)


def _ranked(sides: _Sides, found: DataFrame, query_key: str, store_key: str, k: int) -> DataFrame:
    """The best k of what the tasks found, for every query that has the vector."""
    best = Window.partitionBy(*_VECTOR, "q_seq").orderBy(F.desc(F.round("score", SCORE_DIGITS)), "s_seq", "s_key")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return sides.asked.join(ranked, [*_VECTOR, "q_seq"]).select(
        F.col("q_key").alias(query_key), F.col("s_key").alias(store_key), "score", "distance", "rank"
    )


def _known(metric: str, score: str) -> None:
    if metric not in METRICS or score not in SCORES:
        raise ValueError(f"metric must be one of {METRICS} and score one of {SCORES}")


class _Grid:
    """Groups of queries by groups of stored vectors, a task for each pair that has near cells.

    The cells of a side lie one after another, each as wide as it has rows, and are cut into groups of equal width; a row's place within its cell comes from its hash.
    Queries with several cells (``cells``) have their place from their hash alone.
    """

    def __init__(self, query: DataFrame, store: DataFrame, counts: dict, near: np.ndarray, block_rows: int):
        self.query, self.store, self.near, self.several = query, store, near, "cells" in query.columns
        widths = [np.array([counts.get((side, c), 0) for c in range(len(near))]) for side in "qs"]
        n_query, n_store = (max(1, int(w.sum())) for w in widths)
        parallelism = query.sparkSession.sparkContext.defaultParallelism
        tasks = max(min(parallelism, math.ceil(n_query * n_store / FEW_PAIRS)), math.ceil(n_query * n_store / MANY_PAIRS))
        blocks = min(BLOCK_GROUPS, math.ceil(n_query / (HELD_BLOCKS * block_rows)))
        rows = max(math.ceil(math.sqrt(tasks * n_query / n_store)), math.ceil(n_query / HELD_ROWS))
        columns = math.ceil(tasks / max(rows, blocks))
        if blocks > rows:  # so that neither side is copied much more than the other
            rows, columns = blocks, max(columns, math.ceil(blocks * n_store / n_query))
        self.rows, self.columns = rows, columns
        self.starts = [np.cumsum(w) - w for w in widths]
        self.widths, self.sizes = widths, [math.ceil(n / groups) for n, groups in ((n_query, rows), (n_store, columns))]

    def groups(self, side: int, cell: int) -> range:
        """The groups that hold rows of a cell."""
        start, width, size = self.starts[side][cell], self.widths[side][cell], self.sizes[side]
        return range(int(start // size), int((start + width - 1) // size) + 1) if width else range(0)

    def others(self, side: int, cell: int) -> list[int]:
        """The groups of the other side that rows of a cell are sent to."""
        if side == 1 and self.several:
            return list(range(self.rows))
        near = self.near if side == 0 else self.near.T
        return sorted({g for other in np.flatnonzero(near[cell]) for g in self.groups(1 - side, other)})

    def sent(self) -> DataFrame:
        """(tile, side, cells, seq, s_key, vec and identity): every row, once for each task that has a near cell for it."""
        sides = []
        for side, (df, identity) in enumerate(((self.query, [*_VECTOR, "q_seq"]), (self.store, [*_VECTOR, "s_seq", "s_key"]))):
            table = [(cell, int(self.starts[side][cell]), int(self.widths[side][cell]), self.others(side, cell)) for cell in range(len(self.near))]
            if side == 0 and self.several:
                # An entry per cell: bounded by the number of cells, whatever the data.
                others = F.from_json(F.lit(json.dumps([o for *_, o in table])), "array<array<int>>")
                reached = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.get(others, c))))
                placed = df.withColumns({"start": F.lit(0), "width": F.lit(int(self.widths[0].sum())), "others": reached})
            elif len(table) == 1:
                ((_, start, width, others),) = table
                placed = df.withColumns({"start": F.lit(start), "width": F.lit(width), "others": F.lit(others).cast("array<int>")})
            else:
                # One row per cell: bounded by the number of cells, whatever the data.
                places = df.sparkSession.createDataFrame(table, "cell int, start bigint, width bigint, others array<int>")
                placed = df.join(F.broadcast(places), "cell")
            own = F.floor((F.col("start") + F.pmod(F.xxhash64(F.lit(7 + side), *identity), "width")) / self.sizes[side])
            exploded = placed.withColumn("own", own).withColumn("other", F.explode("others"))
            row, column = ("own", "other") if side == 0 else ("other", "own")
            sides.append(exploded.select(
                (F.col(row) * self.columns + F.col(column)).cast("int").alias("tile"), F.lit(side).alias("side"),
                (F.col("cells") if "cells" in df.columns else F.array("cell")).alias("cells"), *_VECTOR,
                F.col("q_seq" if side == 0 else "s_seq").alias("seq"), (F.lit(None) if side == 0 else F.col("s_key")).cast(self.store.schema["s_key"].dataType).alias("s_key"), "vec",
            ))
        return sides[0].unionByName(sides[1])


def _reach(threshold: float, metric: str, score: str) -> float:
    """Largest distance of a match in the measure that obeys the triangle inequality."""
    limit = largest_distance(threshold, score)
    if metric == "sql2":
        return math.sqrt(limit) + ANGLE_SLACK if limit >= 0 else -1.0
    return math.pi if limit >= 2 else math.acos(1.0 - limit) + ANGLE_SLACK if limit >= 0 else -1.0


def _centres(store: DataFrame, cells: int, metric: str) -> np.ndarray:
    """A fixed pseudo-random choice of stored vectors, at most ``cells`` rows."""
    rows = store.select("vec", *_VECTOR).orderBy(F.xxhash64(F.lit(3), *_VECTOR)).limit(cells).collect()
    return _unit(np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), -1), metric)


def _unit(matrix: np.ndarray, metric: str) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if metric == "cosine" else matrix


def _pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Angles for cosine, Euclidean distances for squared Euclidean."""
    if metric == "cosine":
        return np.arccos(np.clip(a @ b.T, -1.0, 1.0))
    return np.sqrt(np.maximum(_squared(a, b), 0.0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def _assign(df: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    """Add the nearest centre and the distance to it."""
    @F.pandas_udf("cell int, radius double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        far = _pairwise(_unit(np.vstack(vectors.to_numpy()), metric), centres, metric)
        cell = far.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": far[np.arange(len(cell)), cell]})

    if not len(centres):
        return df.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("radius"))
    return df.withColumn("_near", nearest("vec")).select("*", "_near.cell", "_near.radius").drop("_near")


def _trained(store: DataFrame, cells: int, metric: str) -> np.ndarray:
    """Centres of ``cells`` clusters at most, of a bounded choice of the stored vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = cut(store.select("vec", *_VECTOR).orderBy(F.xxhash64(F.lit(3), *_VECTOR)).limit(cells * SAMPLED_PER_CELL).select(F.col("vec").cast("array<double>").alias("vec")))
    if not chosen.take(1):
        return np.empty((0, 0))
    means = KMeans(k=cells, seed=1, maxIter=10, distanceMeasure="cosine" if metric == "cosine" else "euclidean", featuresCol="features")
    if cells == 1:
        return _unit(np.array([chosen.first()["vec"]]), metric)
    model = means.fit(chosen.select(array_to_vector("vec").alias("features")))
    found = np.array(model.clusterCenters(), dtype=np.float64)
    return _unit(found[np.abs(found).sum(axis=1) > 0], metric)


def _probed(df: DataFrame, centres: np.ndarray, metric: str, probes: int) -> DataFrame:
    """Add the ``probes`` nearest centres."""
    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        far = _pairwise(_unit(np.vstack(vectors.to_numpy()), metric), centres, metric)
        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :probes].astype("int32")))

    if not len(centres):
        return df.withColumn("cells", F.array(F.lit(0)))
    return df.withColumn("cells", nearest("vec"))


class _Held:
    """The queries of a task, and the k best stored vectors of each so far.

    Of a product of PRODUCT_ROWS by PRODUCT_STORED, no more than k matches of a query are kept before the next one is made, however many there are.
    """

    def __init__(self, parts: list[pa.RecordBatch], near, metric, score, threshold, k):
        rows = pa.Table.from_batches(parts).combine_chunks()
        self.rows, self.vec, self.seq = rows.select([*_VECTOR, "seq"]), _matrix(rows.column("vec"), metric), rows.column("seq").to_numpy()
        self.metric, self.score, self.threshold, self.k = metric, score, threshold, k
        # Cosines are first worked out in single precision, in which most pairs are ruled out; this is what they may be off by.
        self.rough, self.slack = self.vec.astype(np.float32), (self.vec.shape[1] + 4) * 2.0**-23
        self.cells, self.ours = _by_cell(rows.column("cells"), near)
        n = len(self.vec)
        # The rounded score of the last of k matches and its place among the stored, which a further match must beat, and the distance up to which it may.
        self.least, self.least_at = np.full(n, -np.inf), np.full(n, -1)
        self.limit = np.full(n, largest_distance(threshold, score) + PAIR_SLACK)
        self.met = 0
        self.best = {"rounded": np.full((n, 1), -np.inf), "at": np.full((n, 1), -1), "score": np.zeros((n, 1)), "distance": np.zeros((n, 1)), "s_seq": np.zeros((n, 1), np.int64), "s_key": np.full((n, 1), None, dtype=object)}

    def take(self, batch: pa.RecordBatch) -> None:
        """Queries and stored vectors come by sequence number, and the latter by key, so of equal scores the one met first wins."""
        vec, seq, keys = _matrix(batch.column("vec"), self.metric), batch.column("seq").to_numpy(), batch.column("s_key")
        rough, asked = vec.astype(np.float32), self.cells[batch.column("cells").flatten().to_numpy()]
        ordered = self.seq.dtype.kind == seq.dtype.kind == "i"  # no nulls
        for group in np.unique(asked[asked >= 0]):
            ours, theirs = self.ours[group], np.flatnonzero(asked == group)
            for first in range(0, len(theirs), PRODUCT_STORED):
                block = theirs[first:first + PRODUCT_STORED]
                # Queries that come before all of the block are left out of the products.
                start = int(np.searchsorted(self.seq[ours], seq[block[0]], side="right")) if ordered else 0
                for low in range(start, len(ours), PRODUCT_ROWS):
                    self._product(ours[low:low + PRODUCT_ROWS], block, vec, rough, seq, keys)
        self.met += len(batch)

    def _product(self, ours, theirs, vec, rough, seq, keys) -> None:
        limit = self.limit[ours]
        if self.metric == "cosine":
            least = (1.0 - limit - self.slack).astype(np.float32)
            close = self.rough[ours] @ rough[theirs].T >= least[:, None]
        else:
            distance = np.maximum(_squared(self.vec[ours], vec[theirs]), 0.0)
            close = distance <= limit[:, None]
        i, j = np.divmod(np.flatnonzero(close), len(theirs))
        if len(i) and seq[theirs].max() >= self.seq[ours].min():
            earlier = seq[theirs[j]] < self.seq[ours[i]]
            i, j = i[earlier], j[earlier]
        if not len(i):
            return
        if self.metric == "cosine":
            if len(i) <= SINGLE_PAIRS:
                cosine = np.einsum("nd,nd->n", self.vec[ours[i]], vec[theirs[j]])
            else:
                cosine = (self.vec[ours] @ vec[theirs].T)[i, j]
            exact = cosine >= 1.0 - limit[i]
            i, j, distance = i[exact], j[exact], 1.0 - cosine[exact]
        else:
            distance = distance[i, j]
        q, at = ours[i], self.met + theirs[j]
        value = np.maximum(0.0, 1.0 - distance**2 / 2.0) if self.score == "reference" else 1.0 - distance
        rounded = np.round(value, SCORE_DIGITS)
        wanted = np.flatnonzero((value >= self.threshold) & ((rounded > self.least[q]) | ((rounded == self.least[q]) & (at < self.least_at[q]))))
        wanted = wanted[_first(q[wanted], rounded[wanted], at[wanted], self.k)[0]]
        if len(wanted):
            found = {"rounded": rounded, "at": at, "score": value, "distance": distance, "s_seq": seq[theirs][j]}
            new_keys = np.empty(len(wanted), dtype=object)
            new_keys[:] = keys.take(pa.array(theirs[j[wanted]])).to_pylist()
            self._keep(q[wanted], {name: x[wanted] for name, x in found.items()} | {"s_key": new_keys})

    def _keep(self, q, new) -> None:
        """The best k of what there was and the new ones."""
        changed = np.unique(q)
        had, place = np.nonzero(self.best["at"][changed] >= 0)
        every = {name: np.concatenate([x[changed[had], place], new[name]]) for name, x in self.best.items()}
        q = np.concatenate([changed[had], q])
        kept, place = _first(q, every["rounded"], every["at"], self.k)
        q, width = q[kept], self.best["at"].shape[1]
        if place.max() >= width:
            wider = min(self.k, max(int(place.max()) + 1, 2 * width)) - width
            empty = {"rounded": -np.inf, "at": -1, "s_key": None}
            self.best = {name: np.pad(x, ((0, 0), (0, wider)), constant_values=empty.get(name, 0)) for name, x in self.best.items()}
        for name, x in self.best.items():
            x[q, place] = every[name][kept]
        full = place == self.k - 1
        self.least[q[full]], self.least_at[q[full]] = every["rounded"][kept][full], every["at"][kept][full]
        least = self.least[q[full]] - 2 * 10.0**-SCORE_DIGITS
        if self.score == "reference":
            limit = np.where(least <= 0, np.inf, np.sqrt(2.0 * np.maximum(0.0, 1.0 - least)))
        else:
            limit = 1.0 - least
        self.limit[q[full]] = np.minimum(self.limit[q[full]], limit + PAIR_SLACK)

    def found(self, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.vec), BLOCK_ROWS):
            best = {name: x[low:low + BLOCK_ROWS] for name, x in self.best.items()}
            i, place = np.nonzero(best["at"] >= 0)
            rows = self.rows.take(pa.array(i + low))
            columns = [rows.column(c).combine_chunks() for c in (*_VECTOR, "seq")]
            columns += [pa.array(best[c][i, place]) for c in ("s_seq", "score", "distance")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(best["s_key"][i, place]), key_type)], names=[*_VECTOR, "q_seq", "s_seq", "score", "distance", "s_key"])


def _first(q, rounded, at, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are among the k best of their query, and their places there."""
    order = np.lexsort((at, -rounded, q))
    owner = q[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    return order[place < k], place[place < k]


def _by_cell(cells: pa.ChunkedArray, near: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For every stored cell a number, equal for cells that the same queries look into (-1: none do); and by that number these queries."""
    cells = cells.combine_chunks()
    lengths, flat = pc.list_value_length(cells).to_numpy(), cells.flatten().to_numpy()
    if (lengths == 1).all():
        wanted = near[flat]
    else:
        wanted = np.zeros((len(cells), len(near)), dtype=np.float32)
        wanted[np.repeat(np.arange(len(cells)), lengths), flat] = 1
        wanted = wanted @ near.astype(np.float32) > 0
    numbers, numbered, ours = {}, np.full(len(near), -1), []
    for cell in range(len(near)):
        column = wanted[:, cell]
        if column.any():
            number = numbers.setdefault(np.packbits(column).tobytes(), len(numbers))
            if number == len(ours):
                ours.append(np.flatnonzero(column).astype(np.int32))
            numbered[cell] = number
    return numbered, ours


def _matrix(vectors: pa.ChunkedArray | pa.Array, metric: str) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1), metric)


def _match(grid: _Grid, metric, score, threshold, k) -> DataFrame:
    """The k best matches of each query in each task."""
    near = grid.near
    out = T.StructType(
        [T.StructField(c, T.LongType()) for c in [*_VECTOR, "q_seq", "s_seq"]]
        + [T.StructField(c, T.DoubleType()) for c in ("score", "distance")]
        + [T.StructField("s_key", grid.store.schema["s_key"].dataType)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, waiting, held = None, [], None
        for batch in batches:
            key_type = batch.schema.field("s_key").type
            keys = batch.column("tile").to_numpy() * 2 + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)] if len(keys) else []
            for low, high in zip(cuts, cuts[1:]):
                at, side = divmod(int(keys[low]), 2)
                if at != tile:
                    if held:
                        yield from held.found(key_type)
                    tile, waiting, held = at, [], None
                part = batch.slice(low, high - low)
                if side == 0:
                    waiting.append(part)
                    continue
                if held is None and waiting:
                    held, waiting = _Held(waiting, near, metric, score, threshold, k), []
                if held:
                    held.take(part)
        if held:
            yield from held.found(key_type)

    sent = grid.sent().repartitionById(grid.rows * grid.columns, "tile").sortWithinPartitions("tile", "side", "seq", "s_key")
    return sent.mapInArrow(run, out)
