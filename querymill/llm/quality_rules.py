"""Quality rules: plain limits, and robust multivariate outliers by minimum-covariance-determinant estimates.

Each text is described by five transformed statistics. For every language and source, centre and covariance are
estimated from the three quarters of its texts that lie closest together, and a text whose Mahalanobis
distance is beyond the cut-off is rejected. Estimates are made from all rows: each concentration step is one
aggregate over (group, distance bin), combined before its shuffle, so a group that holds most rows is no single task's
work, and nothing is sampled.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from querymill.llm.arrow import with_columns
from querymill.llm.words import chunks, grams, words_of
from querymill.session import Scratch

WINDOW = 8  # words of a repeated window
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
DIMS = 5
CORE = 0.75  # share of a group that its estimate rests on
CUT_OFF = 20.515  # 0.999 quantile of chi-square with DIMS degrees of freedom
MEDIAN = 4.351  # its median
MIN_ROWS = 200  # texts that an estimate of its own takes
STEPS = 6  # concentration steps
# Spread that a statistic has at least, whatever the group: word count (log), word length (log), symbols per word (root),
# repeated lines (log), share of repeated words (root).
LEAST_SPREAD = (1.0, 0.1, 0.15, 0.7, 0.15)
BINS = 32  # distance bins in a doubling
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"  # fixed values

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_FIRST = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def with_statistics(docs: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """``docs`` (text and any other columns) with the five base counts of each whole text; a null text has none of anything.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line),
    n_repeat_words (words inside 8-word windows that are found twice or more in the text). Own columns of these names are replaced.
    """

    def make(batches):
        for (texts,) in batches:
            counts = np.concatenate([np.empty((DIMS, 0), np.int64), *map(_counts, chunks(texts))], axis=1)
            yield [pa.array(c) for c in counts]

    return with_columns(docs, ["text"], [(name, "long") for name in STATS], make, without)


def _counts(chunk) -> np.ndarray:
    words, bounds, data = words_of(chunk), chunk.bounds, chunk.data
    running = np.concatenate([np.zeros(1, np.int64), np.cumsum(_IS_FIRST[data])])
    in_words = np.concatenate([np.zeros(1, np.int64), np.cumsum(running[words.ends] - running[words.starts])])
    symbols = np.concatenate([np.zeros(1, np.int64), np.cumsum(_IS_SYMBOL[data])])
    repeated = np.array([_repeated_words(words.hashes[a:b]) for a, b in zip(words.first, words.first[1:])], np.int64)
    raw = data.tobytes()
    lines = np.array([_repeated_lines(raw[a:b]) for a, b in zip(bounds, bounds[1:])], np.int64)
    return np.stack([np.diff(words.first), np.diff(in_words[words.first]), np.diff(symbols[bounds]), lines, repeated])


def _repeated_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    distinct = set(lines)
    if len(distinct) == len(lines):
        return 0
    blank = sum(1 for x in lines if not x.strip(b" \t\x0b\x0c\r"))
    return len(lines) - blank - sum(1 for x in distinct if x.strip(b" \t\x0b\x0c\r"))


def _repeated_words(hashes: np.ndarray) -> int:
    windows = grams(hashes, WINDOW)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edges)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def _vector() -> list[Column]:
    """The transformed statistics; only asked of texts with words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(words), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), F.sqrt(F.col("n_symbols") / words),
        F.log1p(F.col("n_dup_lines")), F.sqrt(F.col("n_repeat_words") / words),
    ]


def _group() -> Column:
    """Language and source as one key; a null differs from every text."""
    return F.to_json(F.struct("lang", "source"))


def _distance() -> Column:
    x = [v - F.col("centre")[i] for i, v in enumerate(_vector())]
    return sum((x[i] * x[j] * F.col("precision")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


def judge(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` (lang, source, the columns of ``with_statistics`` and any others) with base_failed, distance and kept.

    ``kept`` is false for texts that fail a base limit or lie beyond the cut-off. A null language or source is a
    group of its own. Sources with fewer than MIN_ROWS texts that pass the limits are estimated together within their language, too
    small languages together, and if even those are too few, only the limits judge them: their distance is null. All rows stay,
    repeated ones too. Own columns of the added names are replaced. ``docs`` is read several times.
    """
    docs = docs.drop("base_failed", "distance", "kept")
    fitted = estimates(scratch, docs)
    return (
        docs.withColumns({"base_failed": base_failed(), "group_": _group()})
        .join(fitted.withColumnRenamed("group", "group_"), "group_", "left")
        .withColumn("distance", F.when(F.col("n_words") > 0, F.sqrt(_distance())))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT_OFF ** 0.5, F.lit(True)))
        .drop("group_", "centre", "precision")
    )


def estimates(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(group, centre, precision) for each language and source; precision is the upper triangle, row by row."""
    sound = docs.where(~base_failed()).select("lang", _group().alias("group"), *[v.alias(f"x{i}") for i, v in enumerate(_vector())])
    sound = scratch.cut(sound)
    keys = scratch.cut(_keys(sound))
    # Plain tables on both sides, so that the rows of a large group can be split.
    rows = scratch.cut(sound.join(keys, "group").select("key", *[f"x{i}" for i in range(DIMS)]))
    fitted = scratch.cut(_start(scratch, rows))
    for step in range(STEPS + 1):
        last = step == STEPS
        moments = scratch.cut(_binned(rows, fitted))
        moved = scratch.cut(_scaled(moments, fitted) if last else _concentrated(moments).mapInPandas(_solve, "key string, centre array<double>, precision array<double>"))
        scratch.drop(fitted, moments)
        fitted = moved
    scratch.drop(sound, rows)
    # Written, so that Spark sees how small it is, and texts need no shuffle to meet it.
    return scratch.cut(keys.join(fitted, "key").select("group", "centre", "precision"))


def _keys(sound: DataFrame) -> DataFrame:
    """(group, key): the estimate that each group takes."""
    sizes = sound.groupBy("group", "lang").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_ROWS
    by_lang = Window.partitionBy("lang")
    pooled = sizes.withColumn("pool", F.sum(F.when(small, F.col("n")).otherwise(0)).over(by_lang))
    return pooled.select(
        "group",
        F.when(~small, F.concat(F.lit("1"), "group"))
        .when(F.col("pool") >= MIN_ROWS, F.concat(F.lit("2"), F.to_json(F.struct("lang"))))
        .otherwise("3").alias("key"),
    )


def _start(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Medians, and deviations from them as a diagonal covariance."""
    values = rows.select("key", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"x{i}").alias("v")) for i in range(DIMS)])).alias("c")).select("key", "c.*")
    centre = _medians(values).groupBy("key").agg(F.array_agg(F.struct("dim", "m")).alias("a")).select("key", F.array_sort("a")["m"].alias("centre"))
    centre = scratch.cut(centre)  # a plain table, so that the rows of a large group can be split
    away = values.join(centre, "key").select("key", "dim", F.abs(F.col("v") - F.get("centre", F.col("dim"))).alias("v"))
    spread = _medians(away).groupBy("key").agg(F.array_agg(F.struct("dim", "m")).alias("a")).select("key", F.array_sort("a")["m"].alias("spread"))
    least = F.array(*map(F.lit, LEAST_SPREAD))
    variance = F.zip_with("spread", least, lambda s, f: F.pow(s * 1.4826, 2) + f * f)
    precision = F.array(*[1 / F.col("variance")[i] if i == j else F.lit(0.0) for i, j in _PAIRS])
    return centre.join(spread, "key").withColumn("variance", variance).select("key", "centre", precision.alias("precision"))


def _medians(values: DataFrame) -> DataFrame:
    """(key, dim, m): medians to a hundredth, from counts of hundredths."""
    counts = values.groupBy("key", "dim", F.round(F.col("v") * 100).alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("key", "dim")
    at = counts.withColumns({"up_to": F.sum("n").over(whole.orderBy("bin")), "all": F.sum("n").over(whole)})
    return at.where(F.col("up_to") * 2 >= F.col("all")).groupBy("key", "dim").agg((F.min("bin") / 100).alias("m"))


def _binned(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Counts, sums and products by group and distance bin."""
    x = [F.col(f"x{i}") for i in range(DIMS)]
    away = [v - F.col("centre")[i] for i, v in enumerate(x)]
    squared = sum((away[i] * away[j] * F.col("precision")[k] * (1 if i == j else 2) for k, (i, j) in enumerate(_PAIRS)), F.lit(0.0))
    bins = F.floor(F.log2(F.greatest(squared, F.lit(2.0 ** -20))) * BINS).cast("int")
    # Sums are taken about the old centre, where they lose no digits.
    return (
        rows.join(fitted, "key").withColumns({"bin": bins} | {f"a{i}": v for i, v in enumerate(away)}).groupBy("key", "bin")
        .agg(
            F.count("*").alias("n"), F.first("centre").alias("centre"),
            F.array(*[F.sum(f"a{i}") for i in range(DIMS)]).alias("sums"),
            F.array(*[F.sum(F.col(f"a{i}") * F.col(f"a{j}")) for i, j in _PAIRS]).alias("products"),
        )
    )


def _up_to(moments: DataFrame, share: float) -> DataFrame:
    """The bins of each group up to the one that completes ``share`` of its rows."""
    whole = Window.partitionBy("key")
    at = moments.withColumns({"before": F.sum("n").over(whole.orderBy("bin")) - F.col("n"), "all": F.sum("n").over(whole)})
    return at.where(F.col("before") < F.col("all") * share)


def _concentrated(moments: DataFrame) -> DataFrame:
    core = _up_to(moments, CORE)
    return core.groupBy("key").agg(
        F.sum("n").alias("n"), F.first("centre").alias("centre"),
        F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMS)]).alias("sums"),
        F.array(*[F.sum(F.col("products")[k]) for k in range(len(_PAIRS))]).alias("products"),
    )


def _scaled(moments: DataFrame, fitted: DataFrame) -> DataFrame:
    """Widen the covariance of groups whose median distance exceeds that of a normal law; drop groups with too few rows."""
    half = _up_to(moments, 0.5).groupBy("key").agg(F.max("bin").alias("bin"))
    sizes = moments.groupBy("key").agg(F.sum("n").alias("n"))
    factor = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS) / MEDIAN)
    return fitted.join(half, "key").join(sizes.where(F.col("n") >= MIN_ROWS), "key").select(
        "key", "centre", F.transform("precision", lambda p: p / factor).alias("precision")
    )


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Means and inverse covariances from the sums of each group."""
    rows, columns = map(list, zip(*_PAIRS))
    for frame in frames:
        if frame.empty:
            continue
        n = frame.n.to_numpy(float)[:, None]
        shift = np.stack(frame.sums.to_list()) / n
        cov = np.zeros((len(frame), DIMS, DIMS))
        cov[:, rows, columns] = np.stack(frame.products.to_list()) / n - shift[:, rows] * shift[:, columns]
        cov[:, columns, rows] = cov[:, rows, columns]
        cov += np.diag(np.square(LEAST_SPREAD))
        precision = np.linalg.inv(cov)[:, rows, columns]
        centre = np.stack(frame.centre.to_list()) + shift
        yield pd.DataFrame({"key": frame.key, "centre": list(centre), "precision": list(precision)})
