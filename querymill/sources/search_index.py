"""Substring search by an inverted index of trigrams, kept beside a table of texts.

The index holds, for every three characters in a row of a lower-cased text, the keys of the texts that have them, in Parquet partitioned by a hash of the trigram. A search reads
the partitions of the rarest few trigrams of its term, intersects their keys, and makes the exact test on those texts alone. Keys of texts that have gone since are
harmless: the exact test does not find them. Terms of fewer than three characters are looked for in every text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from querymill.operators.history import contains_term
from querymill.sources.store import PREFIX, hash_prefix

BUCKETS = 256
RAREST = 4  # trigrams of a term that are looked up
POSTINGS = 1 << 16  # rows of a batch of postings, and a text's more


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text; none if it is null or shorter."""
    def of(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))

    # Bound to a variable: an expression inside a lambda is worked out for every element.
    found = F.transform(F.array(F.split(F.lower(text), "")), of)[0]
    return F.when(F.length(text) >= 3, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def postings(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, gram): the distinct trigrams of each row's lower-cased texts, as ``trigrams`` has them."""
    lowered = rows.select(F.col(key).alias("key"), *[F.lower(F.col(c)).alias(f"text{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first, texts = [], 0, [column.to_pylist() for column in batch.columns[1:]]
            for row in range(len(batch)):
                found.append(_codes([t[row] for t in texts]))
                if sum(map(len, found)) >= POSTINGS or row == len(batch) - 1:
                    keys = np.repeat(np.arange(first, row + 1), list(map(len, found)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), _spelled(np.concatenate(found))], names=["key", "gram"])
                    found, first = [], row + 1

    return lowered.mapInArrow(run, T.StructType([lowered.schema["key"], T.StructField("gram", T.StringType())]))


def _codes(texts: list[str | None]) -> np.ndarray:
    """The distinct trigrams of some texts, as numbers: 21 bits for a character."""
    found = [np.empty(0, np.uint64)]
    for text in texts:
        chars = np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        if len(chars) >= 3:
            found.append(chars[:-2] << np.uint64(42) | chars[1:-1] << np.uint64(21) | chars[2:])
    return np.unique(np.concatenate(found))


def _spelled(codes: np.ndarray) -> pa.StringArray:
    chars = np.stack([codes >> np.uint64(42), codes >> np.uint64(21) & np.uint64(0x1FFFFF), codes & np.uint64(0x1FFFFF)], axis=1).astype("<u4")
    widths = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(widths.sum(axis=1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends.tobytes()), pa.py_buffer(chars.tobytes().decode("utf-32-le").encode()))


def add_to_index(rows: DataFrame, path: str, key: str, *columns: str) -> None:
    """Index the texts of ``columns``. Rows may be added in any number of goes; adding one again changes no result."""
    found = postings(rows, key, *columns).withColumn("bucket", bucket(F.col("gram")))
    # Dealt by bucket; a bucket with a trigram of most texts is split among tasks.
    found.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{path}/keys")
    counted = found.groupBy("bucket", "gram").agg(F.count("*").alias("texts"))
    counted.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/counts")


def _of_buckets(spark: SparkSession, path: str, buckets: list[int], schema: str) -> DataFrame:
    """Read in the partitions asked for only."""
    base = spark.read.schema(f"{schema}, bucket int").parquet(path)
    return base.where(F.col("bucket").isin(buckets))


def candidates(spark: SparkSession, path: str, term: str, key_type: str = "string") -> DataFrame | None:
    """(key) of all texts that may hold the term, and of some others; None if the term is too short to tell."""
    # No more rows than the term has characters.
    wanted = [tuple(r) for r in spark.range(1).select(F.explode(trigrams(F.lit(term))).alias("gram")).select("gram", bucket(F.col("gram"))).collect()]
    if not wanted:
        return None
    names, buckets = [g for g, _ in wanted], sorted({b for _, b in wanted})
    counted = _of_buckets(spark, f"{path}/counts", buckets, "gram string, texts long").where(F.col("gram").isin(names))
    texts = {r["gram"]: r["texts"] for r in counted.groupBy("gram").agg(F.sum("texts").alias("texts")).collect()}
    rarest = sorted(wanted, key=lambda w: (texts.get(w[0], 0), w[0]))[:RAREST]
    keys = _of_buckets(spark, f"{path}/keys", sorted({b for _, b in rarest}), f"key {key_type}, gram string").where(F.col("gram").isin([g for g, _ in rarest]))
    return keys.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest)).select("key")


def search(rows: DataFrame, path: str, term: str, key: str, *columns: str) -> DataFrame:
    """The rows of which a column holds the term, whatever its case: what ``contains_term`` over all rows gives.

    ``path`` is the index of those columns. A store is read in the partitions that candidates belong to.
    """
    found = candidates(rows.sparkSession, path, term, rows.schema[key].dataType.simpleString())
    if found is not None:
        found = found.withColumnRenamed("key", key)
        if PREFIX in rows.columns:
            # At most 256 values.
            touched = [r[0] for r in found.select(hash_prefix(key)).distinct().collect()]
            rows = rows.where(F.col(PREFIX).isin(touched))
        rows = rows.join(found, key, "left_semi")
    return rows.where(contains_term(term, *columns))
