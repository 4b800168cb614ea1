"""The result store: one row per query hash, Parquet partitioned by the hash's first two digits.

Inserts read the key column of the partitions they write to and append, look-ups read only the partitions of the hashes asked
for, deletes rewrite only the partitions that lose rows. One writer at a time per store.

A rewrite is written beside the store and published by one rename, that of the folder that lists the partitions it takes the place of, from ``touched`` to ``ready``.
From then on readers take those partitions from there, until they are moved into place. So a driver may be lost at any point: before the rename the rewrite has not
happened, after it it has. ``repair``, which every writer begins with, ends the one and removes the other.
"""

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from querymill.functions.text import document_text, iso_timestamp
from querymill.operators.answers import array_rollup
from querymill.schemas import RESULT_STORE, STORED_RECORD
from querymill.session import Scratch

PREFIX = "hash_prefix"
COLUMNS = RESULT_STORE.fieldNames()


def hash_prefix(col: Column | str = "query_hash") -> Column:
    return F.substring(col, 1, 2)


def to_store_row(answers: DataFrame) -> DataFrame:
    """Answered queries to stored rows: page counts, 0.0 for a missing time, the searched text."""
    good, total, _ = array_rollup(F.col("scraped_content"))
    return answers.withColumns(
        {
            "pages_scraped": good.cast("int"),
            "total_content_length": total,
            "execution_time": F.coalesce("execution_time", F.lit(0.0)),
            "document": document_text(F.col("query"), F.col("summary.summary")),
        }
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_STORE.fields])


def encode_result(store: DataFrame) -> DataFrame:
    """Key and the nested record as JSON text, times in ISO form."""
    record = F.struct(
        "query",
        "query_hash",
        F.struct(
            "status", "confidence", "reason", F.lit(None).cast("array<string>").alias("suggested_improvements")
        ).alias("classification"),
        "scraped_content",
        "summary",
        "embedding",
        iso_timestamp(F.col("created_at")).alias("created_at"),
        "execution_time",
        F.lit(False).alias("cache_hit"),
    )
    return store.select("query_hash", F.to_json(record).alias("full_result"))


def decode_result(df: DataFrame, column: str = "full_result") -> DataFrame:
    """The nested record read back from its JSON text."""
    return df.withColumn("result", F.from_json(column, STORED_RECORD.simpleString())).drop(column)


def mark_hit(result: Column) -> Column:
    """A record served from the store says so."""
    return result.withField("cache_hit", F.lit(True))


def first_per_key(rows: DataFrame, key: str = "query_hash", order: str = "created_at") -> DataFrame:
    """First write per key wins. Each task keeps one row per key before the shuffle."""
    window = Window.partitionBy(key).orderBy(order, *[c for c in ("query",) if c in rows.columns])
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") == 1).drop("_n")


def without_keys(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("query_hash"), "query_hash", "left_anti")


def with_keys(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("query_hash"), "query_hash", "left_semi")


def new_rows(store: DataFrame, rows: DataFrame) -> DataFrame:
    """What an insert would add: the first row of each key the store does not have."""
    fresh = first_per_key(rows)
    if PREFIX not in store.columns:
        return without_keys(fresh, store)
    held = store.select(PREFIX, "query_hash")
    return fresh.withColumn(PREFIX, hash_prefix()).join(held, [PREFIX, "query_hash"], "left_anti").select(*rows.columns)


def not_expired(store: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    """Results never expire unless a number of days is given."""
    return store if days is None else store.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows; an absent store is an empty one. Reads what a published rewrite holds, whether or not it is in place yet."""
    files, ready = _files(spark, path), _ready(_files(spark, path), path)
    if not ready:
        return _read(spark, path)
    # One rewrite, as every writer ends what it finds; a partition in it has no rows left, or new ones that may be in place already.
    parts, taken = [], set()
    for side in ready:
        new = [p for p in files.names(f"{side}/new") if p.startswith(PREFIX)]
        parts.append(_read(spark, f"{side}/new", sorted(new)))
        taken |= {p for p in files.names(f"{side}/ready") if p in new or not files.exists(f"{side}/ready/{p}/filled")}
    rest = sorted(p for p in files.names(path) if p.startswith(PREFIX) and p not in taken)
    return reduce(DataFrame.unionByName, parts, _read(spark, path, rest))


def _read(spark: SparkSession, base: str, parts: list[str] | None = None) -> DataFrame:
    schema = T.StructType([*RESULT_STORE.fields, T.StructField(PREFIX, T.StringType())])
    if parts is not None and not parts:
        return spark.createDataFrame([], schema)
    try:
        reader = spark.read.schema(schema).option("basePath", base)
        return reader.parquet(*([base] if parts is None else [f"{base}/{p}" for p in parts]))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def lookup(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored rows of the given keys. Joined on the partition column too, so that Spark can prune."""
    if PREFIX not in store.columns:
        return with_keys(store, keys)
    wanted = keys.select("query_hash", hash_prefix().alias(PREFIX)).distinct()
    return store.join(wanted, [PREFIX, "query_hash"], "left_semi")


def insert_results(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Insert if absent. Running it again with the same rows adds nothing. Reads the keys of the partitions that the new rows belong to."""
    repair(spark, path)
    with Scratch(spark) as scratch:
        fresh = scratch.cut(first_per_key(rows.select(*COLUMNS)).withColumn(PREFIX, hash_prefix()))
        held = _held(scan_store(spark, path), fresh)
        fresh.join(held, "query_hash", "left_anti").hint("rebalance", PREFIX).write.mode("append").partitionBy(PREFIX).parquet(path)


def _held(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """Keys of the partitions that ``fresh`` has rows for."""
    # At most 256 values.
    touched = [r[0] for r in fresh.select(PREFIX).distinct().collect()]
    return store.where(F.col(PREFIX).isin(touched)).select("query_hash")


def delete_results(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Delete by key; unknown keys are no error. Rewrites the partitions that lose rows."""
    repair(spark, path)
    store = scan_store(spark, path)
    # At most 256 values.
    touched = [r[0] for r in lookup(store, keys).select(PREFIX).distinct().collect()]
    if not touched:
        return
    survivors = without_keys(store.where(F.col(PREFIX).isin(touched)), keys)
    _rewrite(spark, path, survivors, [f"{PREFIX}={value}" for value in touched])


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite every partition into as few files as their size asks for; rows stay as they are. One writer at a time."""
    repair(spark, path)
    held = [p for p in _files(spark, path).names(path) if p.startswith(PREFIX)]
    if held:
        _rewrite(spark, path, scan_store(spark, path).hint("rebalance", PREFIX), held)


def clear(spark: SparkSession, path: str) -> None:
    """Remove all rows; the store stays usable."""
    repair(spark, path)
    held = [p for p in _files(spark, path).names(path) if p.startswith(PREFIX)]
    if held:
        _rewrite(spark, path, None, held)


def repair(spark: SparkSession, path: str) -> None:
    """End the rewrites that were published, and remove what is left of those that were not."""
    files = _files(spark, path)
    for name in files.names(path):
        if name.startswith("_swap-") and files.exists(f"{path}/{name}/ready"):
            _move_in(files, path, name)
        elif name.startswith(("_swap-", "_done-")):
            files.delete(f"{path}/{name}")


def _rewrite(spark: SparkSession, path: str, rows: DataFrame | None, touched: list[str]) -> None:
    """Let ``rows`` take the place of the partitions ``touched``."""
    files, name = _files(spark, path), f"_swap-{uuid.uuid4().hex}"
    side = f"{path}/{name}"
    if rows is not None:
        rows.write.partitionBy(PREFIX).parquet(f"{side}/new")
    for part in touched:
        files.mkdirs(f"{side}/touched/{part}/filled" if files.exists(f"{side}/new/{part}") else f"{side}/touched/{part}")
    files.rename(f"{side}/touched", f"{side}/ready")
    _move_in(files, path, name)


def _move_in(files: "_files", path: str, name: str) -> None:
    """Every step may have been done before. Old files go while the new ones can be read where they are; what is over goes after a last rename."""
    side = f"{path}/{name}"
    for part in files.names(f"{side}/ready"):
        if files.exists(f"{side}/new/{part}"):
            files.delete(f"{path}/{part}")
            files.rename(f"{side}/new/{part}", f"{path}/{part}")
        elif not files.exists(f"{side}/ready/{part}/filled"):
            files.delete(f"{path}/{part}")
    done = f"{path}/{name.replace('_swap-', '_done-')}"
    files.rename(side, done)
    files.delete(done)


def _ready(files: "_files", path: str) -> list[str]:
    return [f"{path}/{n}" for n in files.names(path) if n.startswith("_swap-") and files.exists(f"{path}/{n}/ready")]


def store_size(spark: SparkSession, path: str) -> DataFrame:
    """Entry count and bytes on disk, both from file metadata."""
    if not _files(spark, path).exists(path):
        return spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in ("total_entries", "total_size_bytes")])
    files = scan_store(spark, path).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(
        F.max("file_size").alias("bytes"), F.count("*").alias("entries")
    )
    return files.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("total_entries"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size_bytes"),
    )


class _files:
    """The few Hadoop file system calls needed: works for any scheme Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path):
        return self._fs.exists(self._path(path))

    def names(self, path):
        """What a folder holds; nothing if there is none."""
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(path))] if self.exists(path) else []

    def mkdirs(self, path):
        self._fs.mkdirs(self._path(path))

    def rename(self, old, new):
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def delete(self, path):
        self._fs.delete(self._path(path), True)
