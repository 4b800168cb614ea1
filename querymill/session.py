"""Session settings, and scratch tables: the one way to cut lineage."""

import atexit
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Passed to the session builder by bench and tests; on a cluster set them in spark-defaults.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Pages are large: keep Arrow batches small enough for a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it.

    Only a local session may go without one: it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="querymill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems; a missing one is fine."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that one job writes in the shared folder, and removes.

    As a context manager it removes them at its end. A job that returns a lazy DataFrame drops what its
    result no longer reads and leaves the rest to ``close()`` or to the end of the program.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self._last)

    def path(self, name: str = "table") -> str:
        self.made += 1
        return f"{self.root}/{self.made:04d}-{name}"

    def cut(self, df: DataFrame) -> DataFrame:
        """Write the rows and go on from there.

        Rather than ``checkpoint()`` because later steps then read only the columns they need, and Spark
        knows the size.
        """
        path = self.path()
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing lazy reads any more."""
        for table in tables:
            remove(self.spark, table._scratch_path)

    def close(self) -> None:
        atexit.unregister(self._last)
        remove(self.spark, self.root)

    def _last(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the session may be gone already, with its folder
            pass

    def __enter__(self):
        self.outer = _owner.set(self)
        return self

    def __exit__(self, *_):
        _owner.reset(self.outer)
        self.close()


_owner: ContextVar[Scratch | None] = ContextVar("owner", default=None)


def cut(df: DataFrame) -> DataFrame:
    """A scratch table of the job whose ``with Scratch(...)`` this is in; without one it stays until the program ends."""
    return (_owner.get() or Scratch(df.sparkSession)).cut(df)
