import pytest
from pyspark.sql import functions as F

from workloads import streams


@pytest.mark.parametrize("file_rows, files", [(20, 8), (10**6, 1)])
def test_batches_of_several_files_stay_whole_and_in_order(spark, tmp_path, monkeypatch, file_rows, files):
    """Each batch is written by several tasks, unless it is too small for that, and comes back as one."""
    monkeypatch.setattr(streams, "FILE_ROWS", file_rows)
    rows = spark.range(900).select("id", F.when(F.col("id") % 9 != 0, F.col("id").cast("string")).alias("text"), (F.col("id") % 3).alias("batch"))
    path = f"{tmp_path}/feed"
    feed = streams.in_batches(rows, path, 3)
    assert feed.columns == ["id", "text"]
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() == 3 * files
    seen = []
    writer = feed.writeStream.foreachBatch(lambda batch, number: seen.append(sorted((r["id"], r["text"]) for r in batch.collect())))
    writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert seen == [[(i, str(i) if i % 9 else None) for i in range(n, 900, 3)] for n in range(3)]
