"""Incremental ingest of arriving transaction files (A2).

The original loads a large CSV in bounded chunks (first chunk replaces the
table, later chunks append).  Here that is a Structured Streaming file
source with ``trigger(availableNow=True)``: each run processes every file
that arrived since the last run, in bounded micro-batches
(``maxFilesPerTrigger``), and appends exactly once to the columnar table;
the checkpoint records which files were taken.  Re-running with no new
files writes nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lifetrail.sources.batches import add_load, merge_small
from lifetrail.sources.files import TRANSACTION_RENAMES, TRANSACTION_SCHEMA, typed_transactions


def _committed_rows(spark: SparkSession, out_path: str) -> int:
    """Rows of the files that the sink has committed (Parquet footers only)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_spark_metadata")):
        return 0
    return spark.read.parquet(out_path).count()


def _run(spark: SparkSession, writer, out_path: str) -> int:
    """Run to the end; the rows appended are counted from what the sink
    committed, since progress reports keep the latest batches only."""
    before = _committed_rows(spark, out_path)
    writer.start(out_path).awaitTermination()
    return _committed_rows(spark, out_path) - before


def ingest_csv_stream(spark: SparkSession, src_dir: str, out_path: str, checkpoint_path: str,
                      max_files_per_trigger: int | None = None, partition_by=("tx_year",)) -> int:
    """Append the rows of new CSV files under ``src_dir`` to the parquet
    table at ``out_path``; returns the number of rows appended in this run.

    ``checkpoint_path`` must be on storage shared by the cluster (for
    example under ``spark.checkpoint.dir``)."""
    reader = spark.readStream.schema(TRANSACTION_SCHEMA).option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = typed_transactions(reader.csv(src_dir).withColumnsRenamed(TRANSACTION_RENAMES))
    writer = (stream.writeStream.format("parquet")
              .option("checkpointLocation", checkpoint_path)
              .outputMode("append")
              .trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _run(spark, writer, out_path)


def ingest_parquet_stream(spark: SparkSession, src_dir: str, schema, out_path: str, checkpoint_path: str,
                          max_files_per_trigger: int | None = None, partition_by=()) -> int:
    """Same as ``ingest_csv_stream`` for a parquet landing folder with a
    known schema (for example day files of an event feed)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    writer = (reader.parquet(src_dir).writeStream.format("parquet")
              .option("checkpointLocation", checkpoint_path).outputMode("append")
              .trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _run(spark, writer, out_path)


def ingest_csv_loads(spark: SparkSession, src_dir: str, root: str, checkpoint_path: str, max_bytes: str | None = "1g", max_files: int | None = None,
                     small_bytes: int = 128 << 20, most_loads: int = 8) -> int:
    """Add the rows of new CSV files under ``src_dir`` to the table of loads
    below ``root`` (``sources.batches.read_loads`` reads it); returns the
    rows added.

    A micro-batch takes at most ``max_bytes`` of files (one larger file is
    a batch of its own) and becomes one load, rebalanced by year.  A batch
    that runs again, because its run stopped before the checkpoint knew of
    it, finds its load in the log and adds nothing.  Small loads are merged
    at the end, so files grow with the bytes."""
    reader = spark.readStream.schema(TRANSACTION_SCHEMA).option("header", True)
    for name, value in (("maxBytesPerTrigger", max_bytes if not max_files else None), ("maxFilesPerTrigger", max_files)):
        if value:
            reader = reader.option(name, value)
    stream = typed_transactions(reader.csv(src_dir).withColumnsRenamed(TRANSACTION_RENAMES))
    added = [0]

    def load(batch, batch_id: int) -> None:
        added[0] += add_load(batch, root, f"stream-{batch_id}", ("tx_year",), ("user_id",))

    stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start().awaitTermination()
    merge_small(spark, root, ("tx_year",), ("user_id",), small_bytes, most_loads)
    return added[0]
