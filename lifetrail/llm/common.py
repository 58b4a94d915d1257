"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lifetrail
from lifetrail.config import ensure_checkpoint_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


#: Rows of an Arrow batch, on the way to a Python worker and back.  Spark's
#: default of 10,000 whole texts takes hundreds of MB in each task.
ARROW_ROWS = 1_000


#: A worker that holds more than this hands free memory back between groups.
LEAN_BYTES = 256 << 20


def release() -> None:
    """Give the system what Arrow and the allocator hold of freed arrays: an
    idle Python worker keeps it otherwise, beside a full Java heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator than glibc's
        pass


def release_if_large() -> None:
    try:
        with open("/proc/self/statm") as f:
            held = int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except OSError:  # not Linux
        return
    if held > LEAN_BYTES:
        release()


def lean(run):
    """``run`` (batches to batches), handing free memory back when a task ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return wrapped


def ship(spark: SparkSession) -> None:
    """Prepare a session for these operators: give the executors this
    package, once per application (the driver's import path need not exist
    there), and lower Arrow's batch size where it is Spark's default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if not getattr(sc, "_lifetrail_shipped", False):
        package = Path(lifetrail.__file__).parent
        archive = Path(tempfile.mkdtemp()) / "lifetrail.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"lifetrail/{f.relative_to(package)}")
        sc.addPyFile(str(archive))
        sc._lifetrail_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of intermediate files that this application has made, oldest first.
WRITTEN: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files below the shared folder that
    ``spark.checkpoint.dir`` names; it goes when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    WRITTEN.append(str(fs.makeQualified(hadoop_path).toString()))
    return WRITTEN[-1]


def drop_written(spark: SparkSession, start: int, keep: str) -> None:
    """Delete the folders made since ``start`` (a length of ``WRITTEN``) but ``keep``, the one whose table is still read."""
    for path in WRITTEN[start:]:
        if path != keep:
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    WRITTEN[start:] = [keep]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written to the shared folder."""
    path = f"{scratch_dir(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``materialise``, bucketed by ``key``: a later grouping or join on
    ``key`` reads the table without shuffling it.  The catalog knows the
    table only while it is opened."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, name)}/table"
    table_name = f"llm_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(table_name)
    opened = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")  # an external table: its files stay
    return opened


def whole_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of every document, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
