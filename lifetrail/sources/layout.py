"""Table layout in place of secondary indexes: the fact bucketed by user.

The fact is written as a catalog table in ``buckets`` buckets of the user's
hash, sorted by user inside each.  Aggregates per user then read each
bucket's runs without an exchange, and a user's rows lie in one bucket's
files.  A bucket is dealt, sorted, written and read by one task, so the
number of buckets must grow with the fact (``buckets_of``).  A user of a third of all rows makes one bucket large: its rows are
split into several files and aggregated by the one task of that bucket, so
the layout fits tables whose largest user is small beside a task; for others
the partial aggregation of the unbucketed table is the better plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifetrail.sources.files import input_bytes, typed_transactions

#: Input files per bucket (compressed columns; the rows sorted by a task take some ten times as much), and the fewest buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 8


def bucket_transactions(raw: DataFrame, table: str, buckets: int, path: str | None = None, mode: str = "overwrite") -> None:
    """Write the typed fact bucketed and sorted by user.

    Rows are dealt to the buckets before the write, so a bucket is written
    by one task and is one file."""
    out = typed_transactions(raw).repartition(buckets, "user_id")
    w = out.write.mode(mode).bucketBy(buckets, "user_id").sortBy("user_id").format("parquet")
    (w.option("path", path) if path else w).saveAsTable(table)


def buckets_for(fact_bytes: int, target_bytes: int = 512 << 20) -> int:
    """A power of two that gives buckets of about ``target_bytes``."""
    return 1 << max(0, (max(1, fact_bytes) - 1) // target_bytes).bit_length()


def buckets_of(raw: DataFrame) -> int:
    """Buckets for a fact read from files: their number grows with the files, a task's share does not."""
    return max(LEAST_BUCKETS, buckets_for(input_bytes(raw), BUCKET_BYTES))


def bucket_sizes(spark: SparkSession, table: str) -> DataFrame:
    """(file, rows) of a bucketed table: how even its buckets are."""
    return spark.table(table).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))
