"""Loads that count: a log of batches below a root folder.

A batch's data are written first, each table to a folder of the batch's
own; then one JSON row in ``log/`` makes them count.  Whoever stops before
has changed nothing.  A merged batch names the folders it replaces.  Two
writers cannot log the same number: the second one's write fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG = "number long, batch string, replaces array<string>, note string, rows long"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def log(spark: SparkSession, root: str) -> list:
    """The logged batches by number."""
    path, fs = _hadoop(spark, f"{root}/log")
    if not fs.exists(path):
        return []
    return sorted(spark.read.schema(LOG).json(f"{root}/log/*").collect(), key=lambda r: r["number"])


def folder_of(number: int, batch: str) -> str:
    return f"{number:08d}-{batch}"


def counting(rows: list) -> list[tuple[int, str]]:
    """(number, folder) of the batches that count: logged and not replaced."""
    gone = {b for r in rows for b in r["replaces"] or ()}
    return [(r["number"], folder_of(r["number"], r["batch"])) for r in rows if folder_of(r["number"], r["batch"]) not in gone]


def next_number(rows: list) -> int:
    return rows[-1]["number"] + 1 if rows else 1


def commit(spark: SparkSession, root: str, number: int, batch: str, replaces: list[str], note: str, rows: int) -> None:
    row = spark.createDataFrame([(number, batch, replaces, note, rows)], LOG)
    row.coalesce(1).write.mode("errorifexists").json(f"{root}/log/{number:08d}")


def vacuum(spark: SparkSession, root: str, tables) -> list[str]:
    """Delete folders that do not count (replaced, or left by a run that
    stopped); the log keeps the batches' names.  Not while a batch is added."""
    live, removed = {f for _, f in counting(log(spark, root))}, []
    for name in tables:
        path, fs = _hadoop(spark, f"{root}/{name}")
        for status in fs.listStatus(path) if fs.exists(path) else ():
            folder = status.getPath().getName()
            if folder.removeprefix("load=") not in live:
                fs.delete(status.getPath(), True)
                removed.append(f"{name}/{folder}")
    return sorted(removed)


# ---------------------------------------------------------------- a partitioned table of loads
def read_loads(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows that count (None: there is no load); ``load`` names their folder."""
    live = counting(log(spark, root))
    return spark.read.option("basePath", f"{root}/data").parquet(*(f"{root}/data/load={f}" for _, f in live)) if live else None


def load_bytes(spark: SparkSession, root: str) -> dict[str, tuple[int, int]]:
    """Bytes and data files of every load that counts."""
    out = {}
    for _, folder in counting(log(spark, root)):
        path, fs = _hadoop(spark, f"{root}/data/load={folder}")
        summary = fs.getContentSummary(path)
        out[folder] = (summary.getLength(), summary.getFileCount())
    return out


def add_load(df: DataFrame, root: str, batch: str, partition_by: tuple, sort_by: tuple = ()) -> int:
    """Write ``df`` as a load of its own; returns its rows (0: the batch is already there).

    A rebalance by the partition columns gives files by bytes, not by tasks."""
    spark = df.sparkSession
    done = log(spark, root)
    if any(r["batch"] == batch for r in done):
        return 0
    number = next_number(done)
    path = f"{root}/data/load={folder_of(number, batch)}"
    _write(df, path, partition_by, sort_by)
    rows = spark.read.schema(df.schema).parquet(path).count()
    commit(spark, root, number, batch, [], "", rows)
    return rows


def _write(df: DataFrame, path: str, partition_by: tuple, sort_by: tuple) -> None:
    out = df.hint("rebalance", *partition_by) if partition_by else df
    out = out.sortWithinPartitions(*partition_by, *sort_by) if (*partition_by, *sort_by) else out
    w = out.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def merge_small(spark: SparkSession, root: str, partition_by: tuple, sort_by: tuple = (), small_bytes: int = 128 << 20, most_loads: int = 8) -> bool:
    """Merge the loads below ``small_bytes`` into one when there are more
    than ``most_loads`` of them, so files grow with the bytes and not with
    the number of batches."""
    small = [f for f, (n, _) in load_bytes(spark, root).items() if n < small_bytes]
    if len(small) <= most_loads:
        return False
    number = next_number(log(spark, root))
    rows = spark.read.option("basePath", f"{root}/data").parquet(*(f"{root}/data/load={f}" for f in small)).drop("load")
    _write(rows, f"{root}/data/load={folder_of(number, 'merged')}", partition_by, sort_by)
    commit(spark, root, number, "merged", small, "", 0)
    return True
