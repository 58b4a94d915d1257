"""What the two vector searches share.

Rows that take part have an id and a vector without null or non-finite
components, of the table's most frequent dimension (the larger of equally
frequent ones).  Every row counts: an id that stands in several rows is
several queries or candidates, and a query meets all rows but its own, also
those with its id.  Rows are told apart by ``row``, a number that is theirs
once the table is written; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, allow_zero: bool = True) -> tuple[DataFrame, int]:
    """``row, vec_id, v`` (array of double) of the rows that take part, and their dimension.  To be written before use."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    if not allow_zero:
        v = v.where(F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    return v.where(F.size("v") == dim).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), dim


def matrix(batch: pa.RecordBatch | pa.Table, dim: int, column: str = "v") -> np.ndarray:
    values = batch.column(column)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(values), dim)


def whole_partition(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def packed_blocks(rows: DataFrame, dim: int, number: int) -> DataFrame:
    """Deal ``row, vec_id, v`` evenly into ``number`` blocks: ``block, rows, ids, data`` (matrices of doubles as bytes)."""
    def pack(batches):
        t = whole_partition(batches)
        if t is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([t.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("row", "vec_id")), pa.array([matrix(t, dim).tobytes()], pa.binary())],
                names=["block", "rows", "ids", "data"])
    return rows.repartition(number).mapInArrow(pack, "block int, rows binary, ids binary, data binary")


def unpacked(block: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(block["ids"], "<i8")
    return np.frombuffer(block["rows"], "<i8"), ids, np.frombuffer(block["data"], np.float64).reshape(len(ids), dim)


def best_rows(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k best of each query row's partial results, ranked from 1, ties to the smaller id."""
    score = F.col("score").desc() if descending else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(score, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
