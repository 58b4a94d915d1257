"""Nearest neighbours by a block matrix join with quantised products.

Vectors are dealt into blocks.  A task gets one block of queries and one
of data: tiles of int8 codes are multiplied, which gives distances up to
a known error (each vector is within the norm of its quantisation
residual of its decoded code, so a true distance differs from the decoded
one by at most the sum of both residuals).  A pair survives if it can
still be among the query's k nearest by these bounds; survivors are
computed again from the original vectors in double precision and kept in
a heap of size k per query.  Since the bounds are safe the result is
exact.  The heaps of all tiles are merged by a ranking per query.

The query set is stated (rows whose id a number divides), so the join is
blocks of queries against blocks of data, and a task's memory is bounded
by two blocks and one tile.  A query brings at most k rows per data block
to the merge.

Defined cases: see ``vectors``; zero vectors take no part either; with
fewer candidates than k all are returned; ties go to the smaller id; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifetrail.llm.common import materialise
from lifetrail.llm.vectors import best_rows, packed_blocks, unpacked, usable

QUERY_BLOCK, DATA_BLOCK = 2048, 4096
TILE_QUERIES, TILE_ROWS = 256, 2048


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and residual norm (rounded up) of each row."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    code = np.rint(v / scale[:, None]).clip(-127, 127).astype(np.int8)
    residual = np.sqrt(((v - code * scale[:, None]) ** 2).sum(axis=1))
    return code, scale, residual * (1 + 1e-9)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes (single precision holds sums below 2^24)."""
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return a.astype(kind) @ b.astype(kind).T


def euclidean(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of one vector to many, summed in the order of the components."""
    square = (x - q) ** 2
    return np.sqrt(np.cumsum(square, axis=1)[:, -1])


def nearest_in_tiles(q_rows, q, x_rows, x_ids, x, k: int) -> list[list[tuple[float, int]]]:
    """Each query's k nearest rows of a data block as (distance, id)."""
    q_code, q_scale, q_res = quantise(q)
    x_code, x_scale, x_res = quantise(x)
    q_norm = (q_scale * np.sqrt((q_code.astype(np.float64) ** 2).sum(1))) ** 2
    x_norm = (x_scale * np.sqrt((x_code.astype(np.float64) ** 2).sum(1))) ** 2
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_rows]
    for qa in range(0, len(q_rows), TILE_QUERIES):
        qs = slice(qa, qa + TILE_QUERIES)
        for xa in range(0, len(x_ids), TILE_ROWS):
            xs = slice(xa, xa + TILE_ROWS)
            dot = products(q_code[qs], x_code[xs]).astype(np.float64) * (q_scale[qs, None] * x_scale[None, xs])
            whole = q_norm[qs, None] + x_norm[None, xs]
            square = np.maximum(whole - 2 * dot, 0)
            # the rounding of the sums is far below this slack
            slack = q_res[qs, None] + x_res[None, xs] + np.sqrt(whole) * 1e-6
            decoded = np.sqrt(square)
            low, high = decoded - slack, decoded + slack
            same = q_rows[qs, None] == x_rows[None, xs]
            low[same] = high[same] = np.inf
            at = min(k, low.shape[1]) - 1
            limit = np.partition(high, at, axis=1)[:, at]
            if low.shape[1] < k:
                limit = np.full(len(limit), np.inf)
            for i in range(low.shape[0]):
                heap = heaps[qa + i]
                bound = min(limit[i], heap[-1][0]) if len(heap) >= k else limit[i]
                on = np.flatnonzero((low[i] <= bound) & ~same[i])
                if on.size:
                    exact = euclidean(q[qa + i], x[xs][on])
                    heaps[qa + i] = heapq.nsmallest(k, heapq.merge(heap, sorted(zip(exact.tolist(), x_ids[xs][on].tolist()))))
    return heaps


def _tile(dim: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for qb in left.select(["rows", "ids", "data"]).to_pylist():
            q_rows, q_ids, q = unpacked(qb, dim)
            for xb in right.select(["rows", "ids", "data"]).to_pylist():
                x_rows, x_ids, x = unpacked(xb, dim)
                for row, i, heap in zip(q_rows.tolist(), q_ids.tolist(), nearest_in_tiles(q_rows, q, x_rows, x_ids, x, k)):
                    out += [(row, i, v, d) for d, v in heap]
        return pa.table({**{c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("query_row", "query_id", "vec_id"))}, "score": pa.array([r[3] for r in out], pa.float64())})
    return run


def search(vectors: DataFrame, k: int = 10, every: int = 100, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of every row whose id ``every`` divides."""
    rows, dim = usable(vectors, allow_zero=False)
    rows = materialise(rows, "ann-vectors")
    n, n_queries = rows.count(), rows.where(F.col("vec_id") % every == 0).count()
    if not n_queries:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_data, n_query = -(-n // data_block), -(-n_queries // query_block)
    data = materialise(packed_blocks(rows, dim, n_data), "ann-data")
    queries = materialise(packed_blocks(rows.where(F.col("vec_id") % every == 0), dim, n_query), "ann-queries")
    pairs_q = queries.select("rows", "ids", "data", F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_data - 1))).alias("d"))
    pairs_x = data.select("rows", "ids", "data", F.col("block").alias("d2"), F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("q2"))
    found = pairs_q.groupBy("q", "d").cogroup(pairs_x.groupBy("q2", "d2")).applyInArrow(_tile(dim, k), "query_row long, query_id long, vec_id long, score double")
    return best_rows(found, k, descending=False)
