"""Exact top-k search by a Voronoi kNN join.

The highest inner products are made nearest neighbours: with M the
largest norm, a data vector x gets one more component sqrt(M^2 - |x|^2)
and a query q gets 0, and then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.

* Pivots (data vectors with the smallest hashes) divide queries and data
  into cells by nearest pivot.
* Summaries: each data cell's k + 1 smallest distances to its pivot, each
  query cell's largest.  For a query cell they give a distance within
  which every one of its queries has k candidates.
* A data row goes to a query cell only if its distance to its own pivot
  does not rule it out (triangle inequality with the pivots' distance).
* A cell's rows are dealt into blocks by size, so a hot cell is many
  small pieces; each (query block, data block) pair is solved on its own
  by integer products and gives at most k rows per query to the ranking.

Components are floor(64 x).  The driver gathers one row per cell only.

Defined cases: see ``vectors``; with fewer candidates than k all are
returned; ties go to the smaller id; an empty table gives no rows;
scores beyond 64-bit integers raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifetrail.llm.common import materialise
from lifetrail.llm.vectors import best_rows, matrix, usable, whole_partition

PIVOTS = 32
QUERY_BLOCK, DATA_BLOCK = 1024, 4096
FACTOR = 64.0
#: Distances are rounded; bounds give way by this much, relative to the largest norm.
SLACK = 1e-7


def integers(v: np.ndarray) -> np.ndarray:
    """floor(64 x), as whole doubles."""
    return np.floor(v * FACTOR)


def lifted(x: np.ndarray, top: float, query: bool) -> np.ndarray:
    """Integer vectors with the component that makes inner products distances; top: largest squared norm of data."""
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - (x ** 2).sum(axis=1), 0))
    return np.column_stack([x, extra])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    largest = q.shape[1] * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(x).max(initial=0))
    if largest < 1 << 53:
        return (q @ x.T).astype(np.int64)
    if largest < 1 << 63:
        return q.astype(np.int64) @ x.astype(np.int64).T
    raise ValueError("scores beyond 64-bit integers")


CELL_SCHEMA = "row long, vec_id long, v array<double>, cell int, dist double"
FOUND = "query_row long, query_id long, vec_id long, score long"


def _cells(dim: int, pivots: np.ndarray, top: float, query: bool):
    """Nearest pivot of each row, and the distance to it."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(integers(matrix(batch, dim)), top, query), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "vec_id", "v")), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["row", "vec_id", "v", "cell", "dist"])
    return run


def _smallest(k: int):
    """A task's k smallest distances of each cell."""
    def run(batches):
        t = whole_partition(batches)
        if t is not None:
            cell, dist = t.column("cell").to_numpy(), t.column("dist").to_numpy()
            for c in np.unique(cell):
                d = np.sort(dist[cell == c])[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), c, np.int32)), pa.array(d)], names=["cell", "dist"])
    return run


def _norms(dim: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float((integers(matrix(batch, dim)) ** 2).sum(axis=1).max())])], names=["top"])
    return run


def bounds(pivots: np.ndarray, near: dict[int, list[float]], reach: dict[int, float], k: int, top: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each query cell the least and largest distance from its pivot at which a row of each data cell can matter.

    near: each data cell's k smallest distances; reach: each query cell's largest one."""
    between = distances(pivots, pivots)
    slack = SLACK * (1 + np.sqrt(max(top, 0)) + max(reach.values(), default=0))
    out = {}
    for i, r in reach.items():
        ub = np.sort(np.concatenate([r + between[i, j] + np.array(d) for j, d in near.items()]))
        within = ub[k - 1] if len(ub) >= k else np.inf
        out[i] = between[i] - r - within - slack, between[i] + r + within + slack
    return out


def _solve(dim: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q_rows, q_ids, x_rows, x_ids = (t.column(c).to_numpy() for t in (left, right) for c in ("row", "vec_id"))
        out = [(np.zeros(0, np.int64),) * 4]
        if len(q_ids) and len(x_ids):
            order = np.argsort(x_ids, kind="stable")
            x_ids, x_rows = x_ids[order], x_rows[order]
            s = scores(integers(matrix(left, dim)), integers(matrix(right, dim))[order])
            place = np.argsort(x_rows)
            own = place[np.minimum(np.searchsorted(x_rows[place], q_rows), len(x_rows) - 1)]
            for i, q in enumerate(q_rows):
                row, ids = s[i], x_ids
                if x_rows[own[i]] == q:
                    row, ids = np.delete(row, own[i]), np.delete(ids, own[i])
                if len(row) > k:  # whatever ties with the k-th stays until the smaller ids are taken
                    on = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                    row, ids = row[on], ids[on]
                best = np.argsort(-row, kind="stable")[:k]
                out.append((np.full(len(best), q), np.full(len(best), q_ids[i]), ids[best], row[best]))
        return pa.table({c: pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i, c in enumerate(("query_row", "query_id", "vec_id", "score"))})
    return run


def search(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every row whose id ``every`` divides."""
    rows, dim = usable(vectors)
    rows = materialise(rows, "topk-vectors")
    spark = rows.sparkSession
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()  # ``pivots`` rows
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = rows.mapInArrow(_norms(dim), "top double").agg(F.max("top")).first()[0]
    centres = np.unique(lifted(integers(np.array([r["v"] for r in chosen], np.float64)), top, False), axis=0)
    data = materialise(rows.mapInArrow(_cells(dim, centres, top, False), CELL_SCHEMA), "topk-data")
    queries = materialise(rows.where(F.col("vec_id") % every == 0).mapInArrow(_cells(dim, centres, top, True), CELL_SCHEMA), "topk-queries")

    few = data.select("cell", "dist").mapInArrow(_smallest(k + 1), "cell int, dist double")
    near = {r["cell"]: r["d"] for r in few.groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("dist")), 1, k + 1).alias("d")).collect()}
    x_size = {r["cell"]: r["count"] for r in data.groupBy("cell").count().collect()}
    q_size = {r["cell"]: (r["n"], r["reach"]) for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("reach")).collect()}
    if not q_size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    limits = bounds(centres, near, {c: r for c, (_, r) in q_size.items()}, k + 1, top)  # k besides the query's own row

    x_blocks = {c: -(-n // data_block) for c, n in x_size.items()}
    q_blocks = {c: -(-n // query_block) for c, (n, _) in q_size.items()}
    pairs = [(i, j, float(limits[i][0][j]), float(limits[i][1][j]), q_blocks[i], x_blocks[j]) for i in q_blocks for j in x_blocks]
    plan = F.broadcast(spark.createDataFrame(pairs, "q_cell int, x_cell int, low double, high double, q_blocks int, x_blocks int"))  # pivots^2 rows at most
    block = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    x = data.join(plan, F.col("cell") == F.col("x_cell")).where((F.col("dist") >= F.col("low")) & (F.col("dist") <= F.col("high")))
    x = x.select("row", "vec_id", "v", "q_cell", "x_cell", block(F.col("x_blocks")).alias("x_block"), others(F.col("q_blocks")).alias("q_block"))
    q = queries.join(plan, F.col("cell") == F.col("q_cell"))
    q = q.select("row", "vec_id", "v", F.col("q_cell").alias("qc"), F.col("x_cell").alias("xc"), block(F.col("q_blocks")).alias("qb"), others(F.col("x_blocks")).alias("xb"))
    found = q.groupBy("qc", "qb", "xc", "xb").cogroup(x.groupBy("q_cell", "q_block", "x_cell", "x_block")).applyInArrow(_solve(dim, k), FOUND)
    return best_rows(found, k, descending=True)
