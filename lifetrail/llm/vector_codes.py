"""Vector codes: product quantisation in integers with equal-average search.

Vectors become integers, ``floor(scale * x)``, and are cut into ``parts``
equal consecutive parts.  Each part position has a codebook of at most
``entries`` integer entries, which starts as that part of the smallest ids
and is refined for ``rounds`` rounds: every part goes to its nearest entry,
then every entry becomes the floor of its parts' mean (unused entries stay).

Equal-average search finds the nearest entry: entries stand in the order of
their component sums, and a part's search starts where its own sum would
stand and walks outward, nearest sum first.  By the Cauchy-Schwarz
inequality the squared distance is at least the squared gap of the sums
over the dimension, so the walk ends when that strictly exceeds the best
distance (an equal one could still hold an equally near entry of lower
index).  All parts of a batch walk together.

A round is one pass over the vectors: each task sums its parts by (position,
entry), Spark adds the sums, and the driver holds the codebooks only
(``entries`` x dimension integers, whatever the number of vectors).

Defined cases: rows whose vector is null or holds null or non-finite
components are left out; so are vectors that are not of the table's most
frequent length among the multiples of ``parts`` (the larger of equally
frequent ones) and vectors with a component so large that their error need
not fit a long (``component_bound``).  Repeated ids are rows of their own;
equal ids stand in the order of their vectors, null ids last.  Fewer rows
than ``entries`` give smaller codebooks; an empty table gives no rows.
Null labels count as one label.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lifetrail.llm.common import materialise
from lifetrail.llm.vectors import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Label totals are repeated so often, so that a label of a third of all rows meets them in several tasks.
SALTS = 16
#: Vectors that walk together.
BLOCK = 8192


def component_bound(dim: int, parts: int, scale: int) -> float:
    """Components from this size on are left out: squared sums and distances below it fit a long."""
    return 2.0 ** 30 / (dim / parts ** 0.5) / scale


def kept_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id, label, v`` of the rows that take part, and their dimension (0: there are none)."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size("v") > 0) & (F.size("v") % parts == 0))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    far = F.exists("v", lambda x: F.abs(x) >= (component_bound(dim, parts, scale) if dim else 0.0))
    return v.where((F.size("v") == dim) & ~far), dim


def integers(batch, dim: int, parts: int, scale: int) -> np.ndarray:
    """A batch's vectors as integers: vectors x parts x components of a part."""
    return np.floor(matrix(batch, dim) * scale).astype(np.int64).reshape(batch.num_rows, parts, dim // parts)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (the lowest of equally near ones) and squared distance of the nearest entry of each row of ``x``."""
    n, d = x.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, book = sums[order], book[order]
    own = x.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    none = np.int64(1) << np.int64(62)
    best, at = np.full(n, none // d, np.int64), np.full(n, len(book), np.int64)
    walking = np.arange(n)
    last = len(book) - 1
    while walking.size:
        lo, hi, mine = left[walking], right[walking], own[walking]
        down = np.where(lo >= 0, mine - sums[np.maximum(lo, 0)], none)
        up = np.where(hi <= last, sums[np.minimum(hi, last)] - mine, none)
        to_left = down <= up
        gap = np.where(to_left, down, up)
        on = gap < none
        on[on] = gap[on] * gap[on] <= best[walking[on]] * d
        walking, to_left = walking[on], to_left[on]
        entry = np.where(to_left, lo[on], hi[on])
        gaps = x[walking] - book[entry]
        far = np.einsum("nd,nd->n", gaps, gaps)
        index = order[entry]
        held, was = best[walking], at[walking]
        better = (far < held) | ((far == held) & (index < was))
        best[walking[better]], at[walking[better]] = far[better], index[better]
        left[walking[to_left]] -= 1
        right[walking[~to_left]] += 1
    return at, best


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every part (vectors x parts) and every vector's error."""
    code, error = np.empty(x.shape[:2], np.int64), np.zeros(len(x), np.int64)
    for p in range(x.shape[1]):
        code[:, p], far = nearest(np.ascontiguousarray(x[:, p]), books[p])
        error += far
    return code, error


def _batches(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _sums(books: np.ndarray, dim: int, scale: int):
    """Per task, part and entry: how many parts it got, and their sum."""
    parts, entries, d = books.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for batch in _batches(batches):
            x = integers(batch, dim, parts, scale)
            code, _ = assign(x, books)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * d + 1, d), pa.int32()), pa.array(total[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], names=["part", "entry", "n", "sums"])
    return run


def _encode(books: np.ndarray, dim: int, scale: int):
    parts = books.shape[0]

    def run(batches):
        for batch in _batches(batches):
            code, error = assign(integers(batch, dim, parts, scale), books)
            text = [bytes(row).hex() for row in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])
    return run


def train(kept: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts x entries x components), from all rows of ``kept_vectors``."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    x = np.floor(np.array([r["v"] for r in first], np.float64).reshape(len(first), dim) * scale).astype(np.int64)
    books = np.ascontiguousarray(x.reshape(len(first), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        task_sums = kept.select("v").mapInArrow(_sums(books, dim, scale), "part int, entry int, n long, sums array<long>")
        each = task_sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        found = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        for r in found:  # one row for each number in the codebooks
            books[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of every vector that takes part, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is one byte of the code")
    kept, dim = kept_vectors(vectors, parts, scale)
    label = kept.schema["label"].dataType.simpleString()
    books = train(kept, dim, parts, entries, rounds, scale) if dim else np.zeros((parts, 0, 1), np.int64)
    coded = kept.mapInArrow(_encode(books, dim, scale), f"vec_id long, label {label}, code string, error long")
    return coded, books


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``approx``, the vector that a code stands for (the middle of its integers' cells)."""
    dim = books.shape[0] * books.shape[2]
    columns = [c for c in codes.columns if c != "approx"]
    schema = StructType([*codes.select(*columns).schema.fields, StructField("approx", ArrayType(DoubleType()))])

    def run(batches):
        for batch in batches:
            index = np.array([list(bytes.fromhex(c)) for c in batch.column("code").to_pylist()], np.int64).reshape(batch.num_rows, books.shape[0])
            x = ((books[np.arange(books.shape[0])[None], index] + 0.5) / scale).reshape(batch.num_rows, dim)
            approx = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, approx], names=[*batch.schema.names, "approx"])
    return codes.select(*columns).mapInArrow(run, schema)


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the error summed over equal labels (nulls together)."""
    total = codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    total = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(total, salted["label"].eqNullSafe(total["of"]) & (salted["salt"] == total["salt"])).select(*codes.columns, "label_error")


def code_table(vectors: DataFrame, **settings) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that takes part."""
    coded, books = encode(vectors, **settings)
    found = with_label_error(materialise(coded, "vector-codes"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
