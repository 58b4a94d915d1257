"""Order statistics and equal-count bins by distributed selection.

A median, a quartile or an NTILE edge needs the rows at a few ranks, not a
rank for every row.  ``keys_at`` finds the keys at given ranks of a total
order (several columns, compared one after the other):

1. An approximate percentile on both sides of a rank brackets its value; one
   aggregate counts what lies below and inside.  Brackets of more than
   ``most`` rows are bracketed again, each time to some thousandths.
2. The rows inside the brackets are counted by value, the running counts
   give the value at the rank and how many rows share it.
3. Among these the next column is selected in the same way, so a value that
   a third of all rows share costs no more than any other.

All asked ranks move together: a step is one job over the frame, whatever
their number.  Only brackets and counts reach the driver.  Counts are exact,
so the result does not depend on the sketch; one that misses its rank only
makes the next step count more rows.

The frame is read several times and should be a written, narrow table
(``held`` writes one).  Rows whose first column is null take no part; the
other columns break ties and must not be null.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lifetrail.config import ensure_checkpoint_dir

#: Rows in a bracket that are counted by value, and the sketch's accuracy (rank error 1 / ACCURACY).
MOST, ACCURACY = 1 << 16, 2000


def held(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: several passes
    over it evaluate its plan once.  The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


@dataclass
class _Asked:
    columns: tuple
    rank: int                       # among the rows that are left
    size: int                       # rows that are left
    prefix: list = field(default_factory=list)
    bracket: tuple | None = None
    narrow: bool = False            # further brackets would not help

    @property
    def done(self) -> bool:
        return len(self.prefix) == len(self.columns)

    @property
    def column(self) -> str:
        return self.columns[len(self.prefix)]

    def left(self):
        cond = F.col(self.column).isNotNull()
        for c, v in zip(self.columns, self.prefix):
            cond = cond & (F.col(c) == F.lit(v))
        if self.bracket:
            cond = cond & F.col(self.column).between(*map(F.lit, self.bracket))
        return cond


def _bracket(df: DataFrame, wide: list[_Asked], accuracy: int) -> None:
    eps = 3 / accuracy
    sketches = [F.percentile_approx(F.when(a.left(), F.col(a.column)), F.array(*(F.lit(min(1.0, max(0.0, a.rank / a.size + e))) for e in (-eps, eps))), F.lit(accuracy)) for a in wide]
    found = df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sketches))).first()
    counts = []
    for i, a in enumerate(wide):
        lo, hi = found[i]
        counts += [F.count_if(a.left() & (F.col(a.column) < F.lit(lo))).alias(f"b{i}"), F.count_if(a.left() & F.col(a.column).between(F.lit(lo), F.lit(hi))).alias(f"n{i}")]
    seen = df.agg(*counts).first()
    for i, a in enumerate(wide):
        below, inside = seen[f"b{i}"], seen[f"n{i}"]
        hit = below < a.rank <= below + inside
        a.narrow = not hit or inside == a.size or found[i][0] == found[i][1]
        if hit:
            a.bracket, a.rank, a.size = tuple(found[i]), a.rank - below, inside


def _count_values(df: DataFrame, ready: list[_Asked]) -> None:
    rows = F.explode(F.array(*(F.when(a.left(), F.struct(F.lit(i).alias("i"), F.lit(a.rank).cast("long").alias("rank"), F.col(a.column).alias("v"))) for i, a in enumerate(ready))))
    counted = df.select(rows.alias("r")).where("r is not null").groupBy("r").agg(F.count(F.lit(1)).alias("n")).select("r.*", "n")
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).collect()
    for r in found:  # one row for each rank
        a = ready[r["i"]]
        a.prefix.append(r["v"])
        a.rank, a.size, a.bracket, a.narrow = a.rank - (r["upto"] - r["n"]), r["n"], None, False


def keys_at(df: DataFrame, asked: list[tuple[tuple, int, int]], most: int = MOST, accuracy: int = ACCURACY) -> list[tuple | None]:
    """The key at each asked (columns, 1-based rank, number of rows); None
    for ranks outside 1..n.  Rows whose first column is null do not count."""
    types = {f.name: f.dataType for f in df.schema.fields}
    states = [_Asked(tuple(c), r, n) for c, r, n in asked]
    todo = [a for a in states if 1 <= a.rank <= a.size]
    while todo:
        wide = [a for a in todo if a.size > most and not a.narrow and isinstance(types[a.column], NumericType)]
        if wide:
            _bracket(df, wide, accuracy)
            continue
        kind = types[todo[0].column]
        _count_values(df, [a for a in todo if types[a.column] == kind])
        todo = [a for a in todo if not a.done]
    return [tuple(a.prefix) if a.done else None for a in states]


# ---------------------------------------------------------------- bins
def ntile_ends(n: int, k: int) -> list[int]:
    """Last rank of the first k - 1 of SQL's ``NTILE(k)`` buckets of n rows."""
    return [b * (n // k) + min(b, n % k) for b in range(1, k)]


def qcut_ends(n: int, k: int) -> list[int]:
    """Last rank of the first k - 1 bins of ``qcut(rank, k)``: edges at 1 + b (n - 1) / k."""
    return [b * (n - 1) // k + 1 for b in range(1, k)]


def bin_of(columns, cuts: list[tuple | None]):
    """1 + the number of cut keys below a row's key; a cut at or beyond the last row is None."""
    key = F.struct(*(F.col(c) for c in columns))
    out = F.lit(1)
    for cut in cuts:
        if cut is not None:
            out = out + F.when(key > F.struct(*(F.lit(v).alias(c) for v, c in zip(cut, columns))), 1).otherwise(0)
    return out.cast("int")


def bin_cuts(df: DataFrame, columns: list[tuple], k: int, method: str, n: int | None = None) -> list[list[tuple | None]]:
    """Cut keys of ``k`` equal-count bins under each of several orders."""
    ends = {"ntile": ntile_ends, "qcut": qcut_ends}[method]
    n = df.count() if n is None else n
    ranks = ends(n, k) if n else []
    found = keys_at(df, [(c, r, n) for c in columns for r in ranks])
    return [found[i * len(ranks):(i + 1) * len(ranks)] for i in range(len(columns))]


# ---------------------------------------------------------------- quantiles
def quantiles(df: DataFrame, metrics, probs, sizes: dict[str, int]) -> dict[str, list[float | None]]:
    """Interpolated quantiles (``percentile_cont``) of each metric's ``sizes[metric]`` rows that are not null."""
    places = {m: [max(0, sizes[m] - 1) * p for p in probs] for m in metrics}
    ranks = {m: sorted({r for x in places[m] for r in (int(x) + 1, min(sizes[m], int(x) + 2))}) if sizes[m] else [] for m in metrics}
    found = iter(keys_at(df, [((m,), r, sizes[m]) for m in metrics for r in ranks[m]]))
    at = {m: {r: float(next(found)[0]) for r in ranks[m]} for m in metrics}

    def value(m, x):
        if not sizes[m]:
            return None
        lo, hi = at[m][int(x) + 1], at[m][min(sizes[m], int(x) + 2)]
        return lo + (x - int(x)) * (hi - lo)
    return {m: [value(m, x) for x in places[m]] for m in metrics}
