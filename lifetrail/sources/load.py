"""Bulk load of delimited files with detected types and a reject table (A1, A12).

Types are detected on a bounded sample (``SAMPLE_ROWS`` rows, a documented
parameter) and then checked on every row of the full read: a row that does
not fit is not lost in nulls, it goes to the reject table with its reasons.

Reasons: ``columns`` (more or fewer fields than the header, or a quote that
never ends), ``<name>: <text>`` (a value that is not of its column's type),
``<name> is missing`` (a required value), and the names of checks that fail.
Empty fields are nulls.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lifetrail.functions import parse_amount
from lifetrail.operators.select import held
from lifetrail.sources.files import TRANSACTION_HEADER, sanitise_name, write_table

#: Rows of the first files that types are detected on.
SAMPLE_ROWS = 1000
#: Detected types, the first that all sampled values fit: a pattern and the typed column.
TYPES: dict[str, tuple[str, object]] = {
    "long": (r"[+-]?\d{1,18}", lambda c: F.trim(c).try_cast("long")),
    "money": (r"-?\$-?\d{1,10}(\.\d{1,2})?", lambda c: parse_amount(F.trim(c))),
    "double": (r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", lambda c: F.trim(c).try_cast("double")),
    "date": (r"\d{4}-\d{2}-\d{2}", lambda c: F.trim(c).try_cast("date")),
    "flag": (r"(?i)yes|no|true|false", lambda c: F.when(F.lower(F.trim(c)).isin("yes", "true"), True).when(F.lower(F.trim(c)).isin("no", "false"), False)),
    "string": (r"(?s).*", lambda c: c),
}
BROKEN = "_broken_line"


@dataclass
class Loaded:
    rows: DataFrame      # typed rows that fit
    rejects: DataFrame   # file, reasons, line (as JSON of the fields, or the broken line)
    counts: dict         # read, kept, rejected


def header_of(spark: SparkSession, path: str, **options) -> list[str]:
    r = spark.read.option("header", True)
    for k, v in options.items():
        r = r.option(k, v)
    return r.csv(path).columns


def detect_types(spark: SparkSession, path: str, sample_rows: int = SAMPLE_ROWS, **options) -> dict[str, str]:
    """Header -> type name, from at most ``sample_rows`` rows; columns without values are strings."""
    names = header_of(spark, path, **options)
    r = spark.read.option("header", True)
    for k, v in options.items():
        r = r.option(k, v)
    sample = r.schema(StructType([StructField(n, StringType()) for n in names])).csv(path).limit(sample_rows).collect()
    out = {}
    for i, name in enumerate(names):
        values = [row[i].strip() for row in sample if row[i] is not None and row[i].strip()]
        out[name] = next(t for t, (pattern, _) in TYPES.items() if all(re.fullmatch(pattern, v) for v in values)) if values else "string"
    return out


def load_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, names: dict[str, str] | None = None, required: tuple = (),
             checks: dict[str, str] | None = None, **options) -> Loaded:
    """Read all of ``path``.  ``types`` (header -> type) default to the
    detected ones; ``names`` maps headers to column names (default: the
    header with other characters than ``[A-Za-z0-9_]`` as ``_``).
    ``required`` columns must have a value and ``checks`` (name -> SQL condition
    over the typed columns) must hold.  The text is parsed, typed and checked
    once, into a staging table that counts, rows and rejects are read from."""
    types = types or detect_types(spark, path, **options)
    header = header_of(spark, path, **options)
    types = {h: types.get(h, "string") for h in header}
    names = names or {}
    names = {h: names.get(h, sanitise_name(h)) for h in header}
    fields = [f"f{i}" for i in range(len(header))]
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("enforceSchema", True).option("columnPruning", False)
    for k, v in options.items():
        r = r.option(k, v)
    schema = StructType([StructField(f, StringType()) for f in fields] + [StructField(BROKEN, StringType())])
    text = r.schema(schema).csv(path).select("*", F.input_file_name().alias("_file"))

    empty = {f: F.col(f).isNull() | (F.trim(F.col(f)) == "") for f in fields}
    value = {h: F.when(~empty[f], TYPES[types[h]][1](F.col(f))) for f, h in zip(fields, header)}
    typed = text.select("*", *(value[h].alias(f"_v_{names[h]}") for h in header))
    wrong = [(~empty[f] & F.col(f"_v_{names[h]}").isNull(), F.concat(F.lit(f"{names[h]}: "), F.col(f))) for f, h in zip(fields, header) if types[h] != "string"]
    missing = [(empty[f], F.lit(f"{names[h]} is missing")) for f, h in zip(fields, header) if names[h] in required]
    bound = {name: _over(cond, names.values()) for name, cond in (checks or {}).items()}
    failed = [(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in bound.items()]
    broken = F.col(BROKEN).isNotNull()
    found = [*wrong, *missing, *failed]
    rejected = reduce(or_, (cond for cond, _ in found), broken)
    reasons = F.when(broken, F.array(F.lit("columns"))).otherwise(F.filter(F.array(*(F.when(cond, reason) for cond, reason in found), F.lit(None).cast("string")), lambda x: x.isNotNull()))
    line = F.when(broken, F.col(BROKEN)).otherwise(F.to_json(F.struct(*(F.col(f).alias(h) for f, h in zip(fields, header)))))
    # the text stays for the rejected rows only; their reasons and lines are made when they are read
    checked = typed.withColumn("_rejected", rejected)
    kept_text = [F.when(F.col("_rejected"), F.col(c)).alias(c) for c in (*fields, BROKEN, "_file")]
    staged = held(checked.select(*(f"_v_{names[h]}" for h in header), "_rejected", *kept_text), "load-rows")

    counts = staged.agg(F.count(F.lit(1)).alias("read"), F.count_if(~F.col("_rejected")).alias("kept"), F.count_if("_rejected").alias("rejected")).first().asDict()
    return Loaded(staged.where(~F.col("_rejected")).select(*(F.col(f"_v_{names[h]}").alias(names[h]) for h in header)),
                  staged.where("_rejected").select(F.col("_file").alias("file"), reasons.alias("reasons"), line.alias("line")), counts)


def _over(condition, names) -> Column:
    """A condition given as SQL text over the columns' names, on the typed columns."""
    text = condition
    for n in sorted(names, key=len, reverse=True):
        text = re.sub(rf"(?<![\w`]){re.escape(n)}(?!\w)", f"`_v_{n}`", text)
    return F.expr(text)


def load_table(spark: SparkSession, path: str, out: str, rejects: str, mode: str = "replace", most_rejected: float = 0.01, partition_by: tuple = (), **settings) -> dict:
    """Load ``path`` into the table ``out`` and its rejects into ``rejects``; returns the audit.

    Nothing is written when more than ``most_rejected`` of the rows do not fit."""
    loaded = load_csv(spark, path, **settings)
    if loaded.counts["rejected"] > most_rejected * max(1, loaded.counts["read"]):
        raise ValueError(f"too many rows do not fit: {loaded.counts}")
    write_table(loaded.rejects, rejects, mode=mode)
    write_table(loaded.rows, out, mode=mode, partition_by=partition_by)
    return loaded.counts


#: Types of the raw transaction file's columns.
TRANSACTION_TYPES = {h: {"bigint": "long", "int": "long"}.get(t.simpleString(), "string") for h, _, t in TRANSACTION_HEADER} | {"Amount": "money", "Is Fraud?": "flag"}


def load_transactions(spark: SparkSession, path: str, **settings) -> Loaded:
    """The raw transaction file with canonical names: amounts, flags, numbers
    and dates are checked, and the rows that analyses could not place are rejects."""
    loaded = load_csv(spark, path, types=TRANSACTION_TYPES, names={h: "amount" if c == "amount_raw" else c for h, c, _ in TRANSACTION_HEADER},
                      required=("user_id", "tx_year", "tx_month", "tx_day", "amount"), checks={"no such day": "TRY_CAST(concat_ws('-', tx_year, tx_month, tx_day) AS DATE) IS NOT NULL"}, **settings)
    ints = [c for _, c, t in TRANSACTION_HEADER if t.simpleString() == "int"]
    loaded.rows = loaded.rows.withColumns({c: F.col(c).cast("int") for c in ints})
    return loaded
