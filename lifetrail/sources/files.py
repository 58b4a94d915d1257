"""Sources and sinks: CSV ingest with the original headers, table writes,
JDBC, positional keys, post-load audits and entity-consistent subsets.

Readers declare explicit schemas (no inference pass over the data) and
splittable files are read in parallel by the executors; nothing passes
through the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from lifetrail.config import Params
from lifetrail.functions import md5_key, parse_amount
from lifetrail.operators.prepare import fraud_flag, not_fraud
from lifetrail.operators.rank import rank_keys

# Header of the raw card-transaction file and the canonical column names.
TRANSACTION_HEADER = (
    ("User", "user_id", LongType()), ("Card", "card", IntegerType()),
    ("Year", "tx_year", IntegerType()), ("Month", "tx_month", IntegerType()),
    ("Day", "tx_day", IntegerType()), ("Time", "tx_time", StringType()),
    ("Amount", "amount_raw", StringType()), ("Use Chip", "use_chip", StringType()),
    ("Merchant Name", "merchant_name", StringType()), ("Merchant City", "merchant_city", StringType()),
    ("Merchant State", "merchant_state", StringType()), ("Zip", "zip", StringType()),
    ("MCC", "mcc", StringType()), ("Errors?", "errors", StringType()),
    ("Is Fraud?", "is_fraud", StringType()),
)

# Headers of the raw users and cards files.
USER_HEADER = (
    ("Person", "person", StringType()), ("Current Age", "age", IntegerType()), ("Retirement Age", "retirement_age", IntegerType()),
    ("Birth Year", "birth_year", IntegerType()), ("Birth Month", "birth_month", IntegerType()), ("Gender", "gender", StringType()),
    ("Address", "address", StringType()), ("Apartment", "apartment", StringType()), ("City", "city", StringType()), ("State", "state", StringType()),
    ("Zipcode", "zipcode", StringType()), ("Latitude", "latitude", DoubleType()), ("Longitude", "longitude", DoubleType()),
    ("Per Capita Income - Zipcode", "income_per_capita_raw", StringType()), ("Yearly Income - Person", "income_raw", StringType()),
    ("Total Debt", "debt_raw", StringType()), ("FICO Score", "score", IntegerType()), ("Num Credit Cards", "n_cards", IntegerType()),
)
CARD_HEADER = (
    ("User", "user_id", LongType()), ("CARD INDEX", "card", IntegerType()), ("Card Brand", "card_brand", StringType()),
    ("Card Type", "card_type", StringType()), ("Card Number", "card_number", StringType()), ("Expires", "expires", StringType()),
    ("CVV", "cvv", StringType()), ("Has Chip", "has_chip", StringType()), ("Cards Issued", "cards_issued", IntegerType()),
    ("Credit Limit", "credit_limit_raw", StringType()), ("Acct Open Date", "opened", StringType()),
    ("Year PIN last Changed", "pin_year", IntegerType()), ("Card on Dark Web", "on_dark_web", StringType()),
)

TRANSACTION_SCHEMA = StructType([StructField(h, t, True) for h, _, t in TRANSACTION_HEADER])
TRANSACTION_RENAMES = {h: c for h, c, _ in TRANSACTION_HEADER}


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, **options) -> DataFrame:
    """CSV with a header row (A1).  With ``schema`` no inference pass runs."""
    r = spark.read.option("header", True)
    for k, v in options.items():
        r = r.option(k, v)
    return r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw transaction file(s) with the original quoted headers, renamed to
    the canonical snake_case names."""
    return read_csv(spark, path, TRANSACTION_SCHEMA).withColumnsRenamed(TRANSACTION_RENAMES)


def read_with_header(spark: SparkSession, path: str, header) -> DataFrame:
    """A CSV file of a declared header (users, cards), renamed to canonical names."""
    schema = StructType([StructField(h, t, True) for h, _, t in header])
    return read_csv(spark, path, schema).withColumnsRenamed({h: c for h, c, _ in header})


def read_users_csv(spark: SparkSession, path: str, key: str = "user_id") -> DataFrame:
    """Users file(s); the file has no key, a user is known by row position."""
    return with_positional_key(read_with_header(spark, path, USER_HEADER), key)


def read_cards_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_with_header(spark, path, CARD_HEADER)


def sanitise_name(name: str) -> str:
    """Header-character mapping for warehouses that only accept
    ``[A-Za-z0-9_]`` (spaces and ``?`` become ``_``)."""
    return re.sub(r"[^0-9A-Za-z_]", "_", name)


def sanitise_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: sanitise_name(c) for c in df.columns if sanitise_name(c) != c})


MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists", "ignore": "ignore"}


def write_table(df: DataFrame, path: str, mode: str = "replace", fmt: str = "parquet",
                partition_by: tuple = (), **options) -> None:
    """Write with the original's modes: replace / append / fail (A3)."""
    w = df.write.mode(MODES.get(mode, mode)).format(fmt)
    for k, v in options.items():
        w = w.option(k, v)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def typed_transactions(raw: DataFrame) -> DataFrame:
    """Raw text columns -> typed ones: amount as DECIMAL(12,2) (malformed
    text -> NULL) and the fraud flag as boolean, so analyses never parse
    text again."""
    out = raw
    if "amount_raw" in raw.columns:
        out = out.withColumn("amount", parse_amount("amount_raw")).drop("amount_raw")
    return out.withColumn("is_fraud", fraud_flag(out))


def ingest_transactions(raw: DataFrame, path: str, mode: str = "replace") -> None:
    """Write the raw fact as the columnar analysis table: typed columns,
    partitioned by ``tx_year`` (the clean view's year filter prunes
    partitions) and sorted by user within each file (per-user aggregations
    read clustered runs, and the key columns compress well).  A rebalance
    by year before the write merges what many tasks hold of a small year
    and splits a large one, so files follow the data's size and not the
    number of tasks times years."""
    out = typed_transactions(raw).hint("rebalance", "tx_year").sortWithinPartitions("tx_year", "user_id")
    write_table(out, path, mode=mode, partition_by=("tx_year",))


def save_table(df: DataFrame, name: str, mode: str = "replace", partition_by: tuple = (),
               path: str | None = None) -> None:
    """Catalog table write (``saveAsTable``) with the same mode names (A13);
    with ``path`` the table is external at that location."""
    w = df.write.mode(MODES.get(mode, mode))
    if path:
        w = w.option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.saveAsTable(name)


def bulk_load_csv(spark: SparkSession, uri: str, path: str, sanitise: bool = False, mode: str = "replace") -> None:
    """Warehouse-style bulk load of raw transaction CSV from any Hadoop URI
    (A12): explicit schema instead of autodetection, header row skipped,
    truncate-and-load (``replace``); ``sanitise`` maps header characters
    for targets that only accept ``[A-Za-z0-9_]``."""
    df = read_csv(spark, uri, TRANSACTION_SCHEMA)
    if sanitise:
        write_table(sanitise_columns(df), path, mode=mode)
    else:
        ingest_transactions(df.withColumnsRenamed(TRANSACTION_RENAMES), path, mode=mode)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame is read from (0: it is not read from files)."""
    spark = df.sparkSession
    total = 0
    for name in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV export with header (A10).  ``single_file`` coalesces to one task
    and is meant for the small result marts only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "replace", batchsize: int = 50_000,
               properties: dict | None = None) -> None:
    """Batched JDBC sink (A11): each task inserts its partition in batches."""
    props = dict(properties or {})
    props.setdefault("batchsize", str(batchsize))
    df.write.jdbc(url, table, mode=MODES.get(mode, mode), properties=props)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int | None = None) -> DataFrame:
    """JDBC source.  With a numeric ``partition_column``, its ``bounds`` and
    a number of ``partitions`` the table is read by that many tasks;
    without them Spark reads it in one."""
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=dict(properties or {}))
    return spark.read.jdbc(url, table, properties=dict(properties or {}))


def with_positional_key(df: DataFrame, key: str = "user_id", start: int = 0) -> DataFrame:
    """Key = physical row position (A14): gap-free, in input order, that is
    by file path, place of the split in the file, and row in the split.

    Spark deals file splits to tasks by size, so the order of tasks is not
    the order of rows.  A count per split (one row per split) gives each
    split's start.  A frame that does not come from files keeps the order of
    its partitions."""
    m = df.withColumn("_mid", F.monotonically_increasing_id()) \
          .withColumn("_file", F.input_file_name()).withColumn("_at", F.input_file_block_start())
    m = m.withColumn("_pid", F.when(F.col("_file") == "", F.shiftright("_mid", 33)).otherwise(F.lit(0)))
    splits = m.groupBy("_file", "_at", "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_file", "_at", "_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_at", "_pid", "_first", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    return (m.join(offsets, ["_file", "_at", "_pid"])
             .select((F.col("_off") + F.col("_mid") - F.col("_first") + start).cast("long").alias(key), *df.columns))


def positional_key(df: DataFrame, order_cols, key: str = "user_id", start: int = 0) -> DataFrame:
    """Key = position in the order of (unique) columns: a distributed rank."""
    ranks = rank_keys(df, order_cols[:-1], order_cols[-1:], rank_col="_r", n_col="_n").drop("_n")
    return df.join(ranks, list(order_cols)).withColumn(key, F.col("_r") - 1 + start).drop("_r")


def audit_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for each named frame (A4)."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """First rows and the column list of a table (A6)."""
    return df.limit(n)


def sample_users(users: DataFrame, n_users: int, seed: int) -> DataFrame:
    """``n_users`` keys drawn without replacement in md5(key:seed) order:
    deterministic and independent of partitioning."""
    return (users.select("user_id").distinct()
                 .withColumn("_k", md5_key("user_id", F.lit(seed)))
                 .orderBy("_k", "user_id").limit(n_users).select("user_id"))


def entity_subset(raw: DataFrame, users: DataFrame, n_users: int, seed: int, p: Params = Params(),
                  keep_fraud: bool = False) -> DataFrame:
    """Transactions of a user sample, with the clean filters (A15), by a
    semi-join; the planner broadcasts the sample if it is small."""
    t = raw.join(sample_users(users, n_users, seed), "user_id", "left_semi")
    if not keep_fraud:
        t = t.filter(not_fraud(t))
    return t.filter(F.col("tx_year") < p.last_year_excl)


def consistent_subset(tables: dict[str, DataFrame], n_users: int, seed: int, p: Params = Params(), keep_fraud: bool = False) -> dict[str, DataFrame]:
    """Every table (``transactions``, ``users`` and any other with a
    ``user_id``) cut to the same user sample (A15)."""
    picked = sample_users(tables["users"], n_users, seed)
    out = {name: df.join(picked, "user_id", "left_semi") for name, df in tables.items() if name != "transactions"}
    return {"transactions": entity_subset(tables["transactions"], tables["users"], n_users, seed, p, keep_fraud), **out}
