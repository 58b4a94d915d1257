"""Adapter: the provided star-schema tables -> transaction-shaped input.

The analyses expect a card-transaction fact (one row per purchase or
refund) and a users dimension.  The test tables are order lines, so this
module derives that shape with a fixed rule (one row per line item):

==================  =======================================================
target              derivation
==================  =======================================================
user_id             o_custkey
tx_year/month/day   calendar parts of o_orderdate
amount_raw          ``'$' [ '-' ] <l_extendedprice as DECIMAL(12,2)>``;
                    negative when l_returnflag = 'R' and l_linenumber <= 2
use_chip            'Chip Transaction' if l_linestatus = 'F' else 'Swipe Transaction'
mcc                 p_brand (category code)
merchant_*          supplier / order-status derived; online orders
                    (o_orderstatus = 'P') have no state and no zip
errors              'Insufficient Balance' if o_orderpriority = '1-URGENT'
                    and l_linenumber = 7, else NULL
is_fraud            'Yes' if l_quantity = 50 and l_discount >= 0.09, else 'No'
==================  =======================================================

Only the columns a query needs survive Catalyst's column pruning, so
reading through the adapter scans just those parquet columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifetrail.functions import MONEY

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw card-style transactions (text amount, text fraud flag)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    od = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    pt = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = (li.join(od, li.l_orderkey == od.o_orderkey, "inner")
           .join(pt, li.l_partkey == pt.p_partkey, "inner"))
    online = F.col("o_orderstatus") == "P"
    refund = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 2)
    return j.select(
        F.col("o_custkey").alias("user_id"),
        (F.col("l_linenumber") - 1).cast("int").alias("card"),
        F.year("o_orderdate").alias("tx_year"),
        F.month("o_orderdate").alias("tx_month"),
        F.dayofmonth("o_orderdate").alias("tx_day"),
        F.concat(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":00")).alias("tx_time"),
        F.concat(F.lit("$"), F.when(refund, F.lit("-")).otherwise(F.lit("")),
                 F.col("l_extendedprice").cast(MONEY).cast("string")).alias("amount_raw"),
        F.when(F.col("l_linestatus") == "F", F.lit("Chip Transaction"))
         .otherwise(F.lit("Swipe Transaction")).alias("use_chip"),
        F.concat(F.lit("Supplier#"), F.col("l_suppkey").cast("string")).alias("merchant_name"),
        F.when(online, F.lit("ONLINE"))
         .otherwise(F.concat(F.lit("City-"), F.col("l_suppkey").cast("string"))).alias("merchant_city"),
        F.when(online, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("ST-"), F.substring("o_orderpriority", 1, 1))).alias("merchant_state"),
        F.when(online, F.lit(None).cast("string"))
         .otherwise(F.lpad((F.col("l_partkey") % 100000).cast("string"), 5, "0")).alias("zip"),
        F.col("p_brand").alias("mcc"),
        F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("l_linenumber") == 7),
               F.lit("Insufficient Balance")).alias("errors"),
        F.when((F.col("l_quantity") == 50) & (F.col("l_discount") >= 0.09), F.lit("Yes"))
         .otherwise(F.lit("No")).alias("is_fraud"),
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users dimension: key, name, income text (``$``), a score and an age column."""
    c = read_table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("person"),
        F.concat(F.lit("$"), F.col("c_acctbal").cast(MONEY).cast("string")).alias("income_raw"),
        F.col("c_nationkey").cast("int").alias("score"),
        (18 + F.col("c_custkey") % 70).cast("int").alias("age"),
        F.col("c_mktsegment").alias("user_segment"),
    )


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards dimension: one row per (user, card) that the users' orders can name."""
    users = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    cards = F.explode(F.sequence(F.lit(0), (F.col("user_id") % 7).cast("int"))).alias("card")
    return users.select("user_id", cards, F.col("c_mktsegment").alias("card_type"))


def category_map(spark: SparkSession) -> DataFrame:
    """Code -> (detail label, large group) for the adapter's brand codes.

    Built from a rule: brands 1..20 get a label and one of four groups,
    brands above 20 are left unmapped so the default label applies.
    """
    rows = [(f"Brand#{k}", f"brand-{k}", f"group-{(k - 1) // 5 + 1}") for k in range(1, 21)]
    return spark.createDataFrame(rows, "code string, detail string, large_group string")
