"""Table preparation: the clean view (A7) and the monetary view (A8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from lifetrail.config import Params
from lifetrail.functions import date_int, parse_amount, year_month

CLEAN_COLUMNS = ("user_id", "card", "tx_year", "tx_month", "tx_day", "tx_time", "amount",
                 "use_chip", "merchant_name", "merchant_city", "merchant_state", "zip",
                 "mcc", "errors", "is_fraud", "date_int", "year_month")


def fraud_flag(df: DataFrame):
    """The fraud flag as a boolean: of text only 'Yes' and 'No' count, any
    other text is unknown (null)."""
    dt = df.schema["is_fraud"].dataType
    if isinstance(dt, BooleanType):
        return F.col("is_fraud")
    if isinstance(dt, StringType):
        return F.when(F.col("is_fraud") == "Yes", True).when(F.col("is_fraud") == "No", False)
    return F.col("is_fraud").cast("boolean")


def not_fraud(df: DataFrame):
    """Rows known to be no fraud; unknown flags do not pass."""
    return F.coalesce(~fraud_flag(df), F.lit(False))


def clean(raw: DataFrame, p: Params = Params()) -> DataFrame:
    """Drop fraud rows and the incomplete last year, parse the amount,
    derive integer date keys.  One narrow stage (filter + project); the
    year predicate prunes partitions when the source is partitioned by
    ``tx_year``."""
    amount_src = "amount_raw" if "amount_raw" in raw.columns else "amount"
    return (raw.filter(not_fraud(raw) & (F.col("tx_year") < p.last_year_excl))
               .select("user_id", "card", "tx_year", "tx_month", "tx_day", "tx_time",
                       parse_amount(amount_src).alias("amount"),
                       "use_chip", "merchant_name", "merchant_city", "merchant_state", "zip",
                       "mcc", "errors", F.lit(False).alias("is_fraud"),
                       date_int("tx_year", "tx_month", "tx_day").cast("int").alias("date_int"),
                       year_month("tx_year", "tx_month").cast("int").alias("year_month")))


def is_monetary(p: Params = Params()):
    """Predicate of the monetary view: purchases without error, at most the cap."""
    return (F.col("amount") > 0) & F.col("errors").isNull() & (F.col("amount") <= p.outlier_cap)


def monetary(clean_df: DataFrame, p: Params = Params()) -> DataFrame:
    """Purchases only: no refunds, no errors, no outliers above the cap."""
    return clean_df.filter(is_monetary(p))


def register_views(spark, raw: DataFrame, p: Params = Params(), prefix: str = "") -> None:
    """Create-or-replace the stacked temp views (A9)."""
    c = clean(raw, p)
    c.createOrReplaceTempView(f"{prefix}clean_transactions")
    monetary(c, p).createOrReplaceTempView(f"{prefix}ltv_transactions")


def drop_views(spark, prefix: str = "") -> None:
    for v in ("clean_transactions", "ltv_transactions"):
        spark.catalog.dropTempView(f"{prefix}{v}")
