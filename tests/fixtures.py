"""Hand-made micro fixtures (raw transaction shape)."""

from __future__ import annotations

from pyspark.sql import DataFrame

RAW_COLUMNS = ("user_id long, card int, tx_year int, tx_month int, tx_day int, tx_time string, "
               "amount_raw string, use_chip string, merchant_name string, merchant_city string, "
               "merchant_state string, zip string, mcc string, errors string, is_fraud string")


def tx(user, y, m, d, amount="$10.00", mcc="Brand#1", errors=None, fraud="No", city="City-1"):
    return (user, 0, y, m, d, "00:00", amount, "Chip Transaction", "M", city, "ST-1", "00001",
            mcc, errors, fraud)


def raw_frame(spark, rows, partitions: int | None = None) -> DataFrame:
    df = spark.createDataFrame(rows, RAW_COLUMNS)
    return df.repartition(partitions) if partitions else df
