from lifetrail.streaming.ingest import ingest_csv_stream, ingest_parquet_stream  # noqa: F401
