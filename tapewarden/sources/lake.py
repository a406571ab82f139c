"""Lake tables: raw, curated and anomaly tables, partitioned by day."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Table layouts.
TABLES = {
    "trades_raw": (
        "json",
        "trade_id STRING, `timestamp` TIMESTAMP, symbol STRING, price DOUBLE, quantity DOUBLE, side STRING,"
        " account_id STRING, counterparty_id STRING, venue STRING, currency STRING",
    ),
    "trades": (
        "parquet",
        "trade_id STRING, `timestamp` TIMESTAMP, symbol STRING, price DOUBLE, quantity DOUBLE, side STRING,"
        " venue STRING, notional DOUBLE",
    ),
    "anomalies": (
        "parquet",
        "`timestamp` TIMESTAMP, symbol STRING, detector STRING, severity STRING, price DOUBLE, quantity DOUBLE,"
        " score DOUBLE, reason STRING",
    ),
}


def register_table(spark: SparkSession, name: str, location: str, database: str = "default") -> None:
    """Declare one external table over a folder of ``dt=…`` partitions."""
    fmt, columns = TABLES[name]
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}, dt STRING)"
        f" USING {fmt} PARTITIONED BY (dt) LOCATION '{location}'"
    )


def refresh_partitions(spark: SparkSession, name: str, database: str = "default") -> None:
    """Pick up partitions that landed since the table was declared."""
    spark.sql(f"MSCK REPAIR TABLE {database}.{name}")
