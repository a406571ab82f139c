"""Decoding and validating wire messages; a bad record is set aside, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TRADE

# numbers may come as JSON numbers or as numeric strings; they and the time are read as text, so that
# a value that does not parse can be told from a missing one
NUMBERS = ("price", "quantity")
WIRE = T.StructType([T.StructField(f.name, T.StringType()) for f in TRADE.fields])


def typed_trades(wire: DataFrame) -> DataFrame:
    """Text columns as trade types, and ``time_ok``: the time is missing or could be read."""
    time = F.try_to_timestamp("timestamp")
    numbers = {name: F.col(name).try_cast("double") for name in NUMBERS}
    return wire.withColumns(numbers | {"time_ok": F.col("timestamp").isNull() | time.isNotNull(), "timestamp": time})


def valid_trade() -> Column:
    """Required fields, positive numbers, a known side. Null-safe: missing values are invalid.

    The symbol's length is checked as sent, before trimming.
    """
    length = F.length("symbol")
    checks = (
        length.between(1, 32)
        & (F.col("price") > 0)
        & (F.col("quantity") > 0)
        & ~F.isnan("price")
        & ~F.isnan("quantity")
        & F.coalesce(F.col("side").isin("buy", "sell"), F.lit(True))
    )
    return F.coalesce(checks, F.lit(False))


def decode_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages (text or bytes) to typed trade columns, plus the raw text and ``valid``."""
    raw = F.col(value).cast("string")
    parsed = messages.withColumn("raw", raw).withColumn("_trade", F.from_json("raw", WIRE)).select("raw", "_trade.*")
    return typed_trades(parsed).withColumn("valid", valid_trade() & F.col("time_ok")).drop("time_ok")


def decode_trades(messages: DataFrame, value: str = "value") -> DataFrame:
    """Only the valid trades of a message frame or stream."""
    return decode_messages(messages, value).filter("valid").select(*TRADE.fieldNames())


def rejected_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    return decode_messages(messages, value).filter("not valid").select("raw")
