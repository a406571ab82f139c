"""Column expressions shared by every operator; all of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities from least to most urgent.
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def normalise_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def notional(price: str | Column = "price", quantity: str | Column = "quantity") -> Column:
    return F.col(price) * F.col(quantity) if isinstance(price, str) else price * quantity


def event_micros(timestamp: str | Column = "timestamp") -> Column:
    return F.unix_micros(F.col(timestamp) if isinstance(timestamp, str) else timestamp)


def wall_micros(timestamp: str) -> Column:
    """Microseconds of a timestamp without zone, read as UTC whatever the session's zone."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", epoch, F.col(timestamp).cast("timestamp_ntz"))


def event_day(us: str = "event_us") -> Column:
    """The UTC day of an event as ``yyyy-MM-dd``, independent of the session's zone."""
    days = F.floor(F.col(us) / F.lit(86_400_000_000)).cast("int")
    return F.date_from_unix_date(days).cast("string")


def event_seconds(timestamp: str | Column = "timestamp") -> Column:
    """Whole epoch seconds; the fraction is dropped."""
    return F.unix_seconds(F.col(timestamp) if isinstance(timestamp, str) else timestamp)


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def with_defaults(trades: DataFrame) -> DataFrame:
    """Missing side counts as a buy, missing currency as USD."""
    return trades.withColumns(
        {
            "side": F.coalesce(F.lower("side"), F.lit("buy")),
            "currency": F.coalesce("currency", F.lit("USD")),
        }
    )
