"""Trade tapes projected from the star-schema tables.

The tables hold no trades, so the line items of all orders stand in for them:
one trade per line item, one symbol holding a third of the rows (the skew the
operators have to survive), the others sparse enough to be bounded by age
rather than by count. Prices drift on a per-part grid with off-market shocks,
some orders trade blocks, and some stretches of orders are one-sided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import wall_micros

TAPE_START_US = 1_735_689_600_000_000  # 2025-01-01T00:00:00Z
STEP_US = 62_500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What windows over prices, sizes and sides read.
PRICED = ("symbol", "trade_id", "event_us", "price", "quantity", "side")


def priced_tape(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The tape without accounts, so without the orders: Arrow steps get no column that nobody reads."""
    return lineitem_tape(spark, sf_dir, accounts=False).select(*PRICED, *more)


def lineitem_tape(spark: SparkSession, sf_dir: str, accounts: bool = True) -> DataFrame:
    """Without ``accounts`` the account is null and the orders are not read (every line item has one)."""
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linestatus"
    )
    if accounts:
        order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        joined = item.join(order, item.l_orderkey == order.o_orderkey)
    else:
        joined = item.withColumn("o_custkey", F.lit(None).cast("long"))
    return joined.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
        " cast(round(l_extendedprice * 100) as bigint)) as trade_id",
        f"cast({TAPE_START_US} + (l_orderkey * 4 + l_linenumber) * {STEP_US} as bigint) as event_us",
        "case when l_suppkey % 3 = 0 then 'SYM00'"
        " else concat('SYM', lpad(cast(l_suppkey % 20 as string), 2, '0')) end as symbol",
        # off the cent grid, so that averages do not sit on rounding ties
        "(50.0D + (l_suppkey % 20) * 5 + (l_partkey % 400) * 0.01D"
        " + case when l_orderkey % 389 = 0 then 25.0D else 0.0D end) * 1.000013718281828D as price",
        "(cast(l_quantity as int) % 10 + 1) * 100.0D"
        " * case when l_orderkey % 211 = 0 then 20 else 1 end as quantity",
        "case when (l_orderkey div 64) % 29 = 0 or l_linestatus = 'O' then 'buy' else 'sell' end as side",
        "concat('acct_', o_custkey % 8) as account_id",
        "concat('acct_', l_partkey % 64) as counterparty_id",
        "concat('V', l_linenumber % 3) as venue",
        "'USD' as currency",
        "case when l_orderkey % 389 = 0 then 'price_spike'"
        " when l_orderkey % 211 = 0 then 'volume_spike'"
        " when (l_orderkey div 64) % 29 = 0 then 'spoofing' end as label",
    )


def flat_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape with stretches of one price (a value that binary sums do not hit exactly) and a jump after each."""
    order = F.split("trade_id", "-")[0].cast("long")
    jump = F.when(order % 97 == 0, 101.0001371828)
    price = F.when(F.pmod(F.floor(order / 512), F.lit(2)) == 0, F.coalesce(jump, F.lit(100.1))).otherwise(F.col("price"))
    return lineitem_tape(spark, sf_dir).withColumn("price", price)


def event_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse tape over a month, from the event stream."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("evt-"), "event_id").alias("trade_id"),
        wall_micros("ts").alias("event_us"),
        F.upper("event_type").alias("symbol"),
        (F.col("value") + 1.0).alias("price"),
        (F.col("user_id") % 10 + 1).cast("double").alias("quantity"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.concat(F.lit("acct_"), F.col("user_id")).alias("account_id"),
    )
