"""Summaries, series, percentiles and top-k over a tape and its alerts.

Everything is a partial aggregate or a top-k; the only windows run over rows
that are already aggregated or cut to a fixed number per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import notional
from .rolling import ORDER
from .split import ROWS_PER_TASK, running_sums

MICROS = 1_000_000


def _second(us: str = "event_us") -> Column:
    return F.floor(F.col(us) / F.lit(MICROS)).cast("long")


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def daily_counts(alerts: DataFrame, by: str = "detector") -> DataFrame:
    """Counts per ``dt`` and another column, by day and then most frequent first."""
    return alerts.groupBy("dt", by).agg(F.count(F.lit(1)).alias("n")).orderBy("dt", F.desc("n"), by)


def top_critical(alerts: DataFrame, day: str, limit: int = 20) -> DataFrame:
    """Symbols with the most critical alerts on a day."""
    hits = alerts.filter((F.col("severity") == "critical") & (F.col("dt") == day))
    counted = hits.groupBy("symbol").agg(F.count(F.lit(1)).alias("critical"))
    return counted.orderBy(F.desc("critical"), "symbol").limit(limit)


def daily_severity(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("dt", "severity").agg(F.count(F.lit(1)).alias("alerts"))


def register_daily_severity(anomalies: DataFrame, name: str = "v_daily_severity") -> None:
    daily_severity(anomalies).createOrReplaceTempView(name)


def backtest_summary(flagged: DataFrame) -> DataFrame:
    """Scanned, flagged and percentage in one pass; an empty tape gives 0 percent."""
    totals = flagged.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("anomalous").alias("flagged"))
    share = F.when(F.col("scanned") > 0, 100.0 * F.col("flagged") / F.col("scanned")).otherwise(0.0)
    return totals.withColumn("flagged_pct", share)


def first_anomalies(flagged: DataFrame, limit: int = 10) -> DataFrame:
    return flagged.filter("anomalous").orderBy(*ORDER).limit(limit)


def symbol_summary(tape: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per symbol: first, last, high, low, counts, notional, sides and change; largest notional first."""
    at = F.struct(*ORDER)
    traded = tape.groupBy("symbol").agg(
        F.min_by("price", at).alias("_first"),
        F.max_by("price", at).alias("_last"),
        F.max("price").alias("_high"),
        F.min("price").alias("_low"),
        F.count(F.lit(1)).alias("trades"),
        F.sum(notional()).alias("_notional"),
        F.count_if(F.col("side") == "buy").alias("buy"),
        F.count_if(F.col("side") != "buy").alias("sell"),
    )
    raised = alerts.groupBy("symbol").agg(F.count(F.lit(1)).alias("alerts"))
    base = F.when(F.col("_first") == 0, F.col("_last")).otherwise(F.col("_first"))
    change = F.when(base != 0, (F.col("_last") - base) / base).otherwise(0.0)
    return (
        traded.join(raised, "symbol", "left")
        .select(
            "symbol",
            F.round("_last", 4).alias("last_price"),
            F.round(change * 100, 3).alias("change_pct"),
            F.round("_high", 4).alias("high"),
            F.round("_low", 4).alias("low"),
            "trades",
            F.coalesce("alerts", F.lit(0)).alias("alerts"),
            F.round("_notional", 2).alias("notional"),
            "buy",
            "sell",
        )
        .orderBy(F.desc("notional"), "symbol")
    )


def sparkline(tape: DataFrame, points: int = 120) -> DataFrame:
    """The last ``points`` prices of each symbol in time order.

    The rank filter is pushed below the shuffle (each task keeps at most
    ``points`` rows per symbol), so a hot symbol does not travel.
    """
    latest = Window.partitionBy("symbol").orderBy(F.desc("event_us"), F.desc("trade_id"))
    cut = tape.select("symbol", *ORDER, F.round("price", 6).alias("price")).withColumn(
        "_back", F.row_number().over(latest)
    )
    kept = cut.filter(F.col("_back") <= points).groupBy("symbol")
    ordered = F.sort_array(F.collect_list(F.struct(*ORDER, "price")))
    return kept.agg(F.transform(ordered, lambda p: p["price"]).alias("spark"))


def per_second(tape: DataFrame, alerts: DataFrame) -> DataFrame:
    """Trades, alerts and notional per second that saw a trade."""
    traded = tape.groupBy(_second().alias("t")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum(notional()).alias("notional")
    )
    raised = alerts.groupBy(_second().alias("t")).agg(F.count(F.lit(1)).alias("alerts"))
    return traded.join(raised, "t", "left").fillna({"alerts": 0})


def time_series(tape: DataFrame, alerts: DataFrame, window: int = 120, now: Column | None = None) -> DataFrame:
    """Per-second series over the last ``window`` seconds, empty seconds as zeros.

    ``now`` is an epoch second; by default the last second of the tape.
    """
    last = tape.agg(F.max(_second()).alias("now"))
    if now is not None:
        last = last.select(now.cast("long").alias("now"))
    seconds = last.select(F.explode(F.sequence(F.col("now") - (window - 1), F.col("now"))).alias("t"))
    # filtering by the one-row bound keeps whole history out of the aggregate
    bound = last.select((F.col("now") - window).alias("_after"), F.col("now").alias("_upto"))
    recent = lambda df: df.join(F.broadcast(bound), (_second() > F.col("_after")) & (_second() <= F.col("_upto")))
    series = per_second(recent(tape), recent(alerts))
    zeros = {"trades": 0, "alerts": 0, "notional": 0.0}
    return seconds.join(series, "t", "left").fillna(zeros).select("t", "trades", "alerts", F.round("notional", 2).alias("notional"))


def rates(tape: DataFrame, alerts: DataFrame, seconds: int = 5, now: Column | None = None) -> DataFrame:
    """Trades and alerts per second over the last fully elapsed seconds."""
    series = time_series(tape, alerts, seconds + 1, now)
    last = series.agg(F.max("t").alias("_now"))
    elapsed = series.join(F.broadcast(last), F.col("t") < F.col("_now"))
    return elapsed.agg(
        F.round(F.sum("trades") / seconds, 2).alias("trades_per_sec"),
        F.round(F.sum("alerts") / seconds, 2).alias("alerts_per_sec"),
    )


def kpis(tape: DataFrame, alerts: DataFrame) -> DataFrame:
    traded = tape.agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.round(F.coalesce(F.sum(notional()), F.lit(0.0)), 2).alias("total_notional"),
        F.count_distinct("symbol").alias("symbols_tracked"),
    )
    raised = alerts.agg(F.count(F.lit(1)).alias("total_alerts"))
    share = F.when(
        F.col("total_trades") > 0, F.round(100.0 * F.col("total_alerts") / F.col("total_trades"), 3)
    ).otherwise(0.0)
    # both sides are single rows
    return traded.join(F.broadcast(raised)).withColumn("alert_rate_pct", share)


def latest_values(rows: DataFrame, value: str, order: tuple[str, ...], limit: int = 4000) -> DataFrame:
    """The most recent ``limit`` values, the reservoir of the percentile report."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(limit).select(F.col(value).cast("double").alias("value"))


def nearest_rank_stats(values: DataFrame, rows_per_task: int | None = ROWS_PER_TASK) -> DataFrame:
    """p50, p95, p99 (zero-based nearest rank ``min(n - 1, floor(p n))``), max and mean of ``value``.

    Ranks are running counts over distinct values, so ties collapse before
    anything is sorted. ``None`` is for a frame of bounded size, like the reservoir
    of :func:`latest_values`.
    """
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = values.agg(F.count(F.lit(1)).alias("_total"), F.max("value").alias("_max"), F.avg("value").alias("_mean"))
    # total is a single row
    placed = running_sums(counts, ["value"], {"_upto": F.col("n")}, rows_per_task).join(F.broadcast(total))
    at = lambda p: F.least(F.col("_total") - 1, F.floor(F.col("_total") * F.lit(p)))
    pick = lambda p: F.round(F.min(F.when(F.col("_upto") > at(p), F.col("value"))), 1)
    return placed.agg(
        F.coalesce(F.max("_total"), F.lit(0)).alias("count"),
        F.coalesce(pick(0.50), F.lit(0.0)).alias("p50"),
        F.coalesce(pick(0.95), F.lit(0.0)).alias("p95"),
        F.coalesce(pick(0.99), F.lit(0.0)).alias("p99"),
        F.coalesce(F.round(F.max("_max"), 1), F.lit(0.0)).alias("max"),
        F.coalesce(F.round(F.max("_mean"), 1), F.lit(0.0)).alias("mean"),
    )


# Bucket edges of the report, in its own unit.
HISTOGRAM_EDGES = (0, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 1e12)


def fixed_histogram(values: DataFrame, edges: tuple[float, ...] = HISTOGRAM_EDGES) -> DataFrame:
    """Counts per half-open bucket ``[lo, hi)``; empty buckets are kept, values outside are not counted."""
    bucket = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        bucket = F.when((F.col("value") >= lo) & (F.col("value") < hi), i).otherwise(bucket)
    counts = values.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    names = values.sparkSession.createDataFrame(
        [(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))], "bucket int, lo double, hi double"
    )
    return names.join(counts, "bucket", "left").fillna({"count": 0})


def latest_tape(tape: DataFrame, alerts: DataFrame, limit: int = 80) -> DataFrame:
    """Newest trades first, each with whether it raised an alert.

    The tape is cut before the alerts are matched, so the match has ``limit`` rows on one side.
    """
    newest = tape.orderBy(F.desc("event_us"), F.desc("trade_id")).limit(limit)
    hit = alerts.join(F.broadcast(newest.select("trade_id")), "trade_id", "left_semi").select("trade_id").distinct()
    flagged = newest.join(hit.withColumn("_hit", F.lit(True)), "trade_id", "left")
    return flagged.select(
        "trade_id", "symbol", "price", "quantity", "side",
        F.round(notional(), 2).alias("notional"), F.coalesce("_hit", F.lit(False)).alias("anomalous"), "event_us",
    ).orderBy(F.desc("event_us"), F.desc("trade_id"))


def recent_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc("event_us"), F.desc("trade_id"), F.desc("position")).limit(limit)


def per_minute(tape: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per-second rates of trades and alerts over each minute."""
    minute = F.floor(F.col("event_us") / F.lit(60 * MICROS)).cast("long") * 60
    traded = tape.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("trades"))
    raised = alerts.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("alerts"))
    joined = traded.join(raised, "minute", "left").fillna({"alerts": 0})
    return joined.withColumns(
        {"trade_rate": F.round(F.col("trades") / 60.0, 4), "alert_rate": F.round(F.col("alerts") / 60.0, 4)}
    )


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Counts by action, outcome, client and code, with the subtotals along that path."""
    return audit.rollup("action", "outcome", "client", "code").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n")
    )


def snapshot(tape: DataFrame, alerts: DataFrame, window: int = 120) -> dict[str, DataFrame]:
    """The dashboard as one DataFrame per block."""
    gaps = Window.partitionBy("symbol").orderBy(*ORDER)
    gap = (F.col("event_us") - F.lag("event_us").over(gaps)).alias("value")
    newest = tape.orderBy(F.desc("event_us"), F.desc("trade_id")).limit(4000)
    values = newest.select(gap).dropna()
    return {
        "kpis": kpis(tape, alerts),
        "timeseries": time_series(tape, alerts, window),
        "rates": rates(tape, alerts),
        "percentiles": nearest_rank_stats(values),
        "histogram": fixed_histogram(values),
        "by_detector": counts_by(alerts, "detector"),
        "by_severity": counts_by(alerts, "severity"),
        "symbols": symbol_summary(tape, alerts),
        "sparkline": sparkline(tape),
        "tape": latest_tape(tape, alerts),
    }
