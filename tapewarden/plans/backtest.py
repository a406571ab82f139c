"""The batch jobs: backtest, whole-history scan and the nightly sequence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import backtest_summary, counts_by, first_anomalies
from ..operators.batch_flags import batch_features, batch_flags, history_scan, scan_lines
from ..operators.evaluation import scan_crosscheck
from ..operators.split import checkpointed
from ..functions.columns import event_day
from ..sinks import anomaly_rows, curated, gold_shape, quality_gate, write_partitioned, write_tsv
from ..sources.scans import scan_records, scan_trades
from ..sources.tape import normalise


@dataclass(frozen=True)
class BacktestReport:
    """Small summaries of one backtest; every one is derived from a single materialised result."""

    flagged: DataFrame
    summary: DataFrame
    by_detector: DataFrame
    first: DataFrame


def backtest(
    spark: SparkSession,
    path: str,
    output: str | None = None,
    fmt: str = "parquet",
    lookback: int = 100,
    price_z: float = 3.0,
    vol_ratio: float = 6.0,
    velocity: int = 25,
    sink_format: str = "parquet",
) -> BacktestReport:
    """Flag a trade history; with ``output`` the anomalies are written as day partitions."""
    report = flagged_report(normalise(scan_trades(spark, path, fmt)), lookback, price_z, vol_ratio, velocity)
    if output:
        write_partitioned(anomaly_rows(report.flagged.filter("anomalous")), output, sink_format)
    return report


def flagged_report(
    tape: DataFrame, lookback: int = 100, price_z: float = 3.0, vol_ratio: float = 6.0, velocity: int = 25
) -> BacktestReport:
    """The batch flags of a tape and their summaries.

    The flags are computed once and the summaries read the checkpoint, instead
    of running the windows again for each of them.
    """
    flags = batch_flags(batch_features(tape, lookback), price_z, vol_ratio, velocity)
    slim = flags.select(
        "trade_id", "event_us", "symbol", "price", "quantity",
        "anomalous", "detector", "severity", "score", "reason",
    )
    flagged = checkpointed(slim)
    anomalies = flagged.filter("anomalous")
    return BacktestReport(
        flagged, backtest_summary(flagged), counts_by(anomalies, "detector"), first_anomalies(flagged)
    )


def history_scan_job(spark: SparkSession, path: str, output: str, fmt: str = "json", **thresholds) -> DataFrame:
    """Whole-history scan of raw records to a tab-separated file."""
    from ..operators.batch_flags import mapper_projection

    scan = history_scan(mapper_projection(scan_records(spark, path, fmt)), **thresholds)
    write_tsv(scan_lines(scan), output)
    return scan


def nightly(spark: SparkSession, trades: str, lake: str, day: str, fmt: str = "parquet") -> DataFrame:
    """One day: silver, backtest, cross-check, gold load, quality gate. Returns the gate's checks.

    Only trades of ``day`` (UTC) count; reruns replace the day's partitions only.
    """
    tape = normalise(scan_trades(spark, trades, fmt)).filter(event_day() == day)
    write_partitioned(curated(tape), f"{lake}/silver")
    report = flagged_report(tape)
    write_partitioned(anomaly_rows(report.flagged.filter("anomalous")), f"{lake}/anomalies")
    check = scan_crosscheck(report.flagged.filter("anomalous"), history_scan(tape))
    check.withColumn("dt", F.lit(day)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("dt").parquet(f"{lake}/crosscheck")
    gold = gold_shape(anomaly_rows(report.flagged.filter("anomalous")), day)
    gold.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("DT").parquet(f"{lake}/gold")
    return quality_gate(spark, f"{lake}/anomalies", day=day)
