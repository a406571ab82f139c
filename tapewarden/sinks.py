"""Writers: partitioned lake tables, text outputs, gold shape, run log and the quality gate."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import event_day, severity_rank
from .schema import JOB_RUN


def write_partitioned(df: DataFrame, path: str, fmt: str = "parquet", sort_by: tuple[str, ...] = ("symbol",)) -> None:
    """Overwrite only the days present in ``df`` (idempotent reruns), sorted inside each file.

    Rows are spread by day *and* symbol hash, so one busy day is not one task
    and its files stay clustered by symbol; adaptive execution splits what is
    still too big.
    """
    columns = [c for c in sort_by if c in df.columns]
    # a run that fails must not leave the marker of the one before it
    _hadoop_file(df.sparkSession, path, "_SUCCESS", lambda fs, marker: fs.delete(marker, False))
    (
        df.hint("rebalance", "dt", *columns[:1])
        .sortWithinPartitions("dt", *columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .format(fmt)
        .save(path)
    )
    # a dynamic overwrite leaves no marker of its own
    _hadoop_file(df.sparkSession, path, "_SUCCESS", lambda fs, marker: fs.create(marker, True).close())


def _hadoop_file(spark: SparkSession, path: str, name: str, use: Callable):
    """Apply ``use(file system, file)``; works on any Hadoop file system."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)
    return use(file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), file)


def curated(tape: DataFrame) -> DataFrame:
    """The curated (silver) trade layout with ``notional`` and the day partition."""
    return tape.select(
        "trade_id",
        F.timestamp_micros("event_us").alias("timestamp"),
        "symbol",
        "price",
        "quantity",
        "side",
        "venue",
        (F.col("price") * F.col("quantity")).alias("notional"),
        event_day().alias("dt"),
    )


def anomaly_rows(flagged: DataFrame) -> DataFrame:
    """The anomaly table layout; the score is always present."""
    return flagged.select(
        F.timestamp_micros("event_us").alias("timestamp"),
        "symbol",
        "detector",
        "severity",
        "price",
        "quantity",
        "score",
        "reason",
        event_day().alias("dt"),
    )


def gold_shape(anomalies: DataFrame, day: str | Column) -> DataFrame:
    """Upper-case columns, ``TIMESTAMP`` renamed to ``EVENT_TS``, and the load day as ``DT``."""
    day = F.to_date(F.lit(day)) if isinstance(day, str) else day
    kept = anomalies.drop("dt").toDF(*[c.upper() for c in anomalies.columns if c != "dt"])
    return kept.withColumnRenamed("TIMESTAMP", "EVENT_TS").withColumn("DT", day)


def write_gold_jdbc(gold: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a warehouse over JDBC; the driver has to be on the class path."""
    gold.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()


def append_alerts_json(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def write_tsv(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)


def console_line() -> Column:
    """``HH:mm:ss [SEVERITY] SYMBOL DETECTOR score=… :: reason`` as one text column."""
    return F.concat(
        F.date_format(F.timestamp_micros("event_us"), "HH:mm:ss"),
        F.lit(" ["), F.lpad(F.upper("severity"), 8, " "), F.lit("] "),
        F.format_string("%-8s %-16s score=%.2f :: ", "symbol", "detector", "score"), F.col("reason"),
    )


def console_lines(alerts: DataFrame) -> DataFrame:
    return alerts.select(console_line().alias("line"))


def record_run(spark: SparkSession, path: str, /, **values: object) -> None:
    """Append one row to the job-run log."""
    row = {"epoch": int(time.time()), **values}
    spark.createDataFrame([tuple(row.get(f) for f in JOB_RUN.fieldNames())], JOB_RUN).coalesce(1).write.mode(
        "append"
    ).json(path)


def run_freshness(runs: DataFrame, now: Column | None = None, stale_after: int = 900) -> DataFrame:
    """``up``, ``stale`` or ``unknown`` (no run yet) from the latest run."""
    now = F.unix_timestamp() if now is None else now
    age = now - F.col("last_epoch")
    status = F.when(F.col("last_epoch").isNull(), "unknown").when(age < stale_after, "up").otherwise("stale")
    return runs.agg(F.max("epoch").alias("last_epoch"), F.count(F.lit(1)).alias("runs")).withColumn("status", status)


def quality_checks(anomalies: DataFrame) -> DataFrame:
    """One row per check with how many rows break it, from one pass."""
    checks = {
        "empty": F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long"),
        "missing_key": F.count_if(F.col("symbol").isNull() | F.col("detector").isNull()),
        "bad_price": F.count_if(F.coalesce(F.col("price") <= 0, F.lit(True))),
        "bad_quantity": F.count_if(F.coalesce(F.col("quantity") <= 0, F.lit(True))),
        "bad_severity": F.count_if(severity_rank(F.col("severity")).isNull()),
        "bad_score": F.count_if(~F.coalesce(F.col("score").between(0.0, 1.0), F.lit(False))),
    }
    wide = anomalies.agg(*[value.alias(name) for name, value in checks.items()])
    lines = [F.struct(F.lit(name).alias("check"), F.col(name).alias("violations")) for name in checks]
    return wide.select(F.inline(F.array(*lines))).withColumn("passed", F.col("violations") == 0)


def has_success_marker(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its ``_SUCCESS`` file."""
    return _hadoop_file(spark, path, "_SUCCESS", lambda fs, marker: fs.exists(marker))


def quality_gate(spark: SparkSession, path: str, fmt: str = "parquet", day: str | None = None) -> DataFrame:
    """Fail unless the output was finished and passes every check; returns the checks. With ``day``, of that day only."""
    if not has_success_marker(spark, path):
        raise ValueError(f"no _SUCCESS marker under {path}")
    rows = spark.read.format(fmt).load(path)
    checks = quality_checks(rows if day is None else rows.filter(F.col("dt") == day))
    broken = [r["check"] for r in checks.filter("not passed").collect()]  # at most one row per check
    if broken:
        raise ValueError(f"quality checks failed for {path}: {', '.join(broken)}")
    return checks


def fan_out(df: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Give one result to several sinks; a failing sink does not stop the others. Returns the errors."""
    kept = df.persist()
    errors = {}
    try:
        for name, sink in sinks.items():
            try:
                sink(kept)
            except Exception as exc:  # noqa: BLE001 - the point is to go on
                errors[name] = f"{type(exc).__name__}: {exc}"
    finally:
        kept.unpersist()
    return errors
