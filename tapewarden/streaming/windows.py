"""Sliding-window surveillance on a trade stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.batch_flags import window_baselines, window_flags
from ..sources.messages import decode_trades

WATERMARK = "1 minute"


def stream_trades(messages: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Valid trades of a message stream; rows later than the watermark are dropped by the aggregation."""
    return decode_trades(messages).withWatermark("timestamp", watermark)


def stream_window_flags(
    trades: DataFrame,
    window: str = "30 seconds",
    slide: str = "5 seconds",
    price_z: float = 3.0,
    max_trades: int = 200,
) -> DataFrame:
    """The batch verdict over a stream: same aggregation, same filter.

    State is one aggregate row per open window and symbol, with map-side
    partial aggregation, so a hot symbol costs a task its windows, not its trades.
    """
    return window_flags(window_baselines(trades, window, slide), price_z, max_trades)


def console_updates(flags: DataFrame, checkpoint: str) -> DataStreamWriter:
    """Windows are shown again whenever they change."""
    return (
        flags.writeStream.outputMode("update")
        .format("console")
        .option("truncate", "false")
        .option("checkpointLocation", checkpoint)
    )


def upsert_updates(flags: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keep the changes of every micro-batch under its own id, so a replayed batch overwrites itself.

    ``latest_updates`` turns the folder into the current state per window.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return flags.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def latest_updates(updates: DataFrame) -> DataFrame:
    """The last state of every window from a folder of updates."""
    from pyspark.sql import functions as F

    values = [c for c in updates.columns if c not in ("batch", "window_start", "window_end", "symbol")]
    last = F.max_by(F.struct(*values), "batch").alias("_last")
    return updates.groupBy("window_start", "window_end", "symbol").agg(last).select(
        "window_start", "window_end", "symbol", "_last.*"
    )
