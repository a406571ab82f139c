"""Per-client sliding-minute admission over a submission log.

A hit is accepted while fewer than ``per_minute`` *accepted* hits lie in the
last 60 seconds (one exactly 60 s old still counts). Rejected hits leave no
trace, so the rule is a sequential fold per client. It restarts wherever a
client pauses for more than a minute, which cuts a client into independent
sessions; a session is streamed in order with a state of at most
``per_minute`` times, never collected.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .split import CHUNK, HALO, ROWS_PER_TASK, split_by_rank

_MINUTE_US = 60_000_000


def _sessions(hits: DataFrame, rows_per_task: int) -> DataFrame:
    """Add ``_session``: it changes where a client was quiet for more than a minute."""
    order = ("event_us", "hit_id")
    cut, group, was_cut, _ = split_by_rank(hits, ["client"], order, halo=1, rows_per_task=rows_per_task)
    by_client = Window.partitionBy(*group).orderBy(*order)
    gap = F.col("event_us") - F.lag("event_us").over(by_client)
    marked = (
        cut.withColumn("_gap", gap)
        .withColumn("_start", F.when(F.col(HALO), 0).when(F.col("_gap") <= _MINUTE_US, 0).otherwise(1))
        .withColumn("_session", F.sum("_start").over(by_client.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(~F.col(HALO))
    )
    if was_cut:
        earlier = Window.partitionBy("client").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        base = marked.groupBy("client", CHUNK).agg(F.sum("_start").alias("_n"))
        base = base.select("client", CHUNK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
        marked = marked.join(base, ["client", CHUNK]).withColumn("_session", F.col("_session") + F.col("_base"))
    return marked.drop(CHUNK, HALO, "_gap", "_start", "_base")


def admitted(times: np.ndarray, per_minute: int, held: deque[int]) -> np.ndarray:
    """Which of the sorted ``times`` are accepted; ``held``, the accepted ones of the last minute, is carried on.

    Free places are filled at once, and where there is none a sorted search finds the first hit after the oldest
    accepted one has left: rejected hits cost nothing, so the work follows the accepted ones.
    """
    accepted = np.zeros(len(times), dtype=bool)
    at = 0
    while at < len(times):
        while held and held[0] < times[at] - _MINUTE_US:
            held.popleft()
        free = per_minute - len(held)
        if free <= 0:
            at += int(np.searchsorted(times[at:], held[0] + _MINUTE_US, side="right"))
            continue
        accepted[at : at + free] = True
        held.extend(times[at : at + free].tolist())
        at += free
    return accepted


def admission(hits: DataFrame, per_minute: int = 600, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``accepted`` to ``hits(client, event_us, hit_id, …)``; ``per_minute <= 0`` accepts all."""
    if per_minute <= 0:
        return hits.withColumn("accepted", F.lit(True))
    sessions = _sessions(hits, rows_per_task)

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque[int] = deque()
        for batch in batches:
            accepted = admitted(batch["event_us"].to_numpy(), per_minute, held)
            yield batch.assign(accepted=accepted)

    keys = ["client", "_session"]
    schema = T.StructType([*sessions.schema.fields, T.StructField("accepted", T.BooleanType())])
    # the grouping needs exactly this layout, so the rows arrive in order without another sort
    ordered = sessions.repartition(*keys).sortWithinPartitions(*keys, "event_us", "hit_id")
    return ordered.groupBy(*keys).applyInPandas(fold, schema).drop("_session")
