"""Own trade sources and alert sinks through Spark's Python data source API.

A source is a log of segments: files that are never changed, named in the order in which they
appear. ``spark.read`` takes them all, ``spark.readStream`` takes the ones behind the offset
of the last micro-batch, each segment as one task, and the offset survives restarts in the query's
checkpoint. Rows are messages (``value``), so ``decode_messages`` validates them like those of any
other source. A sink writes parts that only count once the batch is committed; a batch that is
run again replaces its own files.

Both are found by name after :func:`register_plugins`. A source of another kind overrides
``segments`` and ``lines``, a sink ``store``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import Row

from ..session import ship_package


@dataclass
class Segment(InputPartition):
    name: str


class _SegmentReader:
    """What batch and stream share; the folder has to be one that every executor sees."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def segments(self) -> list[str]:
        """Names in the order of their appearance; one that begins with a dot is still being written."""
        return sorted(name for name in os.listdir(self.path) if not name.startswith((".", "_")))

    def lines(self, name: str) -> Iterator[str]:
        with open(os.path.join(self.path, name), encoding="utf-8", errors="replace") as segment:
            for line in segment:
                if line.strip():
                    yield line.rstrip("\n")

    def read(self, partition: Segment) -> Iterator[tuple[str]]:
        for line in self.lines(partition.name):
            yield (line,)


class SegmentBatchReader(_SegmentReader, DataSourceReader):
    def partitions(self) -> list[Segment]:
        return [Segment(name) for name in self.segments()]


class SegmentStreamReader(_SegmentReader, DataSourceStreamReader):
    """Offsets are the name of the last segment taken."""

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(self.segments(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(name) for name in self.segments() if start["last"] < name <= end["last"]]

    def commit(self, end: dict) -> None:
        """Segments stay where they are: another query may still read them."""


class TradeTape(DataSource):
    """``format("trade_tape").load(folder)``: JSON messages of a folder of segments."""

    @classmethod
    def name(cls) -> str:
        return "trade_tape"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> SegmentBatchReader:
        return SegmentBatchReader(self.options)

    def streamReader(self, schema) -> SegmentStreamReader:
        return SegmentStreamReader(self.options)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class _PartWriter:
    """Parts are written beside their place and moved there by the commit."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def store(self, name: str, rows: Iterable[Row]) -> int:
        n = 0
        with open(os.path.join(self.path, name), "w", encoding="utf-8") as part:
            for row in rows:
                part.write(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) + "\n")
                n += 1
        return n

    def write(self, iterator: Iterator[Row]) -> Part:
        os.makedirs(self.path, exist_ok=True)
        name = f".part-{uuid.uuid4().hex}"
        return Part(name, self.store(name, iterator))

    def publish(self, messages: list[Part | None], batch: str) -> None:
        """A batch that was published before is replaced."""
        old = [n for n in os.listdir(self.path) if n.startswith(f"{batch}-")] if os.path.isdir(self.path) else []
        for name in old:
            os.remove(os.path.join(self.path, name))
        for k, part in enumerate(p for p in messages if p is not None):
            held = os.path.join(self.path, part.name)
            os.replace(held, os.path.join(self.path, f"{batch}-{k:05d}.jsonl")) if part.rows else os.remove(held)

    def discard(self, messages: list[Part | None]) -> None:
        for part in messages:
            if part is not None and os.path.exists(os.path.join(self.path, part.name)):
                os.remove(os.path.join(self.path, part.name))


class AlertBatchWriter(_PartWriter, DataSourceWriter):
    def commit(self, messages: list[Part | None]) -> None:
        self.publish(messages, f"batch-{uuid.uuid4().hex[:12]}")

    def abort(self, messages: list[Part | None]) -> None:
        self.discard(messages)


class AlertStreamWriter(_PartWriter, DataSourceStreamWriter):
    def commit(self, messages: list[Part | None], batchId: int) -> None:
        self.publish(messages, f"stream-{batchId:09d}")

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        self.discard(messages)


class AlertLog(DataSource):
    """``format("alert_log").save(folder)``: JSON lines, one file for each task that had rows."""

    @classmethod
    def name(cls) -> str:
        return "alert_log"

    def writer(self, schema, overwrite: bool) -> AlertBatchWriter:
        return AlertBatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> AlertStreamWriter:
        return AlertStreamWriter(self.options)


def register_plugins(spark: SparkSession, *more: type[DataSource]) -> None:
    """Make the two, and ``more`` of a user's own, known by name."""
    ship_package(spark)
    for source in (TradeTape, AlertLog, *more):
        spark.dataSource.register(source)
