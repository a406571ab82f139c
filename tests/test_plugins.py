"""Sources and sinks by name: whole reads, micro-batches with offsets over restarts, commits and replays."""

import json
from pathlib import Path

from conftest import tape, trade
from pyspark.sql import functions as F

from tapewarden import Rules, run_engine
from tapewarden.schema import TRADE
from tapewarden.sources.messages import decode_trades
from tapewarden.sources.plugin import AlertStreamWriter, Part, TradeTape, register_plugins
from tapewarden.streaming.engine import decoded_stream, stream_alerts, use_rocksdb

QUIET = Rules().replace(isolation_forest={"enabled": False})


def segment(folder: Path, name: str, df) -> None:
    folder.mkdir(exist_ok=True)
    timed = df.withColumn("timestamp", F.timestamp_micros("event_us"))
    lines = [r[0] for r in timed.select(F.to_json(F.struct(*TRADE.fieldNames()))).collect()]
    (folder / name).write_text("\n".join([*lines, "{broken", ""]))


def rows(a: int, b: int) -> list:
    return [trade(k, 100.0 + 20 * (k % 9 == 8), name=f"n{k:03d}") for k in range(a, b)]


def test_batch_source_reads_every_segment(spark, tmp_path):
    register_plugins(spark)
    segment(tmp_path / "in", "0001", tape(spark, rows(0, 20)))
    segment(tmp_path / "in", "0002", tape(spark, rows(20, 30)))
    (tmp_path / "in" / ".0003").write_text("still being written")
    messages = spark.read.format("trade_tape").load(str(tmp_path / "in"))
    assert messages.columns == ["value"] and messages.rdd.getNumPartitions() == 2
    assert sorted(r["trade_id"] for r in decode_trades(messages).collect()) == [f"n{k:03d}" for k in range(30)]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Each query takes the new segments only; alerts through source and sink equal the batch engine's."""
    register_plugins(spark)
    use_rocksdb(spark)
    for k, (a, b) in enumerate([(0, 20), (20, 22), (22, 40)]):
        segment(tmp_path / "in", f"{k:04d}", tape(spark, rows(a, b)))
        alerts = stream_alerts(decoded_stream(spark.readStream.format("trade_tape").load(str(tmp_path / "in"))), QUIET)
        writer = alerts.writeStream.format("alert_log").option("path", str(tmp_path / "out"))
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = [json.loads(line) for f in sorted((tmp_path / "out").glob("*.jsonl")) for line in f.read_text().splitlines()]
    want = run_engine(tape(spark, rows(0, 40)), QUIET).collect()
    assert sorted((g["trade_id"], g["detector"]) for g in got) == sorted((w["trade_id"], w["detector"]) for w in want) and want
    assert not list((tmp_path / "out").glob(".part-*"))


def test_batch_sink_and_replayed_commits(spark, tmp_path):
    register_plugins(spark)
    alerts = run_engine(tape(spark, rows(0, 40)), QUIET)
    for _ in range(2):
        alerts.write.format("alert_log").mode("append").save(str(tmp_path / "batch"))
    assert spark.read.json(str(tmp_path / "batch")).count() == 2 * alerts.count()
    sink = AlertStreamWriter({"path": str(tmp_path / "stream")})
    for turn in range(2):  # the same micro-batch, run again after a failure
        part = sink.write(iter(alerts.limit(3).collect()))
        assert part.rows == 3
        sink.commit([part, None, sink.write(iter([]))], 7)
    assert [f.name for f in (tmp_path / "stream").iterdir()] == ["stream-000000007-00000.jsonl"]
    lost = sink.write(iter(alerts.limit(1).collect()))
    sink.abort([lost, Part(".part-gone", 1), None], 8)
    assert len(list((tmp_path / "stream").iterdir())) == 1


def test_a_source_of_ones_own(spark, tmp_path):
    class Reversed(TradeTape):
        @classmethod
        def name(cls):
            return "reversed_tape"

        def reader(self, schema):
            held = super().reader(schema)

            class Reader(type(held)):
                def lines(self, name):
                    return (line[::-1] for line in super().lines(name))

            return Reader(self.options)

    register_plugins(spark, Reversed)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text("abc\n")
    assert [r.value for r in spark.read.format("reversed_tape").load(str(tmp_path / "in")).collect()] == ["cba"]
