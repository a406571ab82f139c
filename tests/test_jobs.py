import json
import random

import pytest
from conftest import SMALL, tape, trade
from pyspark.sql import functions as F

from tapewarden import Rules, run_engine
from tapewarden.operators.features import FEATURES
from tapewarden.plans.backtest import backtest, nightly
from tapewarden.plans.tapes import lineitem_tape
from tapewarden.plans.training import score_history, train
from tapewarden.schema import TRADE
from tapewarden.sinks import console_lines, fan_out, quality_checks, quality_gate, record_run, run_freshness
from tapewarden.operators.analytics import audit_rollup
from tapewarden.sources.scans import replay_trades, scan_audit, scan_job_runs
from tapewarden.sources.tape import normalise
from tapewarden.streaming.engine import alerts_to_json, decoded_stream, fan_out_batches, stream_alerts, stream_engine, use_rocksdb
from tapewarden.streaming.windows import latest_updates, stream_window_flags, upsert_updates


def write_trades(df, path, mode="append"):
    df.withColumn("timestamp", F.timestamp_micros("event_us")).select(*TRADE.fieldNames()).coalesce(1).write.mode(
        mode
    ).parquet(str(path))


def drain(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_backtest_reports_and_reruns(spark, tmp_path):
    write_trades(lineitem_tape(spark, SMALL), tmp_path / "trades")
    for _ in range(2):
        report = backtest(spark, str(tmp_path / "trades"), str(tmp_path / "out"))
    flagged = report.summary.first()["flagged"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == flagged > 0
    assert report.first.count() == 10
    assert report.by_detector.agg(F.sum("n")).first()[0] == flagged
    checks = nightly(spark, str(tmp_path / "trades"), str(tmp_path / "lake"), "2025-01-01")
    assert checks.filter("not passed").count() == 0
    gold = spark.read.parquet(str(tmp_path / "lake/gold"))
    assert {"EVENT_TS", "SYMBOL", "SCORE", "DT"} <= set(gold.columns)
    assert spark.read.parquet(str(tmp_path / "lake/crosscheck")).count() > 0


def test_quality_gate(spark, tmp_path):
    with pytest.raises(ValueError, match="_SUCCESS"):
        quality_gate(spark, str(tmp_path / "nothing"))
    bad = spark.createDataFrame([("A", "zscore", "urgent", 1.0, 1.0, 0.5)], "symbol string, detector string, severity string, price double, quantity double, score double")
    bad.write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="bad_severity"):
        quality_gate(spark, str(tmp_path / "bad"))
    assert not quality_checks(bad.limit(0)).filter("check = 'empty'").first()["passed"]


def test_run_log(spark, tmp_path):
    record_run(spark, str(tmp_path / "runs"), cycle=1, trades=10, spark="ok")
    record_run(spark, str(tmp_path / "runs"), cycle=2, trades=20, spark="ok")
    runs = scan_job_runs(spark, str(tmp_path / "runs"))
    assert run_freshness(runs).first()["status"] == "up"
    assert run_freshness(runs, F.col("last_epoch") + 900).first()["status"] == "stale"
    assert run_freshness(runs.limit(0)).first()["status"] == "unknown"


def test_audit_log_scan(spark, tmp_path):
    """The declared columns only; lines that are no JSON become empty rows."""
    lines = [
        {"ts": "2026-01-01T15:00:00Z", "level": "INFO", "msg": "audit", "action": "trade_ingested", "outcome": "ok", "client": "a", "audit": True, "more": 1},
        {"ts": "2026-01-01T15:00:01Z", "action": "trade_rejected", "outcome": "rejected", "client": "a", "code": "price_bound"},
    ]
    (tmp_path / "audit.jsonl").write_text("\n".join([*map(json.dumps, lines), "not json"]))
    log = scan_audit(spark, str(tmp_path / "audit.jsonl"))
    assert "more" not in log.columns and log.count() == 3
    top = audit_rollup(log.filter("action is not null")).filter("action is null and outcome is null and client is null and code is null")
    assert [r["n"] for r in top.collect()][-1:] == [2]


def test_fan_out_survives_a_failing_sink(spark):
    seen = []

    def broken(df):
        raise OSError("disk full")

    errors = fan_out(spark.range(3), {"broken": broken, "count": lambda df: seen.append(df.count())})
    assert seen == [3]
    assert list(errors) == ["broken"]


def test_console_line(spark):
    alerts = run_engine(tape(spark, [trade(0, 100.0), trade(1, 110.0)]))
    line = console_lines(alerts).first()["line"]
    assert line.startswith("15:00:01 [CRITICAL] AAPL     price_spike      score=1.00 :: instantaneous price surge")


def key(df):
    return sorted(tuple(r) for r in df.select("trade_id", "detector", "severity", F.round("score", 9)).collect())


@pytest.mark.parametrize("forest", [True, False])
def test_stream_in_many_batches_equals_batch(spark, tmp_path, forest):
    """Windows, clocks and the forest's training rows and models survive restarts between micro-batches."""
    use_rocksdb(spark)
    df = lineitem_tape(spark, SMALL).cache()
    edges = df.approxQuantile("event_us", [0.3, 0.6], 0.0)
    parts = [df.filter(F.col("event_us") <= edges[0]), df.filter((F.col("event_us") > edges[0]) & (F.col("event_us") <= edges[1])), df.filter(F.col("event_us") > edges[1])]
    rules, out = Rules().replace(isolation_forest={"enabled": forest}), str(tmp_path / "alerts")
    for part in parts:
        write_trades(part, tmp_path / "in")
        # a new query per batch: windows and clocks come back from the checkpoint
        alerts = stream_alerts(normalise(replay_trades(spark, str(tmp_path / "in"))), rules)
        drain(alerts_to_json(alerts, out, str(tmp_path / "checkpoint")))
    got = spark.read.schema(alerts.schema).json(out)
    assert key(got) == key(run_engine(df, rules))
    assert (got.filter("detector = 'isolation_forest'").count() > 0) == forest
    assert got.filter("out_of_order").count() == 0
    df.unpersist()


def test_forest_refits_in_small_micro_batches(spark, tmp_path):
    """Refits that fall into, between and at the end of micro-batches give the batch models."""
    use_rocksdb(spark)
    rng = random.Random(2)
    rows = [trade(k, 100 + rng.gauss(0, 1) + 9 * (k % 37 == 0), 100 + rng.random() * 10 + 300 * (k % 41 == 0), "buy" if rng.random() < 0.5 else "sell") for k in range(170)]
    df = tape(spark, rows)
    rules = Rules().replace(isolation_forest={"train_size": 40, "retrain_every": 15, "score_threshold": 0.5, "contamination": 0.2}, alert_cooldown_seconds=0.0)
    for a, b in ((0, 30), (30, 75), (75, 76), (76, 150), (150, 170)):
        write_trades(tape(spark, rows).filter(F.col("trade_id").between(f"t{a:06d}", f"t{b - 1:06d}")), tmp_path / "in")
        alerts = stream_alerts(normalise(replay_trades(spark, str(tmp_path / "in"))), rules)
        drain(alerts_to_json(alerts, str(tmp_path / "alerts"), str(tmp_path / "checkpoint")))
    got, want = key(spark.read.schema(alerts.schema).json(str(tmp_path / "alerts"))), key(run_engine(df, rules))
    assert got == want and sum(r[1] == "isolation_forest" for r in want) > 5


def test_idle_symbols_go_and_late_trades_are_rejected(spark, tmp_path):
    use_rocksdb(spark)
    batches = [
        [trade(k, 100.0 + k % 2, symbol="IDLE", name=f"a{k:02d}") for k in range(25)],
        [trade(92, 50.0, symbol="BUSY", name="b0"), trade(100, 50.0, symbol="BUSY", name="b1")],
        [trade(60, 80.0, symbol="BUSY", name="late"), trade(95, 80.0, symbol="BUSY", name="b2"), trade(101, 50.0, symbol="BUSY", name="b3")],
        # within the window's 300 s, but IDLE has been forgotten by now: no previous price, no warm-up
        [trade(102, 200.0, symbol="IDLE", name="back"), trade(103, 230.0, symbol="IDLE", name="then")],
    ]
    for rows in batches:
        write_trades(tape(spark, rows), tmp_path / "in")
        events = stream_engine(normalise(replay_trades(spark, str(tmp_path / "in"))), Rules(), lateness_seconds=10.0, idle_seconds=30.0)
        drain(fan_out_batches(events, str(tmp_path / "out"), str(tmp_path / "cp"), rejects=str(tmp_path / "rejects")))
    rejects = spark.read.json(str(tmp_path / "rejects")).collect()
    assert [(r["trade_id"], r["symbol"], r["reason"]) for r in rejects] == [("late", "BUSY", "behind the watermark")]
    alerts = spark.read.json(str(tmp_path / "out"))
    found = {(r["trade_id"], r["detector"], r["out_of_order"]) for r in alerts.filter("detector = 'price_spike'").collect()}
    assert found == {("b2", "price_spike", True), ("then", "price_spike", False)}


def test_late_trades_are_judged_in_their_place_and_marked(spark, tmp_path):
    use_rocksdb(spark)
    messages = lambda rows: tape(spark, rows).withColumn("timestamp", F.timestamp_micros("event_us")).select(F.to_json(F.struct(*TRADE.fieldNames())).alias("value"))
    for rows in ([trade(0, 100.0, name="a"), trade(10, 100.0, name="b")], [trade(5, 120.0, name="late")]):
        messages(rows).unionByName(spark.createDataFrame([("broken",)], "value string")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
        alerts = stream_alerts(decoded_stream(stream))
        drain(alerts_to_json(alerts, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = [(r["trade_id"], r["detector"], r["out_of_order"]) for r in spark.read.schema(alerts.schema).json(str(tmp_path / "out")).collect()]
    assert got == [("late", "price_spike", True)]


def test_window_stream_updates(spark, tmp_path):
    rows = [trade(i * 0.1) for i in range(30)] + [trade(3, 200.0)]
    write_trades(tape(spark, rows), tmp_path / "in")
    for extra in ([], [trade(3.5, 100.0, name="more")]):
        if extra:
            write_trades(tape(spark, extra), tmp_path / "in")
        trades = replay_trades(spark, str(tmp_path / "in")).withWatermark("timestamp", "1 minute")
        drain(upsert_updates(stream_window_flags(trades), str(tmp_path / "out"), str(tmp_path / "cp")))
    state = latest_updates(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert len(state) == 6
    assert {r["trade_count"] for r in state} == {32}


def test_training_artifacts(spark, tmp_path):
    rows = []
    for i in range(400):
        spike = i % 40 == 39
        rows.append(trade(i, 100.0 + (i % 3) * 0.1 + 30 * spike, 100.0, "buy" if i % 2 else "sell", label="price_spike" if spike else None))
    df = tape(spark, rows)
    result = train(spark, df, str(tmp_path), boosted_trees=5, isolation_trees=20)
    assert result["dataset"] == {"train": 280, "test": 120, "positives": 10}
    best = result["models"][result["champion"]]
    assert best["roc_auc"] > 0.7
    assert json.loads(spark.read.text(str(tmp_path / "metrics")).first()["value"])["champion"] == result["champion"]
    card = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "card")).collect())
    assert "fitted on 280 trades" in card and all(f"`{name}`" in card for name in FEATURES)
    scored = score_history(spark, df.drop("label"), str(tmp_path))
    assert scored.filter("predicted = 1").count() > 0
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
