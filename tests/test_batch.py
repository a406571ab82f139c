import pytest
from conftest import tape, trade
from pyspark.sql import functions as F

from tapewarden.operators import analytics as A
from tapewarden.operators.batch_flags import (
    batch_features,
    batch_flags,
    history_scan,
    mapper_projection,
    scan_lines,
    window_baselines,
    window_flags,
)
from tapewarden.operators.guardrails import guardrails, split_rejects
from tapewarden.rules import GuardrailRules
from tapewarden.sources.messages import decode_trades, rejected_messages
from tapewarden.sources.tape import normalise


def test_batch_nulls_and_precedence(spark):
    rows = [trade(i * 10, 100.0 + (i % 2) * 0.1, 100.0) for i in range(30)]
    rows.append(trade(400, 150.0, 5000.0))
    out = batch_flags(batch_features(tape(spark, rows))).orderBy("event_us").collect()
    assert (out[0]["price_mean"], out[0]["price_z"], out[0]["vol_ratio"]) == (None, 0.0, 0.0)
    assert (out[1]["price_std"], out[1]["price_z"]) == (None, 0.0)
    assert (out[-1]["detector"], out[-1]["severity"]) == ("zscore", "critical")
    assert out[-1]["reason"].startswith("price z-score ")
    assert out[-1]["vol_ratio"] >= 6


def test_batch_velocity_counts_later_trades_of_the_same_second(spark):
    rows = [trade(0.1), trade(0.9), trade(5.5), trade(6.0)]
    for limit in (1000, 100):
        df = tape(spark, rows * 60 if limit == 100 else rows)
        out = batch_features(df, rows_per_task=limit).groupBy("ts_seconds").agg(F.max("velocity").alias("v"))
        got = [r["v"] for r in out.orderBy("ts_seconds").collect()]
        scale = 60 if limit == 100 else 1
        assert got == [2 * scale, 3 * scale, 2 * scale]


def test_history_scan(spark):
    rows = [trade(i, 100.0 + (0.5 if i % 2 else -0.5), 100.0) for i in range(40)]
    scan = history_scan(tape(spark, [*rows, trade(41, 130.0, 100.0), trade(42, 100.0, 900.0)]))
    assert {r["detector"] for r in scan.collect()} == {"zscore", "volume_spike"}
    lines = {tuple(r) for r in scan_lines(scan).collect()}
    assert any(line[:4] == ("AAPL", "zscore", "130.0000", "100.00") for line in lines)
    assert history_scan(tape(spark, [*rows[:5], trade(9, 130.0)])).count() == 0
    assert history_scan(tape(spark, rows).limit(0)).count() == 0


def test_mapper_skips_malformed_rows(spark):
    raw = spark.createDataFrame([("AAPL", "100", "10"), ("AAPL", None, "1"), ("x", "abc", "1")], "symbol string, price string, quantity string")
    assert [tuple(r) for r in mapper_projection(raw).collect()] == [("AAPL", 100.0, 10.0)]


def test_window_verdict_needs_eleven_trades(spark):
    at = lambda n: tape(spark, [*[trade(i * 0.1) for i in range(n - 1)], trade(2, 200.0)])
    timed = lambda df: df.withColumn("timestamp", F.timestamp_micros("event_us"))
    assert window_flags(window_baselines(timed(at(10)))).count() == 0
    # six overlapping windows hold all eleven
    assert window_flags(window_baselines(timed(at(11)))).count() == 6


def test_decode_and_rejects(spark):
    texts = [
        '{"trade_id":"a","timestamp":"2026-01-01T15:00:00.123456Z","symbol":" aapl ","price":"10","quantity":2,"side":"sell"}',
        '{"trade_id":"b","symbol":"X","price":0,"quantity":2}',
        '{"trade_id":"c","symbol":"X","price":1,"quantity":-3}',
        '{"trade_id":"d","symbol":"X","price":1,"quantity":1,"side":"hold"}',
        '{"trade_id":"e","price":1,"quantity":1}',
        "not json",
        '{"trade_id":"f","symbol":"X","price":1.5,"quantity":1}',
    ]
    raw = spark.createDataFrame([(t.encode(),) for t in texts], "value binary")
    good = normalise(decode_trades(raw), ingest=True).orderBy("trade_id").collect()
    assert [(r["trade_id"], r["symbol"], r["price"], r["side"], r["currency"]) for r in good] == [
        ("a", "AAPL", 10.0, "sell", "USD"),
        ("f", "X", 1.5, "buy", "USD"),
    ]
    assert good[0]["event_us"] % 1_000_000 == 123456
    assert good[1]["event_us"] is not None
    assert rejected_messages(raw).count() == len(texts) - len(good)


@pytest.mark.parametrize(
    ("bad", "code"),
    [
        (trade(0, price=5000.0), "price_bound"),
        (trade(0, quantity=5000.0), "qty_bound"),
        (trade(0, price=900.0, quantity=900.0), "notional_bound"),
        (trade(0, symbol="AA PL$"), "bad_symbol"),
        (trade(0, symbol=""), "bad_symbol"),
        (trade(0, price=float("inf")), "non_finite"),
        (trade(0, quantity=float("nan")), "non_finite"),
    ],
)
def test_guardrail_codes(spark, bad, code):
    rules = GuardrailRules(max_price=1000, max_quantity=1000, max_notional=500_000)
    row = guardrails(tape(spark, [bad]), rules).first()
    assert (row["ok"], row["code"]) == (False, code)
    assert row["reason"]


def test_cardinality_admits_the_first_symbols_for_good(spark):
    rows = [trade(0, symbol="A"), trade(1, symbol="B"), trade(2, symbol="C"), trade(3, symbol="A"), trade(4, symbol="C")]
    accepted, rejected = split_rejects(guardrails(tape(spark, rows), GuardrailRules(max_symbol_cardinality=2)))
    assert sorted(r["symbol"] for r in accepted.collect()) == ["A", "A", "B"]
    assert {r["code"] for r in rejected.collect()} == {"cardinality"}


def test_summary_sparkline_and_series(spark):
    df = tape(spark, [trade(i, p) for i, p in enumerate([100.0, 101.0, 102.0, 108.0])])
    none = df.limit(0).withColumns({"position": F.lit(0), "detector": F.lit("x"), "severity": F.lit("low")})
    row = A.symbol_summary(df, none).first()
    assert (row["change_pct"], row["high"], row["trades"], row["alerts"]) == (8.0, 108.0, 4, 0)
    assert A.sparkline(df).first()["spark"] == [100.0, 101.0, 102.0, 108.0]
    assert A.sparkline(df, 2).first()["spark"] == [102.0, 108.0]
    series = A.time_series(tape(spark, [trade(0)]), none, 60).collect()
    assert len(series) == 60
    assert sum(r["trades"] for r in series) == 1
    blocks = A.snapshot(df, none)
    assert blocks["kpis"].first()["total_trades"] == 4
    assert blocks["rates"].first()["trades_per_sec"] == 0.6


def test_percentiles_are_zero_based_nearest_rank(spark):
    values = spark.range(100, 300).selectExpr("cast(id as double) as value")
    for limit in (None, 30):
        row = A.nearest_rank_stats(values, limit).first()
        assert (row["count"], row["p50"], row["p95"], row["p99"], row["max"]) == (200, 200.0, 290.0, 298.0, 299.0)
    histogram = A.fixed_histogram(values)
    assert histogram.count() == 11
    assert histogram.agg(F.sum("count")).first()[0] == 200
    assert A.nearest_rank_stats(values.limit(0)).first()["count"] == 0


def test_windows_need_one_exchange_per_tape_and_no_row_python(spark):
    from tapewarden.operators.rolling import engine_windows

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = engine_windows(tape(spark, [trade(i) for i in range(3)]))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
    assert "BatchEvalPython" not in plan
