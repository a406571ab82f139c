"""The registered queries: every operator over the projected tapes, with comparable outputs.

Doubles are rounded and timestamps given as microseconds, so that the results
compare exactly with the SQL in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import event_day, event_seconds, severity_rank, wall_micros
from ..operators import analytics as A
from ..operators import batch_flags as B
from ..operators import evaluation as G
from ..operators import scoring as S
from ..operators.admission import admission
from ..operators.alerts import candidate_alerts, decisions, engine_stats, order_alerts, run_engine
from ..operators.detectors import BUILT_IN, Detector, PandasDetector, Verdict, raised_by, self_trade_column
from ..operators.features import FEATURES, model_features
from ..operators.guardrails import guardrails, split_rejects
from ..operators.learning import labelled_matrix, time_split, tree_samples
from ..operators.rolling import engine_windows, isolation_features
from ..operators.rolling import recent_rows as rolling_recent
from ..operators.split import checkpointed
from ..rules import GuardrailRules, Rules
from ..sinks import curated, gold_shape, quality_checks, run_freshness
from ..sources.messages import decode_messages, decode_trades
from ..sources.tape import normalise
from .tapes import event_tape, flat_tape, lineitem_tape, priced_tape, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The six detectors that SQL can check; the seventh, the online forest, has queries of its own.
COLUMN_RULES = Rules().replace(isolation_forest={"enabled": False})


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(column: str | Column, digits: int = 6) -> Column:
    named = column if isinstance(column, str) else None
    out = F.round(F.col(column) if named else column, digits)
    return out.alias(named) if named else out


def _timed(tape: DataFrame) -> DataFrame:
    return tape.withColumn("timestamp", F.timestamp_micros("event_us"))


# ------------------------------------------------------------- sources, shape


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape as JSON messages; every 13th order is cut off and every 17th lacks its price."""
    tape = _timed(lineitem_tape(spark, sf_dir))
    order = F.split("trade_id", "-")[0].cast("long")
    price = F.when(order % 17 != 0, F.col("price"))
    body = F.to_json(
        F.struct(
            "trade_id", "timestamp", "symbol", price.alias("price"), "quantity", "side", "account_id", "venue"
        ),
        {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"},
    )
    return tape.select(F.when(order % 13 == 0, F.substring(body, 1, 40)).otherwise(body).cast("binary").alias("value"))


@query
def decode_validate(spark, sf_dir):
    trades = decode_trades(messages(spark, sf_dir))
    return trades.select("trade_id", F.unix_micros("timestamp").alias("event_us"), "symbol", _r("price"), "quantity", "side")


@query
def decode_rejects(spark, sf_dir):
    decoded = decode_messages(messages(spark, sf_dir))
    return decoded.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


def _untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols in lower case between spaces; every fifth order without a side, every seventh without a currency."""
    tape = lineitem_tape(spark, sf_dir)
    order = F.split("trade_id", "-")[0].cast("long")
    return _timed(tape).withColumns(
        {
            "symbol": F.concat(F.lit("  "), F.lower("symbol"), F.lit(" ")),
            "side": F.when(order % 5 != 0, F.col("side")),
            "currency": F.when(order % 7 != 0, F.lit("EUR")),
        }
    )


@query
def normalise_trades(spark, sf_dir):
    out = normalise(_untidy(spark, sf_dir))
    return out.select("trade_id", "symbol", "side", "currency", _r("notional", 4), "event_us")


@query
def event_second_counts(spark, sf_dir):
    tape = _timed(priced_tape(spark, sf_dir))
    return tape.groupBy(event_seconds().alias("ts_seconds")).agg(F.count(F.lit(1)).alias("n"))


@query
def severity_ranks(spark, sf_dir):
    """Every severity the batch flags give, ranked and with scores clamped."""
    flagged = B.batch_flags(B.batch_features(priced_tape(spark, sf_dir))).filter("anomalous")
    return flagged.groupBy("severity", severity_rank(F.col("severity")).cast("long").alias("rank")).agg(
        F.count(F.lit(1)).alias("n")
    )


GUARD = GuardrailRules(max_price=165.0, max_quantity=15_000.0, max_notional=1_500_000.0, max_symbol_cardinality=12)


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = lineitem_tape(spark, sf_dir)
    part = F.split("trade_id", "-")[2].cast("long")
    odd = tape.withColumns(
        {
            "price": F.when(part % 311 == 0, F.lit(float("nan"))).otherwise(F.col("price")),
            "symbol": F.when(part % 313 == 0, F.concat("symbol", F.lit("$"))).otherwise(F.col("symbol")),
        }
    )
    return guardrails(odd, GUARD)


@query
def guardrail_codes(spark, sf_dir):
    out = _guarded(spark, sf_dir)
    return out.groupBy(F.coalesce("code", F.lit("ok")).alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols")
    )


@query
def cardinality_cap(spark, sf_dir):
    out = _guarded(spark, sf_dir).filter(F.coalesce("code", F.lit("")).isin("", "cardinality"))
    return out.groupBy("symbol").agg(F.bool_and("ok").alias("admitted"), F.count(F.lit(1)).alias("n"))


@query
def reject_split(spark, sf_dir):
    accepted, rejected = split_rejects(_guarded(spark, sf_dir))
    ok = accepted.agg(F.lit("accepted").alias("part"), F.count(F.lit(1)).alias("n"))
    bad = rejected.agg(F.lit("rejected").alias("part"), F.count(F.lit(1)).alias("n"))
    return ok.unionByName(bad)


@query
def curated_silver(spark, sf_dir):
    out = curated(lineitem_tape(spark, sf_dir))
    return out.groupBy("dt", "symbol").agg(
        F.count(F.lit(1)).alias("trades"), _r(F.sum("notional"), 2).alias("notional"), F.max("venue").alias("venue")
    )


@query
def gold_load_shape(spark, sf_dir):
    flagged = B.batch_flags(B.batch_features(event_tape(spark, sf_dir)))
    shaped = gold_shape(B.anomalies(flagged, B.WAREHOUSE_COLUMNS), "2026-01-02")
    return shaped.select(
        F.unix_micros("EVENT_TS").alias("EVENT_US"), "SYMBOL", "DETECTOR", "SEVERITY", _r("PRICE"), "QUANTITY",
        F.date_format("DT", "yyyy-MM-dd").alias("DT"),
    )


# ------------------------------------------------------------- batch dialects


@query
def batch_rolling_features(spark, sf_dir):
    out = B.batch_features(priced_tape(spark, sf_dir))
    return out.select("trade_id", _r("price_mean"), _r("price_std"), _r("price_z", 5), _r("vol_ratio"), "velocity")


@query
def batch_velocity_counts(spark, sf_dir):
    return B.batch_velocity(priced_tape(spark, sf_dir))


def _batch_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tape = priced_tape(spark, sf_dir, "label").drop("side")
    return B.batch_flags(B.batch_features(tape))


@query
def batch_anomalies(spark, sf_dir):
    flagged = _batch_flagged(spark, sf_dir).withColumn("keep_id", F.col("trade_id"))
    out = B.anomalies(flagged, ("keep_id", *B.BACKTEST_COLUMNS))
    return out.select(
        F.col("keep_id").alias("trade_id"), F.unix_micros("timestamp").alias("event_us"), "symbol",
        _r("price"), "quantity", "detector", "severity",
    )


@query
def warehouse_projection(spark, sf_dir):
    flagged = _batch_flagged(spark, sf_dir).withColumn("keep_id", F.col("trade_id"))
    out = B.anomalies(flagged, ("keep_id", *B.WAREHOUSE_COLUMNS))
    return out.select(
        F.col("keep_id").alias("trade_id"), F.unix_micros("timestamp").alias("event_us"), "symbol", "detector",
        "severity", _r("price"), "quantity", _r("price_z", 5), _r("vol_ratio", 5),
    )


@query
def batch_detector_counts(spark, sf_dir):
    return A.counts_by(_batch_flagged(spark, sf_dir).filter("anomalous"), "detector")


@query
def severity_counts(spark, sf_dir):
    return A.counts_by(_batch_flagged(spark, sf_dir).filter("anomalous"), "severity")


@query
def backtest_summary(spark, sf_dir):
    out = A.backtest_summary(_batch_flagged(spark, sf_dir))
    return out.select("scanned", "flagged", _r("flagged_pct"))


@query
def first_anomalies(spark, sf_dir):
    out = A.first_anomalies(_batch_flagged(spark, sf_dir))
    return out.select("trade_id", "event_us", "symbol", "detector", "severity")


@query
def history_statistics(spark, sf_dir):
    out = B.history_stats(priced_tape(spark, sf_dir))
    return out.select("symbol", "trades", _r("price_mean"), _r("price_std"), _r("quantity_mean"))


@query
def history_scan(spark, sf_dir):
    out = B.history_scan(priced_tape(spark, sf_dir))
    return out.select("symbol", "detector", _r("price"), "quantity", _r("score", 5))


@query
def mapper_projection(spark, sf_dir):
    tape = lineitem_tape(spark, sf_dir)
    order = F.split("trade_id", "-")[0].cast("long")
    text = F.when(order % 19 == 0, "n/a").otherwise(F.col("quantity").cast("string"))
    raw = tape.select("symbol", F.col("price").cast("string").alias("price"), text.alias("quantity"))
    out = B.mapper_projection(raw)
    return out.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("price"), 3).alias("price"))


@query
def sliding_window_flags(spark, sf_dir):
    flags = B.window_flags(B.window_baselines(_timed(priced_tape(spark, sf_dir))), max_trades=180)
    return flags.select(
        F.unix_micros("window_start").alias("window_start_us"), F.unix_micros("window_end").alias("window_end_us"),
        "symbol", "detector", "price_z_max", "trade_count", "price_mean",
    )


# ------------------------------------------------------------- engine windows


@query
def bounded_window(spark, sf_dir):
    out = engine_windows(priced_tape(spark, sf_dir), statistics=())
    return out.select("trade_id", F.col("window_size").cast("long"), "ready")


@query
def price_statistics(spark, sf_dir):
    out = engine_windows(priced_tape(spark, sf_dir), statistics=("price_mean", "price_std"))
    return out.select("trade_id", _r("price_mean"), _r("price_std"))


@query
def volume_statistics(spark, sf_dir):
    out = engine_windows(priced_tape(spark, sf_dir), statistics=("volume_mean", "volume_std"))
    return out.select("trade_id", _r("volume_mean", 5), _r("volume_std", 5))


@query
def trimmed_median(spark, sf_dir):
    out = engine_windows(priced_tape(spark, sf_dir), statistics=("volume_median",))
    return out.select("trade_id", _r("volume_median"))


@query
def previous_price(spark, sf_dir):
    out = engine_windows(event_tape(spark, sf_dir), statistics=())
    return out.select("trade_id", _r("previous_price"))


@query
def count_within(spark, sf_dir):
    out = engine_windows(priced_tape(spark, sf_dir), statistics=())
    return out.select("trade_id", F.col("velocity").cast("long"))


@query
def side_imbalance(spark, sf_dir):
    out = engine_windows(priced_tape(spark, sf_dir), statistics=())
    return out.select("trade_id", F.col("buys").cast("long"), F.col("sells").cast("long"))


@query
def recent_rows(spark, sf_dir):
    """The trades of the last two seconds, as rows; chunks are cut, so that some look back into the one before."""
    out = rolling_recent(priced_tape(spark, sf_dir), 2.0, rows_per_task=CUT_ROWS)
    names, prices = F.transform("recent", lambda r: r["trade_id"]), F.transform("recent", lambda r: r["price"])
    return out.select(
        "trade_id", F.size("recent").cast("long").alias("n"), F.md5(F.array_join(names, ",")).alias("trades"),
        F.round(F.aggregate(prices, F.lit(0.0), lambda a, x: a + x), 3).alias("price_sum"),
    )


@query
def wash_matches(spark, sf_dir):
    out = engine_windows(lineitem_tape(spark, sf_dir), statistics=("matched_trade_id",))
    return out.filter(F.col("matched_trade_id").isNotNull()).select("trade_id", "matched_trade_id")


@query
def wash_self_trades(spark, sf_dir):
    out = lineitem_tape(spark, sf_dir).filter(self_trade_column())
    return out.select("trade_id", "symbol", "account_id")


@query
def online_model_features(spark, sf_dir):
    out = isolation_features(priced_tape(spark, sf_dir))
    return out.select("trade_id", _r("f_price_z", 5), _r("f_vol_z", 5), _r("f_ret"), "f_velocity")


@query
def trade_model_features(spark, sf_dir):
    out = model_features(priced_tape(spark, sf_dir))
    return out.select("trade_id", *[_r(name, 5) for name in FEATURES])


# ------------------------------------------------------------- detectors, alerts


def _detector_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        detector = BUILT_IN[name]
        windows = engine_windows(lineitem_tape(spark, sf_dir), statistics=detector.statistics)
        return raised_by(windows, name).select("trade_id", "symbol", "severity", _r("score"))

    run.__name__ = f"detect_{name}"
    return query(run)


for _name in BUILT_IN:
    _detector_query(_name)


@query
def all_alerts(spark, sf_dir):
    rows, _ = candidate_alerts(lineitem_tape(spark, sf_dir), COLUMN_RULES)
    return rows.select("trade_id", "symbol", "detector", "severity", _r("score"))


def _written_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape, joined with its orders once: the engine reads it several times."""
    return checkpointed(lineitem_tape(spark, sf_dir))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_engine(lineitem_tape(spark, sf_dir), COLUMN_RULES)


@query
def cooldown_alerts(spark, sf_dir):
    out = _alerts(spark, sf_dir)
    return out.select("trade_id", "symbol", "detector", "event_us", "severity", _r("score"))


@query
def alert_order(spark, sf_dir):
    """Alert detectors per trade in the order a consumer gets them."""
    from ..operators.detectors import alert_array, enabled_detectors

    rules = Rules()
    chosen = enabled_detectors(rules)
    windows = engine_windows(lineitem_tape(spark, sf_dir), rules)
    flagged, _ = alert_array(windows, rules, chosen)
    ordered = order_alerts(F.col("alerts"))
    names = F.array_join(F.transform(ordered, lambda a: a["detector"]), ">")
    return flagged.filter(F.size("alerts") > 0).select("trade_id", names.alias("detectors"))


@query
def trade_decisions(spark, sf_dir):
    # ordered by rank and score; nobody asks for the texts, which the cooldown would carry along
    tape = _written_tape(spark, sf_dir)
    out = decisions(tape, run_engine(tape, COLUMN_RULES, columns=("rank", "position", "severity", "score")))
    top = F.get("alerts", F.lit(0))
    return out.select(
        "trade_id", "anomalous", F.size("alerts").cast("long").alias("alerts"),
        top["detector"].alias("first_detector"), top["severity"].alias("first_severity"),
    )


@query
def engine_totals(spark, sf_dir):
    return engine_stats(lineitem_tape(spark, sf_dir), COLUMN_RULES)


def _lot_share(rules: Rules) -> Verdict:
    """Divides by zero on blocks of 4,000 and its multiples."""
    share = F.col("price") / (F.col("quantity") % 4000)
    return Verdict(share > 0.5, F.lit("low"), F.lit(0.1), F.lit("odd lot"), {"share": share})


def _first_lots(rows: pd.DataFrame) -> pd.DataFrame:
    """Raises if any of its trades is a block of 20,000."""
    if (rows["quantity"] == 20_000.0).any():
        raise ValueError("a block")
    return pd.DataFrame({"fires": rows["quantity"] > 900, "severity": "low", "score": 0.1, "reason": "a lot", "details": "{}"})


@query
def engine_errors(spark, sf_dir):
    """Two detectors that fail on some trades: the others are judged, and the failures counted."""
    extra = [Detector("lot_share", _lot_share), PandasDetector("first_lots", _first_lots, ("quantity",))]
    stats = engine_stats(_written_tape(spark, sf_dir), COLUMN_RULES, extra)
    return stats.filter("metric = 'detector_errors' or (metric = 'by_detector' and key not in ('lot_share', 'first_lots'))")


# ------------------------------------------------------------- analytics


def _event_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = B.batch_flags(B.batch_features(event_tape(spark, sf_dir)), price_z=2.5)
    return flagged.filter("anomalous").withColumn("dt", event_day())


@query
def daily_detector_counts(spark, sf_dir):
    return A.daily_counts(_event_anomalies(spark, sf_dir))


@query
def daily_severity(spark, sf_dir):
    return A.daily_severity(_event_anomalies(spark, sf_dir))


@query
def top_critical_symbols(spark, sf_dir):
    flagged = _batch_flagged(spark, sf_dir).filter("anomalous").withColumn("dt", event_day())
    return A.top_critical(flagged, "2025-01-01")


@query
def symbol_summary(spark, sf_dir):
    tape = priced_tape(spark, sf_dir)
    return A.symbol_summary(tape, B.batch_flags(B.batch_features(tape)).filter("anomalous"))


@query
def sparkline(spark, sf_dir):
    out = A.sparkline(priced_tape(spark, sf_dir))
    total = F.aggregate("spark", F.lit(0.0), lambda acc, x: acc + x)
    return out.select(
        "symbol", F.size("spark").cast("long").alias("points"), F.get("spark", F.lit(0)).alias("oldest"),
        F.get("spark", F.size("spark") - 1).alias("newest"), F.round(total, 3).alias("total"),
    )


@query
def per_second_series(spark, sf_dir):
    tape = lineitem_tape(spark, sf_dir)
    return A.time_series(tape, _batch_flagged(spark, sf_dir).filter("anomalous"), 300)


@query
def zero_filled_series(spark, sf_dir):
    """The sparse tape, where most seconds of the window are empty."""
    tape = event_tape(spark, sf_dir)
    return A.time_series(tape, tape.filter(F.col("price") > 20), 300)


@query
def elapsed_rates(spark, sf_dir):
    tape = lineitem_tape(spark, sf_dir)
    return A.rates(tape, _batch_flagged(spark, sf_dir).filter("anomalous"))


@query
def kpis(spark, sf_dir):
    tape = lineitem_tape(spark, sf_dir)
    return A.kpis(tape, _batch_flagged(spark, sf_dir).filter("anomalous"))


def _reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_values(lineitem_tape(spark, sf_dir), "quantity", ("event_us", "trade_id"))


@query
def nearest_rank_percentiles(spark, sf_dir):
    return A.nearest_rank_stats(_reservoir(spark, sf_dir), rows_per_task=None)


@query
def whole_column_percentiles(spark, sf_dir):
    prices = lineitem_tape(spark, sf_dir).select(F.col("price").alias("value"))
    return A.nearest_rank_stats(prices, rows_per_task=1_000_000)


@query
def fixed_histogram(spark, sf_dir):
    out = A.fixed_histogram(_reservoir(spark, sf_dir))
    return out.select(F.col("bucket").cast("long"), "lo", "hi", "count")


@query
def latest_tape(spark, sf_dir):
    tape = priced_tape(spark, sf_dir)
    out = A.latest_tape(tape, B.batch_flags(B.batch_features(tape)).filter("anomalous"))
    return out.select("trade_id", "symbol", _r("price"), "quantity", "side", "notional", "anomalous", "event_us")


@query
def recent_alerts(spark, sf_dir):
    out = A.recent_alerts(_alerts(spark, sf_dir))
    return out.select("trade_id", "symbol", "detector", "severity", "event_us")


@query
def per_minute_rates(spark, sf_dir):
    tape = lineitem_tape(spark, sf_dir)
    return A.per_minute(tape, _batch_flagged(spark, sf_dir).filter("anomalous"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_tape(spark, sf_dir).select(
        F.col("account_id").alias("client"), "event_us", F.col("trade_id").alias("hit_id")
    )


@query
def admission_control(spark, sf_dir):
    out = admission(_hits(spark, sf_dir), per_minute=100)
    return out.groupBy("client").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if("accepted").alias("accepted"),
        F.sum(F.when(F.col("accepted"), F.col("event_us") % 1_000_003)).alias("check"),
    )


@query
def audit_rollup(spark, sf_dir):
    checked = _guarded(spark, sf_dir)
    audit = checked.select(
        F.when(F.col("ok"), "trade_ingested").otherwise("trade_rejected").alias("action"),
        F.when(F.col("ok"), "ok").otherwise("rejected").alias("outcome"),
        F.col("account_id").alias("client"),
        F.coalesce("code", F.lit("none")).alias("code"),
    )
    out = A.audit_rollup(audit)
    filled = [F.coalesce(c, F.lit("*")).alias(c) for c in ("action", "outcome", "client", "code")]
    return out.select(*filled, F.col("level").cast("long"), "n")


@query
def job_freshness(spark, sf_dir):
    """Batch cycles stand in from the event stream: one run per event, judged half an hour after the last."""
    events = table(spark, sf_dir, "events")
    runs = events.select(F.floor(wall_micros("ts") / F.lit(1_000_000)).alias("epoch"))
    out = run_freshness(runs, F.col("last_epoch") + 1800)
    return out.select("last_epoch", "runs", "status")


@query
def quality_gate_checks(spark, sf_dir):
    return quality_checks(_batch_flagged(spark, sf_dir).filter("anomalous"))


# ------------------------------------------------------------- evaluation


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stream_runs(_batch_flagged(spark, sf_dir).select("event_us", "trade_id", "label", F.col("anomalous").alias("flagged")))


@query
def label_episodes(spark, sf_dir):
    out = G.episodes(_runs(spark, sf_dir))
    return out.groupBy("label", "detected", "rows").agg(F.count(F.lit(1)).alias("episodes"))


@query
def event_metrics(spark, sf_dir):
    out = G.event_metrics(_runs(spark, sf_dir))
    ratios = ("precision", "recall", "false_positive_rate", "f1")
    return out.select(*[c for c in out.columns if c not in ratios], *[_r(c) for c in ratios])


@query
def false_alarm_episodes(spark, sf_dir):
    runs = _runs(spark, sf_dir).filter(F.col("label").isNull() & F.col("flagged"))
    return runs.groupBy("rows").agg(F.count(F.lit(1)).alias("episodes"))


@query
def label_recall(spark, sf_dir):
    return G.label_recall(_runs(spark, sf_dir))


def _sweep_rulesets() -> dict[str, Rules]:
    base = Rules().replace(price_spike={"enabled": False}, wash_trade={"enabled": False}, spoofing={"enabled": False})
    return {
        "shipped": base,
        "strict": base.replace(zscore={"price_threshold": 4.0}, velocity={"max_trades": 40}),
        "loose": base.replace(zscore={"price_threshold": 2.0}, volume_spike={"median_multiplier": 3.0}),
    }


@query
def ruleset_sweep(spark, sf_dir):
    windows = engine_windows(priced_tape(spark, sf_dir, "label"), statistics=("price_mean", "price_std", "volume_median"))
    out = G.ruleset_sweep(windows, _sweep_rulesets())
    return out.select("ruleset", "total_events", "detected_events", "false_alarm_episodes", _r("f1"))


@query
def ruleset_sweep_with_cooldown(spark, sf_dir):
    """Rulesets judged on the alerts that survive the cooldown."""
    windows = engine_windows(priced_tape(spark, sf_dir, "label"), statistics=("price_mean", "price_std", "volume_median"))
    out = G.ruleset_sweep(windows, _sweep_rulesets(), cooldown_alerts=True)
    return out.select("ruleset", "total_events", "detected_events", "false_alarm_episodes", _r("f1"))


@query
def sweep_spread(spark, sf_dir):
    """Mean and spread of F1 over four stretches of the tape."""
    windows = engine_windows(priced_tape(spark, sf_dir, "label"), statistics=("price_mean", "price_std", "volume_median"))
    quarter = F.pmod(F.floor(F.split("trade_id", "-")[0].cast("long") / 4096), F.lit(4)).cast("string")
    out = G.sweep_spread(G.ruleset_sweep(windows, _sweep_rulesets(), tapes=quarter))
    return out.select("ruleset", _r("f1_mean"), _r("f1_std"), "runs")


@query
def scan_row_agreement(spark, sf_dir):
    """Which flagged rows the rolling and the whole-history scan share, symbol by symbol."""
    tape = priced_tape(spark, sf_dir)
    rolling = B.batch_flags(B.batch_features(tape.select("trade_id", "event_us", "symbol", "price", "quantity"))).filter("anomalous")
    return G.row_agreement(rolling, B.history_scan(tape))


@query
def alert_texts(spark, sf_dir):
    """Reasons and details of the engine's candidates."""
    rows, _ = candidate_alerts(lineitem_tape(spark, sf_dir), COLUMN_RULES)
    field = lambda name: F.get_json_object("details", f"$.{name}")
    number = lambda name: field(name).cast("double").alias(name)
    kept = rows.filter("detector in ('price_spike', 'velocity', 'spoofing', 'wash_trade')")
    return kept.select(
        "trade_id", "detector", F.when(F.col("detector").isin("velocity", "spoofing", "wash_trade"), F.col("reason")).alias("reason"),
        _r(F.round(number("previous_price"), 6)).alias("previous_price"), _r(number("pct_change"), 5).alias("pct_change"),
        field("count").cast("long").alias("count"), field("dominant_side").alias("dominant_side"),
        field("buys").cast("long").alias("buys"), field("sells").cast("long").alias("sells"),
        field("signal").alias("signal"), field("matched_trade_id").alias("matched_trade_id"),
    )


@query
def isolation_samples(spark, sf_dir):
    """Which rows train which tree of the whole-history forest."""
    return tree_samples(lineitem_tape(spark, sf_dir).select("trade_id"), trees=12, sample=64, seed=7).select("tree", "trade_id")


@query
def scan_crosscheck(spark, sf_dir):
    tape = priced_tape(spark, sf_dir)
    rolling = B.batch_flags(B.batch_features(tape)).filter("anomalous")
    return G.scan_crosscheck(rolling, B.history_scan(tape))


# ------------------------------------------------------------- scoring


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_matrix(priced_tape(spark, sf_dir, "label"))


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic score with ties for the metric queries."""
    score = F.floor(F.col("quantity") / 1000.0 + F.when(F.col("price") > 130, 5).otherwise(0)) / F.lit(20.0)
    return priced_tape(spark, sf_dir, "label").select(
        F.col("label").isNotNull().cast("int").alias("y"),
        score.alias("score"),
        (score >= 0.25).cast("int").alias("predicted"),
        "price",
        "quantity",
    )


@query
def time_ordered_split(spark, sf_dir):
    train, test = time_split(_matrix(spark, sf_dir))
    part = lambda df, name: df.agg(
        F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"),
        F.min("event_us").alias("first_us"), F.max("event_us").alias("last_us"),
    )
    return part(train, "train").unionByName(part(test, "test"))


@query
def confusion_matrix(spark, sf_dir):
    return S.confusion(scored_rows(spark, sf_dir))


@query
def precision_recall_f1(spark, sf_dir):
    out = S.precision_recall_f1(S.confusion(scored_rows(spark, sf_dir)))
    return out.select(_r("precision"), _r("recall"), _r("f1"))


@query
def roc_auc(spark, sf_dir):
    return S.area_metrics(scored_rows(spark, sf_dir)).select(_r("roc_auc"))


@query
def average_precision(spark, sf_dir):
    return S.area_metrics(scored_rows(spark, sf_dir)).select(_r("pr_auc"))


@query
def curve_points(spark, sf_dir):
    out = S.curve_points(scored_rows(spark, sf_dir))
    return out.select(_r("threshold"), "tp", "fp", _r("tpr"), _r("fpr"), _r("precision"))


@query
def class_balance(spark, sf_dir):
    return S.class_balance(_matrix(spark, sf_dir)).select(F.col("y").cast("long"), "n")


@query
def class_histogram(spark, sf_dir):
    out = S.class_histogram(scored_rows(spark, sf_dir), "price")
    return out.select(F.col("y").cast("long"), F.col("bin").cast("long"), _r("lo"), "n", _r("density"))


@query
def feature_correlations(spark, sf_dir):
    out = S.correlations(_matrix(spark, sf_dir), FEATURES)
    return out.select("a", "b", _r("corr", 5))


@query
def class_report(spark, sf_dir):
    out = S.class_report(scored_rows(spark, sf_dir))
    return out.select("class", _r("precision"), _r("recall"), _r("f1"), "support")


@cache
def all_queries() -> dict[str, Query]:
    from . import jobs  # noqa: F401 - registers the model, stream and job queries

    return dict(QUERIES)


# ------------------------------------------------------------- groups cut by rank

#: Small enough that every larger symbol is cut into several chunks.
CUT_ROWS = 2_000


@query
def cut_price_statistics(spark, sf_dir):
    out = engine_windows(priced_tape(spark, sf_dir), statistics=("price_mean", "price_std"), rows_per_task=CUT_ROWS)
    return out.select("trade_id", _r("price_mean"), _r("price_std"))


@query
def cut_batch_features(spark, sf_dir):
    out = B.batch_features(priced_tape(spark, sf_dir), rows_per_task=CUT_ROWS)
    return out.select("trade_id", _r("price_mean"), _r("price_std"), _r("price_z", 5), _r("vol_ratio"), "velocity")


@query
def cut_model_features(spark, sf_dir):
    out = model_features(priced_tape(spark, sf_dir), rows_per_task=CUT_ROWS)
    return out.select("trade_id", *[_r(name, 5) for name in FEATURES])


@query
def cut_cooldown_alerts(spark, sf_dir):
    alerts = run_engine(lineitem_tape(spark, sf_dir), COLUMN_RULES, rows_per_task=CUT_ROWS)
    return alerts.select("trade_id", "symbol", "detector", "event_us", "severity", _r("score"))


# ------------------------------------------------------------- flat stretches


@query
def flat_price_statistics(spark, sf_dir):
    """Windows of one repeated price have exactly that mean and no deviation."""
    out = engine_windows(flat_tape(spark, sf_dir), statistics=("price_mean", "price_std"))
    return out.select("trade_id", _r("price_mean"), _r("price_std"), (F.col("price_std") > 0).alias("moves"))


# ------------------------------------------------------------- the engine against the labels


def _engine_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.engine_runs(lineitem_tape(spark, sf_dir), COLUMN_RULES)


@query
def engine_event_metrics(spark, sf_dir):
    out = G.event_metrics(_engine_runs(spark, sf_dir))
    ratios = ("precision", "recall", "false_positive_rate", "f1")
    return out.select(*[c for c in out.columns if c not in ratios], *[_r(c) for c in ratios])


@query
def engine_label_recall(spark, sf_dir):
    return G.label_recall(_engine_runs(spark, sf_dir))
