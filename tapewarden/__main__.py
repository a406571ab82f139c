"""The jobs for ``spark-submit`` (or ``python -m tapewarden``): ``spark-submit tapewarden/__main__.py flag --trades … --out …``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

if __package__ in (None, ""):  # run as a file
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from tapewarden import Rules, load_rules  # noqa: E402
from tapewarden.plans.backtest import backtest, history_scan_job, nightly  # noqa: E402
from tapewarden.plans.training import score_history, train  # noqa: E402
from tapewarden.session import ship_package  # noqa: E402
from tapewarden.sources.scans import stream_messages, replay_trades, scan_trades  # noqa: E402
from tapewarden.sources.tape import normalise  # noqa: E402
from tapewarden.streaming.engine import decoded_stream, fan_out_batches, stream_engine, use_rocksdb  # noqa: E402
from tapewarden.streaming.windows import stream_trades, stream_window_flags, upsert_updates  # noqa: E402


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tapewarden", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, text: str, *needed: str) -> argparse.ArgumentParser:
        one = jobs.add_parser(name, help=text)
        for option in needed:
            one.add_argument(f"--{option}", required=True)
        return one

    one = job("flag", "rolling scan of a history, anomalies by day", "trades", "out")
    one.add_argument("--format", default="parquet", choices=("parquet", "json"))
    one.add_argument("--table-format", default="parquet")
    one.add_argument("--lookback", type=int, default=100)
    one.add_argument("--price-z", type=float, default=3.0)
    one.add_argument("--vol-ratio", type=float, default=6.0)
    one.add_argument("--velocity", type=int, default=25)
    one = job("history", "whole-history scan to a tab-separated file", "trades", "out")
    one.add_argument("--format", default="json", choices=("parquet", "json"))
    one.add_argument("--price-z", type=float, default=3.0)
    one.add_argument("--vol-ratio", type=float, default=6.0)
    one.add_argument("--min-trades", type=int, default=20)
    one = job("nightly", "one day of the lake, gate included", "trades", "lake", "day")
    one.add_argument("--format", default="parquet", choices=("parquet", "json"))
    for name, text in (("stream-windows", "sliding-window verdicts of a stream"), ("stream-alerts", "the engine over a stream")):
        one = job(name, text, "out", "checkpoint")
        where = one.add_mutually_exclusive_group(required=True)
        where.add_argument("--folder", help="Parquet files of trades")
        where.add_argument("--brokers", help="Kafka bootstrap servers; needs the connector and --topic")
        one.add_argument("--topic")
        one.add_argument("--once", action="store_true", help="stop when everything there is has been read")
    one.add_argument("--rules", help="YAML or JSON ruleset")
    one.add_argument("--lateness", type=float, help="seconds behind the newest trade after which a trade is rejected")
    one.add_argument("--idle", type=float, default=3600.0, help="seconds after which an idle symbol is forgotten")
    one.add_argument("--rejects", help="folder for rejected trades")
    one = job("train", "fit both models on a labelled history", "trades", "out")
    one.add_argument("--test-fraction", type=float, default=0.3)
    one.add_argument("--boosted-trees", type=int, default=100)
    one.add_argument("--isolation-trees", type=int, default=200)
    job("score", "score a history with a stored champion", "trades", "model", "out")
    return parser


def _messages_or_trades(spark: SparkSession, args: argparse.Namespace):
    if args.folder:
        return replay_trades(spark, args.folder)
    if not args.topic:
        raise SystemExit("--brokers needs --topic")
    return stream_messages(spark, args.brokers, args.topic)


def _run_stream(writer, once: bool) -> None:
    query = (writer.trigger(availableNow=True) if once else writer).start()
    query.awaitTermination()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"tapewarden {args.job}").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    if args.job == "flag":
        report = backtest(spark, args.trades, args.out, args.format, args.lookback, args.price_z, args.vol_ratio, args.velocity, args.table_format)
        for part in (report.summary, report.by_detector, report.first):
            part.show(truncate=False)
    elif args.job == "history":
        thresholds = {"price_z": args.price_z, "vol_ratio": args.vol_ratio, "min_trades": args.min_trades}
        history_scan_job(spark, args.trades, args.out, args.format, **thresholds)
    elif args.job == "nightly":
        nightly(spark, args.trades, args.lake, args.day, args.format).show(truncate=False)
    elif args.job == "stream-windows":
        use_rocksdb(spark)
        source = _messages_or_trades(spark, args)
        trades = source.withWatermark("timestamp", "1 minute") if args.folder else stream_trades(source)
        _run_stream(upsert_updates(stream_window_flags(trades), args.out, args.checkpoint), args.once)
    elif args.job == "stream-alerts":
        use_rocksdb(spark)
        source = _messages_or_trades(spark, args)
        trades = normalise(source) if args.folder else decoded_stream(source)
        rules = load_rules(args.rules) if args.rules else Rules()
        alerts = stream_engine(trades, rules, lateness_seconds=args.lateness, idle_seconds=args.idle)
        _run_stream(fan_out_batches(alerts, args.out, args.checkpoint, rejects=args.rejects), args.once)
    elif args.job == "train":
        history = spark.read.parquet(args.trades)
        tape = normalise(scan_trades(spark, args.trades)).join(history.select("trade_id", "label"), "trade_id")
        result = train(spark, tape, args.out, args.test_fraction, boosted_trees=args.boosted_trees, isolation_trees=args.isolation_trees)
        print(f"champion: {result['champion']}")
    elif args.job == "score":
        score_history(spark, normalise(scan_trades(spark, args.trades)), args.model).write.mode("overwrite").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
