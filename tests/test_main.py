"""The submitted jobs from end to end, on files."""

import json

import pytest
from conftest import tape, trade
from pyspark.sql import functions as F

from tapewarden.__main__ import arguments, main
from tapewarden.schema import TRADE


@pytest.fixture
def history(spark, tmp_path):
    rows = [
        trade(k, 100.0 + (k % 3) * 0.1 + 30 * (k % 40 == 39), 100.0, "buy" if k % 2 else "sell", label="price_spike" if k % 40 == 39 else None, name=f"n{k:04d}")
        for k in range(400)
    ]
    df = tape(spark, rows).withColumn("timestamp", F.timestamp_micros("event_us"))
    df.select(*TRADE.fieldNames(), "label").coalesce(2).write.parquet(str(tmp_path / "trades"))
    return str(tmp_path / "trades")


def test_scans(spark, tmp_path, history, capsys):
    assert main(["flag", "--trades", history, "--out", str(tmp_path / "flags"), "--price-z", "4"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "flags")).count() > 5 and "scanned" in capsys.readouterr().out
    main(["history", "--trades", history, "--format", "parquet", "--out", str(tmp_path / "scan")], spark)
    lines = spark.read.csv(str(tmp_path / "scan"), sep="\t").collect()
    assert len(lines) == 10 and {r[1] for r in lines} == {"zscore"} and all(len(r) == 5 for r in lines)
    main(["nightly", "--trades", history, "--lake", str(tmp_path / "lake"), "--day", "2026-01-01"], spark)
    assert spark.read.parquet(str(tmp_path / "lake/gold")).count() > 5


def test_streams(spark, tmp_path, history):
    common = lambda name: ["--folder", history, "--out", str(tmp_path / name), "--checkpoint", str(tmp_path / f"{name}-cp"), "--once"]
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"isolation_forest": {"enabled": False}, "price_spike": {"pct_threshold": 0.2}}))
    main(["stream-alerts", *common("alerts"), "--rules", str(rules), "--lateness", "60", "--rejects", str(tmp_path / "late")], spark)
    alerts = spark.read.json(str(tmp_path / "alerts"))
    assert alerts.filter("detector = 'price_spike'").count() == 10 and "rejected" not in alerts.columns
    main(["stream-windows", *common("windows")], spark)
    assert spark.read.parquet(str(tmp_path / "windows")).count() > 0


def test_training(spark, tmp_path, history, capsys):
    main(["train", "--trades", history, "--out", str(tmp_path / "model"), "--boosted-trees", "5", "--isolation-trees", "10"], spark)
    assert "champion:" in capsys.readouterr().out
    main(["score", "--trades", history, "--model", str(tmp_path / "model"), "--out", str(tmp_path / "scores")], spark)
    assert spark.read.parquet(str(tmp_path / "scores")).filter("predicted = 1").count() > 0
    card = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "model/card")).collect())
    assert "2026-01-01 15:00:00 to 2026-01-01 15:04:39" in card and "## Not seen" in card


def test_arguments_are_checked():
    for bad in (["flag", "--trades", "x"], ["stream-alerts", "--out", "x", "--checkpoint", "y"], ["nothing"]):
        with pytest.raises(SystemExit):
            arguments().parse_args(bad)
