import itertools
import math
import random

import pytest
from conftest import tape, trade
from pyspark.sql import functions as F

from tapewarden.operators.evaluation import event_metrics, label_recall, row_agreement, ruleset_sweep, stream_runs, sweep_spread
from tapewarden.operators.learning import exact_quantile, tree_samples
from tapewarden.operators.features import FEATURES
from tapewarden.operators.learning import labelled_matrix, permutation_importance, time_split
from tapewarden.operators.rolling import engine_windows
from tapewarden.operators.scoring import area_metrics, class_histogram, confusion, curve_points, precision_recall_f1
from tapewarden.rules import Rules


def expected_metrics(records):
    """Group consecutive records; the plain reading of the definition."""
    events = hits = alarms = 0
    for (label, state), run in itertools.groupby(records, lambda r: (r[0], None if r[0] else r[1])):
        flagged = any(f for _, f in run)
        if label:
            events, hits = events + 1, hits + flagged
        else:
            alarms += bool(state)
    return events, hits, alarms


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_in_one_chunk_and_in_many(spark, seed):
    rng = random.Random(seed)
    records = [(rng.choice([None, None, None, "a", "b"]), rng.random() < 0.3) for _ in range(400)]
    rows = [(i, f"t{i:05d}", label, flagged) for i, (label, flagged) in enumerate(records)]
    df = spark.createDataFrame(rows, "event_us long, trade_id string, label string, flagged boolean")
    for limit in (10_000, 30):
        row = event_metrics(stream_runs(df, rows_per_task=limit)).first()
        got = (row["total_events"], row["detected_events"], row["false_alarm_episodes"])
        assert got == expected_metrics(records)
        assert row["total_trades"] == 400


def test_adjacent_episodes_of_one_label_merge_and_empty_input_is_zero(spark):
    rows = [(0, "a", "x", False), (1, "b", "x", True), (2, "c", None, True), (3, "d", "x", False)]
    df = spark.createDataFrame(rows, "event_us long, trade_id string, label string, flagged boolean")
    assert [tuple(r) for r in label_recall(stream_runs(df)).collect()] == [("x", 1, 2)]
    row = event_metrics(stream_runs(df.limit(0))).first()
    assert (row["total_trades"], row["precision"], row["f1"]) == (0, 0.0, 0.0)


def test_ruleset_sweep(spark):
    rows = [trade(i * 2, 100.0 + (i % 2) * 0.5, side="buy" if i % 2 else "sell") for i in range(40)]
    rows += [trade(90, 110.0, label="price_spike"), trade(92, 100.0)]
    sweep = ruleset_sweep(engine_windows(tape(spark, rows)), {"on": Rules(), "off": Rules().replace(price_spike={"enabled": False}, zscore={"enabled": False})})
    got = {r["ruleset"]: r["detected_events"] for r in sweep.collect()}
    assert got == {"on": 1, "off": 0}
    assert {r["runs"] for r in sweep_spread(sweep).collect()} == {1}


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, score double, predicted int")


def test_areas_with_ties(spark):
    rows = [(1, 0.9, 1), (0, 0.9, 1), (1, 0.5, 1), (0, 0.1, 0)]
    pairs = [(p[1] > n[1]) + 0.5 * (p[1] == n[1]) for p in rows if p[0] for n in rows if not n[0]]
    for limit in (1000, 1):
        row = area_metrics(scored(spark, rows), limit).first()
        assert row["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
        assert row["pr_auc"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    single = area_metrics(scored(spark, [(0, 0.3, 0)])).first()
    assert (single["roc_auc"], single["pr_auc"]) == (0.0, 0.0)
    assert curve_points(scored(spark, rows)).count() == 3


def test_confusion_and_empty_ratios(spark):
    assert tuple(confusion(scored(spark, [(1, 0.1, 0), (0, 0.1, 1), (1, 0.1, 1)])).first()) == (0, 1, 1, 1)
    row = precision_recall_f1(confusion(scored(spark, [(0, 0.1, 0)]))).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_histogram_density_integrates_to_one(spark):
    df = spark.range(100).selectExpr("cast(id % 2 as int) as y", "cast(id as double) as v")
    bins = class_histogram(df, "v", 10).filter("y = 0")
    assert bins.count() == 10
    assert bins.agg(F.sum("n")).first()[0] == 50


def test_split_and_importance_point_at_the_used_feature(spark):
    rows = [trade(i, 100.0 + (i % 7), 100.0, label="x" if i % 5 == 0 else None) for i in range(200)]
    train, test = time_split(labelled_matrix(tape(spark, rows)))
    assert (train.count(), test.count()) == (140, 60)
    assert train.agg(F.max("event_us")).first()[0] < test.agg(F.min("event_us")).first()[0]
    rule = lambda df: df.withColumn("predicted", (F.col("notional_log") > 9.24).cast("int"))
    labelled = rule(test).withColumn("y", F.col("predicted")).drop("predicted")
    top = permutation_importance(labelled, rule, repeats=3).collect()
    assert {r["feature"] for r in top} == set(FEATURES)
    assert top[0]["feature"] == "notional_log"
    assert top[0]["importance"] > 0
    assert all(r["importance"] == 0 for r in top[1:])


def test_rows_of_two_scans_match_one_to_one(spark):
    """Equal rows count as often as both scans have them."""
    ddl = "symbol string, price double, quantity double, detector string"
    left = spark.createDataFrame([("A", 1.0, 1.0, "x")] * 3 + [("A", 2.0, 1.0, "x"), ("B", 1.0, 1.0, "x"), ("B", None, 1.0, "x")], ddl)
    right = spark.createDataFrame([("A", 1.0, 1.0, "y")] * 2 + [("A", 3.0, 1.0, "y"), ("C", 1.0, 1.0, "x"), ("B", None, 1.0, "x")], ddl)
    got = {tuple(r) for r in row_agreement(left, right).collect()}
    assert got == {("A", 2, 2, 1), ("B", 1, 1, 0), ("C", 0, 0, 1)}
    k = ["symbol", "price", "quantity"]
    assert left.select(k).intersectAll(right.select(k)).count() == sum(r[1] for r in got)
    assert left.select(k).exceptAll(right.select(k)).count() == sum(r[2] for r in got)


def test_forest_sample_is_the_same_draw_at_every_size(spark):
    """Bottom keys per tree: a tree's sample from a part it draws from alone is its sample from the whole."""
    ids = spark.range(3000).selectExpr("cast(id as string) as trade_id")
    whole = {(r.tree, r.trade_id) for r in tree_samples(ids, 5, 16, 3).collect()}
    assert len(whole) == 80
    some = ids.filter(F.col("trade_id").isin([t for _, t in whole]))
    assert {(r.tree, r.trade_id) for r in tree_samples(some, 5, 16, 3).collect()} == whole
    few = {(r.tree, r.trade_id) for r in tree_samples(ids.limit(9), 4, 16, 3).collect()}
    assert len(few) == 36


def test_exact_quantile(spark):
    rng = random.Random(4)
    values = [rng.choice([1.0, 2.5, rng.gauss(0, 1)]) for _ in range(997)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for share in (0.0, 0.02, 0.5, 0.98, 1.0):
        want = sorted(values)[max(1, math.ceil(share * 997 - 1e-9)) - 1]
        assert exact_quantile(frame, "v", share) == exact_quantile(frame, "v", share, rows_per_task=50) == want
    assert math.isnan(exact_quantile(frame.limit(0), "v", 0.5))
