"""What grows with the tape: rows kept between steps, models' work, what a task holds."""

import contextlib
import io

import numpy as np
from conftest import tape, trade
from pyspark.sql import functions as F

from tapewarden import Rules
from tapewarden.functions.forest import average_path, fit
from tapewarden.operators import batch_flags as B
from tapewarden.operators import evaluation as G
from tapewarden.operators.cooldown import mark_cooldown
from tapewarden.operators.isolation import isolation_scores
from tapewarden.operators.learning import time_split
from tapewarden.operators.rolling import engine_windows
from tapewarden.operators.scoring import model_metrics
from tapewarden.operators.split import checkpointed


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_velocity_over_blocks(spark):
    """Windows across the edges of blocks; no copy of a count for each second that it reaches."""
    edge = B.BLOCK_SECONDS
    at = [0, 1, 1, edge - 5, edge - 1, edge - 1, edge, edge + 4, edge + 5, 3 * edge, -1, -edge, None]
    rows = [(f"t{i}", "A" if i % 3 else "B", None if s is None else s * 1_000_000) for i, s in enumerate(at)]
    out = B.batch_velocity(spark.createDataFrame(rows, "trade_id string, symbol string, event_us long"))
    assert "sequence" not in plan(out) and "Window" in plan(out)
    expected = set()
    for _, symbol, us in rows:
        if us is not None:
            s = us // 1_000_000
            expected.add((symbol, s, sum(y == symbol and u is not None and s - 5 <= u // 1_000_000 <= s for _, y, u in rows)))
    found = [tuple(r) for r in out.collect()]
    assert sorted(r for r in found if r[1] is not None) == sorted(expected)
    assert [r[2] for r in found if r[1] is None] == [6]


def test_trades_meet_before_they_are_in_windows(spark):
    trades = [trade(offset=i * 0.7, price=100.0 + i % 9, symbol="AB"[i % 2]) for i in range(3000)]
    rows = tape(spark, trades).withColumn("timestamp", F.timestamp_micros("event_us")).repartition(8)
    out = B.window_baselines(rows)
    text = plan(out)
    below = text[text.index("Expand") :] if "Expand" in text else text[text.index("Generate") :]
    assert "Exchange hashpartitioning(symbol" in below
    by_hand = rows.groupBy(F.window("timestamp", "30 seconds", "5 seconds"), "symbol").agg(F.count("*").alias("n"), F.max("price").alias("top"))
    same = out.join(by_hand, ["window", "symbol"]).filter("trade_count = n and price_max = top").count()
    assert same == out.count() == by_hand.count()


def sweep_tape(spark):
    trades = [trade(offset=i * 0.05 if i % 700 < 300 else i * 0.4, price=100.0 + (8 if i % 97 == 0 else 0) + i % 3, quantity=2000.0 if i % 131 == 0 else 100.0,
                    label="price_spike" if i % 97 == 0 else None) for i in range(1500)]
    return tape(spark, trades)


def test_sweep_keeps_a_trade_once(spark, monkeypatch):
    rows = sweep_tape(spark)
    base = Rules().replace(price_spike={"enabled": False}, wash_trade={"enabled": False}, spoofing={"enabled": False})
    sets = {"a": base, "b": base.replace(zscore={"price_threshold": 2.0}), "c": base.replace(velocity={"enabled": False})}
    windows = engine_windows(rows, statistics=("price_mean", "price_std", "volume_median"))
    for cooled in (False, True):
        kept = []
        with monkeypatch.context() as patched:
            patched.setattr(G, "checkpointed", lambda df: (kept.append(out := checkpointed(df)), out)[1])
            together = {r["ruleset"]: r.asDict() for r in G.ruleset_sweep(windows, sets, 250, cooled).collect()}
            assert max(k.count() for k in kept if "event_us" in k.columns) == rows.count()
        for name, rules in sets.items():
            alone = G.ruleset_sweep(windows, {name: rules}, 10_000, cooled).first().asDict()
            assert together[name] == alone
        assert len({(r["detected_events"], r["false_alarm_episodes"]) for r in together.values()}) > 1


def test_checkpoints_are_columns(spark):
    assert all(f.endswith(".parquet") for f in checkpointed(sweep_tape(spark)).inputFiles())
    untyped = spark.range(3).withColumn("nothing", F.lit(None))
    assert checkpointed(untyped).count() == 3


def test_a_model_scores_a_row_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        calls.add(1)
        return float(i % 7)

    rows = spark.range(200).select((F.col("id") % 2).cast("int").alias("y"), score("id").alias("score"))
    out = model_metrics(rows.withColumn("predicted", (F.col("score") > 3).cast("int")), "m")
    assert out.first()["tp"] + out.first()["fn"] == 100
    assert calls.value == 200


def test_features_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(i):
        calls.add(1)
        return float(i)

    rows = spark.range(1000).select(F.col("id").alias("event_us"), F.col("id").cast("string").alias("trade_id"), feature("id").alias("f"))
    train, test = time_split(rows, 0.3, rows_per_task=100)
    assert (train.count(), test.count(), train.agg(F.max("f")).first()[0]) == (700, 300, 699.0)
    assert calls.value == 1000


def test_forest_paths(spark):
    """Scores against a walk from the root, row by row; leaves at all depths, equal and missing values."""
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(size=(90, 3)), 1)
    rows[:, 2] = 4.0
    rows[::17, 0] = np.nan
    forest = fit(rows, 30, rng, sample=64)
    asked = np.concatenate([rows, [[np.inf, -np.inf, 0.0], [9.0, 9.0, 9.0]]])
    for line, got in zip(asked, forest.score(asked), strict=True):
        total = 0.0
        for feature, cut, depth in zip(forest.feature, forest.cut, forest.depth, strict=True):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + int(line[feature[node]] > cut[node])
            total += depth[node]
        assert abs(got - 2.0 ** (-(total / 30) / float(average_path(64)))) < 1e-12


def test_alerts_stay_in_arrow(spark):
    rows = spark.createDataFrame([("A", "z", i * 1_000_000, f"t{i}", "text") for i in range(30)], "symbol string, detector string, event_us long, trade_id string, reason string")
    for cut in (7, 1000):
        out = mark_cooldown(rows, 8.0, rows_per_task=cut)
        assert "FlatMapGroupsInArrow" in plan(out)
        assert sorted(r["event_us"] // 1_000_000 for r in out.filter("emitted").collect()) == [0, 8, 16, 24]
    trades = tape(spark, [trade(offset=i, price=100.0 + i % 7) for i in range(40)])
    assert "FlatMapGroupsInArrow" in plan(isolation_scores(trades))


def test_a_trade_is_judged_once(spark):
    """Spark filters by the size of an array that it unfolds, and so computes the array once more."""
    from tapewarden.operators.alerts import candidate_alerts, run_engine

    rows = tape(spark, [trade(offset=i * 0.05, price=100.0 + i % 3) for i in range(60)])
    found, _ = candidate_alerts(rows, isolation=False)
    assert plan(found).count("one-sided burst") == 1
    assert found.filter("detector is null").count() == 0 < found.count()
    slim, whole = run_engine(rows, isolation=False, columns=()), run_engine(rows, isolation=False)
    assert "reason" not in slim.columns
    assert sorted(slim.select("alert_id").collect()) == sorted(whole.select("alert_id").collect())


def rows_of_tasks(df):
    return sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_tasks_follow_the_rows_of_a_cut_tape(spark, monkeypatch):
    """What a task sorts is bounded by rows, not by the session's number of partitions."""
    from tapewarden.operators import split as S

    monkeypatch.setattr(S, "ROWS_PER_SORT", 100)
    monkeypatch.setattr(S, "ROWS_PER_TASK", 200)
    laid = []
    monkeypatch.setattr(S, "checkpointed", lambda df: (laid.append(df), checkpointed(df))[1])
    rows = spark.range(12_000).selectExpr("cast(id % 4 = 0 as string) as symbol", "id")
    cut, group, was_cut, _ = S.split_by_rank(rows, ["symbol"], ["id"], halo=20, rows_per_task=200)
    assert was_cut and cut.filter("not _halo").count() == 12_000
    assert laid[0].rdd.getNumPartitions() == 120
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        assert max(rows_of_tasks(cut)) <= 5 * 220
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_velocity_inside_a_chunk_needs_no_join_of_all_seconds(spark, monkeypatch):
    """Only seconds at the edges of chunks are counted apart, also where a burst fills whole chunks."""
    trades = [trade(offset=i * 0.11, symbol="HOT") for i in range(2000)] + [trade(offset=50 + i * 0.001, symbol="HOT") for i in range(900)]
    trades += [trade(offset=i * 1.7, symbol="COLD") for i in range(100)]
    rows = tape(spark, trades)
    counted = []
    velocity = B.batch_velocity
    monkeypatch.setattr(B, "batch_velocity", lambda df, seconds: (counted.append(df.count()), velocity(df, seconds))[1])
    whole = {r["trade_id"]: r["velocity"] for r in B.batch_features(rows).collect()}
    assert counted == []
    for cut in (250, 700):
        found = {r["trade_id"]: r["velocity"] for r in B.batch_features(rows, rows_per_task=cut).collect()}
        assert found == whole
    assert counted[1] < 0.9 * len(trades)


def test_texts_that_nobody_reads_are_not_built(spark, monkeypatch):
    from tapewarden.operators import alerts as E

    rows = tape(spark, [trade(offset=i * 0.05, price=100.0 + (9 if i % 50 == 49 else i % 3)) for i in range(200)])
    plans = []
    monkeypatch.setattr(E, "checkpointed", lambda df: (plans.append(plan(df)), checkpointed(df))[1])
    totals = {(r["metric"], r["key"]): r["value"] for r in E.engine_stats(rows, isolation=False).collect()}
    assert plans and not any("one-sided burst" in p for p in plans)
    monkeypatch.setattr(E, "cooldown", lambda df, *more: (plans.append(plan(df)), mark_cooldown(df, *more).filter("emitted").drop("emitted", "candidates"))[1])
    slim = E.run_engine(rows, isolation=False, columns=("rank", "position", "severity", "score"))
    assert "one-sided burst" not in plans[-1]
    whole = E.run_engine(rows, isolation=False)
    assert "one-sided burst" in plans[-1]
    assert totals["alerts_raised", ""] == slim.count() == whole.filter("reason is not null and details is not null").count() > 0
    # decisions order alerts without their texts just the same
    short = lambda df: sorted((r["trade_id"], r["anomalous"], [(a["detector"], a["severity"], a["score"]) for a in r["alerts"]]) for r in E.decisions(rows, df).collect())
    assert short(slim) == short(whole)


def test_failing_rows_are_found_without_joining_frames_on_the_way():
    import warnings

    import pandas as pd

    from tapewarden.operators.detectors import judge_rows

    def inspect(rows):
        if (rows["q"] % 37 == 5).any():
            raise ValueError
        return pd.DataFrame({"fires": rows["q"] > 50, "severity": "low", "score": rows["q"] / 100, "reason": None, "details": "{}"})

    rows = pd.DataFrame({"q": range(100)})
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        out = judge_rows(inspect, rows)
    bad = [i % 37 == 5 for i in range(100)]
    assert list(out["failed"]) == bad
    assert [None if b else bool(f) for f, b in zip(out["fires"], bad, strict=True)] == [None if b else i > 50 for i, b in enumerate(bad)]
    assert all(pd.isna(s) if b else s == i / 100 for i, (s, b) in enumerate(zip(out["score"], bad, strict=True)))
    assert set(out["severity"]) == {"low", None}
    assert judge_rows(inspect, rows.iloc[:5])["fires"].dtype == bool and len(judge_rows(inspect, rows.iloc[:0])) == 0


def test_a_ranked_tape_is_read_in_bounded_files(spark, monkeypatch):
    """What a task reads to deal out a ranked tape is held until it is dealt: files, which scans pack together, are short."""
    from tapewarden.operators import split

    monkeypatch.setattr(split, "ROWS_PER_FILE", 100)
    rows = spark.range(5_000).select(F.lit("A").alias("symbol"), F.col("id").alias("event_us"))
    laid = []
    monkeypatch.setattr(split, "checkpointed", lambda df: (laid.append(out := checkpointed(df)), out)[1])
    assert split.rank_within(rows, ["symbol"], ["event_us"], rows_per_task=1_000).filter("_pos = event_us").count() == 5_000
    files = laid[0].groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 50 and max(r["count"] for r in files) <= 100


def test_leaves_by_masks(spark, monkeypatch):
    """Many rows are scored without walks, bit for bit alike; trees of more than 64 leaves, of none but the root, equal, missing and infinite values."""
    from tapewarden.functions import forest as M

    rng = np.random.default_rng(5)
    rows = np.round(rng.normal(size=(400, 4)), 1)
    rows[:, 3] = 4.0
    rows[::19, 0], rows[::23, 1], rows[::29, 2] = np.nan, np.inf, -np.inf
    clean = rows[np.isfinite(rows).all(axis=1)]
    for known in (clean, rows, rows[:1], np.tile(rows[:1], (9, 1))):
        forest = fit(known, 12, rng, sample=256)
        assert (forest.feature >= 0).sum(axis=1).max() > 64 or known is not clean
        asked = np.concatenate([rows, forest.cut[:, 0][:, None] + np.zeros((12, 4))])
        walked = forest.score(asked)
        with monkeypatch.context() as patched:
            patched.setattr(M, "_MANY", 1)
            patched.setattr(M, "_BLOCK", 100)
            patched.setattr(M, "_CELLS", None)
            assert (forest.score(asked) == walked).all()
            donors = asked[rng.permutation(len(asked))]
            for column, found in enumerate(forest.swapped(asked, donors).T):
                mixed = asked.copy()
                mixed[:, column] = donors[:, column]
                assert (forest.score(mixed) == found).all()


def test_importance_reads_a_pair_once(spark):
    """All features of a pair are judged together, as if each had a row of its own."""
    from tapewarden.functions.forest import grow
    from tapewarden.operators.features import FEATURES
    from tapewarden.operators.learning import permutation_importance, score_isolation, swapped_isolation

    rng = np.random.default_rng(6)
    values = rng.normal(size=(300, len(FEATURES)))
    rows = [(i, int(rng.random() < 0.3) if i % 50 else None, *map(float, v)) for i, v in enumerate(values)]
    test = spark.createDataFrame(rows, f"_pos long, y int, {', '.join(f'{f} double' for f in FEATURES)}")
    forest = grow(np.stack([values[rng.integers(0, 300, 64)] for _ in range(20)]), rng)
    edge, pairs = float(np.quantile(forest.score(values), 0.7)), []
    predict = lambda df: score_isolation(df, forest, edge)
    told = lambda df: (pairs.append(df.count()), swapped_isolation(df, forest, edge))[1]
    one = {r["feature"]: r["importance"] for r in permutation_importance(test, predict, 2).collect()}
    both = {r["feature"]: r["importance"] for r in permutation_importance(test, predict, 2, swapped=told).collect()}
    assert pairs == [600] and set(one) == set(FEATURES)
    assert {f: round(v, 12) for f, v in one.items()} == {f: round(v, 12) for f, v in both.items()}


def test_epochs_share_their_rows(spark, monkeypatch):
    """A row is sent to a block of epochs, and again only near its end; each epoch trains and scores the rows that it always had."""
    from tapewarden.operators import isolation as I

    train, every, sent = 30, 10, []
    rules = Rules().replace(isolation_forest={"train_size": train, "retrain_every": every}, window={"min_trades": 5})
    rows = tape(spark, [trade(offset=i * 0.9, price=100.0 + i * 37 % 11, symbol="COLD" if i % 9 == 0 else "HOT") for i in range(900)])
    blocks = I.epoch_blocks
    monkeypatch.setattr(I, "epoch_blocks", lambda *a: (sent.append(out := blocks(*a)), out)[1])
    whole = I.isolation_scores(rows, rules).collect()
    cut = I.isolation_scores(rows, rules, rows_per_task=250).collect()
    ready = 900 - 2 * 5
    assert ready <= sent[0].count() <= 1.1 * ready
    near = lambda found: sorted((r["trade_id"], r["epoch"], round(r["model_score"], 9)) for r in found)
    assert near(whole) == near(cut)
    for symbol in ("HOT", "COLD"):
        mine = sorted((r for r in whole if r["symbol"] == symbol), key=lambda r: (r["event_us"], r["trade_id"]))
        seen = sum((i % 9 == 0) == (symbol == "COLD") for i in range(900)) - 5
        assert [r["epoch"] for r in mine] == [i // every for i in range(seen - train + 1)]
        features = I.isolation_features(rows, rules).filter(F.col("symbol") == symbol).orderBy("event_us", "trade_id").collect()
        values = np.array([[r[c] for c in I.INPUTS] for r in features])
        for epoch in (0, 1, mine[-1]["epoch"]):
            forest, edge = I.epoch_model(symbol, epoch, values[epoch * every : epoch * every + train], rules.isolation_forest)
            of = slice(epoch * every + train - 1, (epoch + 1) * every + train - 1)
            want = I.model_score(forest, edge, values[of])
            assert np.allclose([r["model_score"] for r in mine if r["epoch"] == epoch], want, rtol=0, atol=1e-12)
    ranks = spark.range(4000).select(F.col("id").alias("_pos"))
    for size, step in ((30, 10), (30, 45), (200, 10)):
        homes = {(r["_pos"], r["block"]) for r in blocks(ranks, size, step, 8).collect()}
        assert len(homes) < 4000 * (1.1 + size / (8 * step))
        for epoch in range((4000 - size) // step):
            assert all((p, epoch // 8) in homes for p in range(epoch * step, min(4000, epoch * step + step + size - 1)))


def test_boosted_trees_are_sparks(spark):
    """The same thresholds, splits and scores as Spark's own fit, from blocks of bytes instead of a row's objects; zeros, ties and a constant feature."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from tapewarden.operators import boosting
    from tapewarden.operators.features import FEATURES
    from tapewarden.operators.learning import score_boosted, train_boosted

    rng = np.random.default_rng(9)
    values = rng.normal(size=(12_000, len(FEATURES)))
    values[:, 1], values[:, 2], values[:, 3] = np.round(values[:, 1]), 4.0, np.maximum(values[:, 3], 0.0)
    y = (values[:, 0] + values[:, 1] * values[:, 3] + rng.normal(size=len(values)) > 1).astype(int)
    rows = [(int(label), *map(float, line)) for label, line in zip(y, values, strict=True)]
    for count in (12_000, 150):
        train = checkpointed(spark.createDataFrame(rows[:count], f"y int, {', '.join(f'{f} double' for f in FEATURES)}").repartition(3))
        packed = []
        checked = boosting.checkpointed
        boosting.checkpointed = lambda df: (packed.append(out := checked(df)), out)[1]
        try:
            model = train_boosted(train, trees=4)
        finally:
            boosting.checkpointed = checked
        assert packed[0].agg(F.sum(F.length("bins") + F.length("labels"))).first()[0] == count * (len(FEATURES) + 1)
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train)
        own = GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, stepSize=0.1, seed=7).fit(assembled)
        splits = lambda trees: [[line.split("Predict")[0] for line in t.toDebugString.split("\n")[1:]] for t in trees]
        if count > 10_000:
            assert splits(model.stages[1].trees) == splits(own.trees)
        want = {tuple(r[:-1]): r[-1][1] for r in own.transform(assembled).select(*FEATURES, "probability").collect()}
        for r in score_boosted(train, model).select(*FEATURES, "score").collect():
            assert abs(want[tuple(r[:-1])] - r[-1]) < 1e-9


def test_a_split_keeps_one_copy_of_its_rows(spark, monkeypatch):
    """What was written on the way to the ranks goes as soon as they are there."""
    import os

    from tapewarden.operators import learning
    from tapewarden.operators import split

    folders, counted = [], []
    written = split.written
    monkeypatch.setattr(split, "written", lambda df, *more: (folders.append(out := written(df, *more)), counted.append(df.columns), out)[2])
    rows = spark.range(900).select(F.col("id").alias("event_us"), F.col("id").cast("string").alias("trade_id"))
    for limit in (100, 10_000):
        folders.clear(), counted.clear()
        train, test = learning.time_split(rows, 0.3, rows_per_task=limit)
        assert (train.count(), test.agg(F.min("_pos"), F.max("event_us")).first()[:]) == (630, (630, 899))
        paths = [f.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/") for f in folders]
        whole = [p for p, names in zip(paths, counted, strict=True) if "trade_id" in names]
        assert len(whole) == 2 and sum(os.path.exists(p) for p in whole) == 1
        split.discard(train)
        assert not any(os.path.exists(p) for p in whole)
