import math
import random

import pytest
from conftest import tape, trade

from checker import windows
from tapewarden.operators.features import FEATURES, model_features
from tapewarden.operators.rolling import engine_windows
from tapewarden.operators.split import rank_within, running_sums
from tapewarden.rules import Rules

COLUMNS = ("window_size", "price_mean", "price_std", "volume_median", "previous_price", "velocity", "buys", "sells")


def last(df):
    return df.orderBy("event_us", "trade_id").collect()[-1]


def canonical(df):
    """Sorted rows; sums may differ in the last digit with the width of a chunk's widest window."""
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def rough_tape(n, seed, burst=0):
    """Ties, bursts, gaps at the exact horizon and two symbols of very different size."""
    rng, at, out = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([0.0, 0.0, 0.5, 1.0, 5.0, rng.random() * 40, 300.0 if rng.random() < 0.02 else 0.1])
        symbol = "HOT" if rng.random() < 0.8 else "COLD"
        out.append(trade(at, round(100 + rng.gauss(0, 1), 2), rng.randint(1, 50) * 10.0, rng.choice(["buy", "sell"]), symbol))
        for _ in range(burst if i == n // 2 else 0):
            out.append(trade(at + rng.random() * 2, 100.0, 10.0, "buy", "HOT"))
    return out


@pytest.mark.parametrize(("seed", "burst"), [(1, 0), (2, 300)])
def test_windows_match_a_plain_deque(spark, seed, burst):
    df = tape(spark, rough_tape(500, seed, burst))
    rows = sorted((r.asDict() for r in df.collect()), key=lambda r: (r["event_us"], r["trade_id"]))
    expected = {w["trade_id"]: w for s in ("HOT", "COLD") for w in windows([r for r in rows if r["symbol"] == s])}
    got = engine_windows(df).collect()
    assert len(got) == len(expected)
    for row in got:
        for name in COLUMNS:
            want = expected[row["trade_id"]][name]
            assert row[name] == want or math.isclose(row[name], want, rel_tol=1e-9, abs_tol=1e-9), (row, name, want)


def test_rank_split_gives_the_same_windows(spark):
    df = tape(spark, rough_tape(900, 3, 250))
    names = ["trade_id", *COLUMNS, "matched_trade_id"]
    whole, cut = engine_windows(df).select(*names), engine_windows(df, rows_per_task=210).select(*names)
    assert canonical(whole) == canonical(cut)


def test_rank_split_gives_the_same_features(spark):
    df = tape(spark, rough_tape(900, 4, 250))
    names = ["trade_id", *FEATURES]
    whole, cut = model_features(df).select(*names), model_features(df, rows_per_task=210).select(*names)
    assert canonical(whole) == canonical(cut)


def test_ranks_and_running_sums_across_chunks(spark):
    df = spark.range(1000).selectExpr("cast(id % 3 = 0 as string) as k", "id", "id * 7 % 11 as v")
    for limit in (10_000, 50):
        ranks = {(r["k"], r["id"]): r["_pos"] for r in rank_within(df, ["k"], ["id"], limit).collect()}
        for k in ("true", "false"):
            ids = sorted(i for (key, i) in ranks if key == k)
            assert [ranks[k, i] for i in ids] == list(range(len(ids)))
        sums = {r["id"]: r["s"] for r in running_sums(df, ["id"], {"s": df.v}, limit).collect()}
        total = 0
        for i in range(1000):
            total += i * 7 % 11
            assert sums[i] == total


def test_count_eviction(spark):
    rules = Rules().replace(window={"max_trades": 5, "min_trades": 2})
    row = last(engine_windows(tape(spark, [trade(i, 100.0 + i) for i in range(10)]), rules))
    assert row["window_size"] == 5
    assert row["price_mean"] == pytest.approx(sum(range(105, 109)) / 4)


def test_age_eviction_keeps_the_exact_horizon(spark):
    rules = Rules().replace(window={"horizon_seconds": 10.0})
    assert last(engine_windows(tape(spark, [trade(i) for i in range(30)]), rules))["window_size"] == 11


def test_previous_price_ages_out_one_microsecond_after_the_horizon(spark):
    kept = last(engine_windows(tape(spark, [trade(0, 90.0), trade(300.0)])))
    gone = last(engine_windows(tape(spark, [trade(0, 90.0), trade(300.000001)])))
    assert kept["previous_price"] == 90.0
    assert gone["previous_price"] is None


def test_counts_and_sides(spark):
    rules = Rules().replace(spoofing={"window_seconds": 1.0}, velocity={"window_seconds": 1.0})
    row = last(engine_windows(tape(spark, [trade(i / 10) for i in range(10)]), rules))
    assert (row["velocity"], row["buys"], row["sells"]) == (10, 10, 0)


def test_trimmed_median_drops_the_largest_even_if_it_is_not_the_current(spark):
    sizes = [1.0, 9.0, 2.0, 3.0]
    row = last(engine_windows(tape(spark, [trade(i, quantity=q) for i, q in enumerate(sizes)])))
    assert row["volume_median"] == 2.0


def test_features_of_first_trade_and_of_a_jump(spark):
    flat = [trade(i, 100.0 + (i % 2) * 0.5, 100.0 + i % 3) for i in range(41)]
    rows = model_features(tape(spark, [*flat, trade(41, 100.0), trade(42, 180.0)])).orderBy("event_us").collect()
    assert all(math.isfinite(rows[0][f]) for f in FEATURES)
    assert rows[0]["size_vs_median"] == 1.0
    assert rows[-1]["price_z"] > rows[-2]["price_z"]


def test_moments_do_not_depend_on_the_chunk():
    """Statistics of a row are bit for bit the same wherever the tape is cut and whatever its neighbours need."""
    import numpy as np

    from tapewarden.functions.sliding import moments

    rng = np.random.default_rng(4)
    values, size = rng.random(5000) * 1e5, rng.integers(0, 200, 5000)
    size = np.minimum(size, np.arange(5000))
    mean, std = moments(values, size, skip=1, ddof=1, width=200)
    for start in (1000, 1017, 3333):
        part = slice(start - 201, None)
        own = np.minimum(size[part], np.arange(5000 - start + 201))
        cut_mean, cut_std = moments(values[part], own, skip=1, ddof=1, width=200)
        assert (cut_mean[201:] == mean[start:]).all() and (cut_std[201:] == std[start:]).all()


def test_flat_windows_are_exactly_flat():
    import numpy as np

    from tapewarden.functions.sliding import moments

    for price in (100.1, 60_000.1, 0.1, 1 / 3):
        values = np.append(np.full(60, price), price * 1.01)
        mean, std = moments(values, np.minimum(np.arange(61), 50), skip=1, ddof=1, width=100)
        assert (mean[1:] == price).all() and (std == 0).all()
