import random
from collections import deque

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from checker import greedy
from tapewarden.operators.admission import admission, admitted
from tapewarden.operators.cooldown import _NEVER, Steps, chain_exits, compose, cooldown, emitted_positions, mark_cooldown, pass_through

times = st.lists(st.integers(0, 200), min_size=1, max_size=60, unique=True).map(sorted)


@given(times, st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_jumping_equals_greedy(ts, gap):
    assert emitted_positions(np.array(ts), gap) == greedy(ts, gap)


@given(times, st.integers(1, 40), st.integers(2, 9))
@settings(max_examples=300, deadline=None)
def test_walking_chunk_reports_equals_greedy(ts, gap, size):
    last = None
    for start in range(0, len(ts), size):
        chunk = np.array(ts[start : start + size])
        until, leave = chain_exits(chunk, gap)
        at = 0 if last is None else int(np.searchsorted(until, last + gap))
        if at < len(until):
            last = int(leave[at])
        seen = ts[: start + size]
        assert last == seen[greedy(seen, gap)[-1]]


@given(times, st.integers(1, 60), st.integers(1, 9), st.integers(2, 4))
@settings(max_examples=400, deadline=None)
def test_composed_reports_equal_greedy(ts, gap, size, fan):
    """Up a tree of reports and down again: dense bursts may lie within one cooldown, over many chunks."""
    chunks = [np.array(ts[k : k + size]) for k in range(0, len(ts), size)]
    levels = [[Steps(*chain_exits(c, gap), int(c[0]), int(c[-1])) for c in chunks]]
    while len(levels[-1]) > 1:
        levels.append([compose(levels[-1][k : k + fan], gap) for k in range(0, len(levels[-1]), fan)])
    for level in levels:
        for steps in level:  # a step at most for each candidate of the first cooldown, and one that ends it
            assert len(steps.until) <= sum(steps.first <= t < steps.first + gap for t in ts) + 1
    entries = [_NEVER]
    for level in reversed(levels[:-1]):
        below = []
        for k, steps in enumerate(level):
            below.append(entries[k // fan] if k % fan == 0 else int(pass_through(np.array([below[-1]]), level[k - 1].until, level[k - 1].leave, gap)[0]))
        entries = below
    got = [k * size + p for k, (chunk, entry) in enumerate(zip(chunks, entries)) for p in emitted_positions(chunk, gap, entry)]
    assert got == greedy(ts, gap)


def test_half_a_million_candidates_of_one_key(spark):
    """A burst that is denser than a chunk and one that no cooldown separates: every chunk is its own task."""
    n = 500_000
    df = spark.range(n).selectExpr("'A' as symbol", "'x' as detector", "id * 37 + (id div 100000) * 5000000 as event_us", "cast(id as string) as trade_id").repartition(8)
    times = np.arange(n) * 37 + np.arange(n) // 100_000 * 5_000_000
    got = sorted(int(r[0]) for r in cooldown(df, 8.0, 20_000).select("event_us").collect())
    assert got == times[emitted_positions(times, 8_000_000)].tolist()


def alerts(spark, seed, n):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 0, 300_000, 1_000_000, 7_999_999, 8_000_000, 20_000_000])
        rows.append((rng.choice("AB"), rng.choice(["x", "y"]) if i % 5 else "x", at, f"t{i:05d}"))
    return spark.createDataFrame(rows, "symbol string, detector string, event_us long, trade_id string"), rows


def test_cooldown_in_one_chunk_and_in_many(spark):
    df, rows = alerts(spark, 5, 1500)
    expected = set()
    for key in {(r[0], r[1]) for r in rows}:
        mine = [r for r in rows if (r[0], r[1]) == key]
        expected |= {(*key, mine[i][3]) for i in greedy([r[2] for r in mine], 8_000_000)}
    for limit in (100_000, 40):
        got = {(r["symbol"], r["detector"], r["trade_id"]) for r in cooldown(df, 8.0, limit).collect()}
        assert got == expected
    marked = mark_cooldown(df, 8.0).selectExpr("sum(candidates) as c").first()
    assert marked["c"] == len(rows)
    assert cooldown(df, 0.0).count() == len(rows)


@given(st.lists(st.integers(0, 400), max_size=80).map(sorted), st.integers(1, 6), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_admission_by_jumps_equals_one_hit_at_a_time(ts, limit, size):
    ts = [t * 1_000_000 for t in ts]
    want, taken = [], []
    for t in ts:
        want.append(sum(x >= t - 60_000_000 for x in taken) < limit)
        if want[-1]:
            taken.append(t)
    held, got = deque(), []
    for k in range(0, len(ts), size):
        got += admitted(np.array(ts[k : k + size]), limit, held).tolist()
    assert got == want


def test_admission_boundary_and_chunks(spark):
    minute = 60_000_000
    hits = [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "3"), ("a", 3, "4"), ("b", 3, "5"), ("a", minute, "6"), ("a", minute + 1, "7")]
    df = spark.createDataFrame(hits, "client string, event_us long, hit_id string")
    for limit in (1000, 2):
        got = {r["hit_id"]: r["accepted"] for r in admission(df, 3, limit).collect()}
        # a hit exactly 60 s old still counts, one a microsecond older does not
        assert got == {"1": True, "2": True, "3": True, "4": False, "5": True, "6": False, "7": True}
    assert admission(df, 0).filter("accepted").count() == len(hits)
