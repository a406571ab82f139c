"""A plain-Python rolling window, used only to check the distributed one."""

from __future__ import annotations

import statistics
from collections import deque

from tapewarden.rules import Rules, micros


def windows(rows, rules=None):
    """``rows`` of one symbol in order, as dicts; yields the expected columns per trade."""
    rules = rules or Rules()
    held = deque()
    for row in rows:
        held.append(row)
        while len(held) > rules.window.max_trades:
            held.popleft()
        while held[0]["event_us"] < row["event_us"] - micros(rules.window.horizon_seconds):
            held.popleft()
        since = lambda s: [h for h in held if h["event_us"] >= row["event_us"] - micros(s)]  # noqa: E731, B023
        prior = [h["price"] for h in held][:-1]
        sizes = sorted(h["quantity"] for h in held)[:-1]
        short = since(rules.spoofing.window_seconds)
        yield {
            "trade_id": row["trade_id"],
            "window_size": len(held),
            "price_mean": sum(prior) / len(prior) if prior else 0.0,
            "price_std": statistics.stdev(prior) if len(prior) > 1 else 0.0,
            "volume_median": statistics.median(sizes) if sizes else 0.0,
            "previous_price": held[-2]["price"] if len(held) > 1 else None,
            "velocity": len(since(rules.velocity.window_seconds)),
            "buys": sum(h["side"] == "buy" for h in short),
            "sells": sum(h["side"] != "buy" for h in short),
        }


def greedy(times, gap):
    out, last = [], None
    for i, t in enumerate(times):
        if last is None or t - last >= gap:
            out.append(i)
            last = t
    return out
