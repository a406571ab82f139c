"""Per-symbol rolling statistics of the detection engine, exact in set form.

The window of a trade holds the trade itself and the rows before it that are
both among the last ``max_trades`` and no older than ``horizon_seconds``.
Row order is ``(event_us, trade_id)``, a total order.

How each piece is computed, all over one exchange and one sort:

* counts inside a horizon: row number minus the rows strictly older than the
  horizon (a growing RANGE frame, linear whatever the burst), capped by the
  count limit;
* buys inside a horizon: differences of growing sums;
* price and size statistics: two-pass numpy over each bounded chunk, sliced to
  the exact window size. A frame cannot end at "the last 200 rows and the last
  300 seconds, whichever is shorter"; array frames folded with ``aggregate``
  can, but measured 8 times slower (an interpreted lambda per element), and
  prefix sums cancel badly on flat prices, where a wrong standard deviation is
  a false alert;
* wash matches in the same pass: each look-back step compares whole columns
  and goes on only with the rows still unmatched and in reach.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sliding import arrow_columns, latest_match, medians, moments
from ..rules import Rules, micros
from .split import CHUNK, HALO, ROWS_PER_TASK, own_rows, split_by_rank

ORDER = ("event_us", "trade_id")

#: A ready row's number in its chunk, from one.
NTH = "_nth"

#: Columns computed in Arrow; ask for the ones you need.
STATISTICS = ("price_mean", "price_std", "volume_mean", "volume_std", "volume_median", "matched_trade_id")

#: Every column :func:`engine_windows` can add.
WINDOW_COLUMNS = (
    "window_size",
    "price_mean",
    "price_std",
    "volume_mean",
    "volume_std",
    "volume_median",
    "previous_price",
    "velocity",
    "side_total",
    "buys",
    "sells",
    "ready",
)


def _older_than(by_time, seconds: float):
    return by_time.rangeBetween(Window.unboundedPreceding, -(micros(seconds) + 1))


def _counts(cut: DataFrame, group: list[str], rules: Rules) -> DataFrame:
    """Window sizes, velocity and side counts (growing frames only)."""
    by_rank = Window.partitionBy(*group).orderBy(*ORDER)
    by_time = Window.partitionBy(*group).orderBy("event_us")
    cap = rules.window.max_trades
    is_buy = F.when(F.col("side") == "buy", 1).otherwise(0)
    one = F.lit(1)
    grow = by_rank.rowsBetween(Window.unboundedPreceding, 0)
    before_cap = by_rank.rowsBetween(Window.unboundedPreceding, -cap)
    side_seconds = min(rules.spoofing.window_seconds, rules.window.horizon_seconds)
    counted = cut.withColumns(
        {
            "_rn": F.row_number().over(by_rank).cast("long"),
            "_lag_price": F.lag("price").over(by_rank),
            "_buys": F.sum(is_buy).over(grow),
            "_buys_cap": F.coalesce(F.sum(is_buy).over(before_cap), F.lit(0)),
        }
    ).withColumns(
        {
            "_old_window": F.count(one).over(_older_than(by_time, rules.window.horizon_seconds)),
            "_old_velocity": F.count(one).over(_older_than(by_time, rules.velocity.window_seconds)),
            "_old_sides": F.count(one).over(_older_than(by_time, side_seconds)),
            "_buys_old": F.coalesce(F.sum(is_buy).over(_older_than(by_time, side_seconds)), F.lit(0)),
        }
    )
    capped = F.col("_rn") - F.col("_old_sides") > cap
    size = F.least(F.lit(cap), F.col("_rn") - F.col("_old_window"))
    held = lambda old: F.least(size, F.col("_rn") - F.col(old))
    return counted.withColumns(
        {
            "window_size": size.cast("int"),
            "velocity": held("_old_velocity").cast("int"),
            "side_total": held("_old_sides").cast("int"),
            "buys": (F.col("_buys") - F.when(capped, F.col("_buys_cap")).otherwise(F.col("_buys_old"))).cast("int"),
        }
    ).withColumns(
        {
            "sells": F.col("side_total") - F.col("buys"),
            "previous_price": F.when(F.col("window_size") > 1, F.col("_lag_price")),
            "ready": F.col("window_size") > rules.window.min_trades,
        }
    )


def _wash_matches(chunk, rules: Rules):
    """Latest earlier trade of the same account on the other side at about the same price and size."""
    wash, account, ids = rules.wash_trade, chunk.column("account_id"), chunk.column("trade_id")
    codes = account.combine_chunks().dictionary_encode().indices
    owner = codes.fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
    blank = pc.equal(pc.fill_null(account, ""), "").to_numpy()
    owner[blank] = -1
    found = latest_match(
        chunk.column("event_us").to_numpy(),
        owner,
        pc.equal(chunk.column("side"), "buy").to_numpy(),
        chunk.column("price").to_numpy(),
        chunk.column("quantity").to_numpy(),
        micros(min(wash.window_seconds, rules.window.horizon_seconds)),
        rules.window.max_trades,
        wash.price_tolerance,
        wash.quantity_tolerance,
        lambda a, b: pc.not_equal(ids.take(pa.array(a)), ids.take(pa.array(b))).to_numpy(),
    )
    return ids.take(pa.array(found, mask=found < 0))


def _statistics(counted: DataFrame, group: list[str], rules: Rules, wanted: Iterable[str]) -> DataFrame:
    """Statistics and wash matches over the exact window, one bounded chunk per call."""
    wanted = tuple(name for name in STATISTICS if name in set(wanted))
    if not wanted:
        return counted

    def compute(chunk):
        size, width = chunk.column("window_size").to_numpy(), rules.window.max_trades
        price, quantity = chunk.column("price").to_numpy(), chunk.column("quantity").to_numpy()
        out = {}
        if "price_mean" in wanted or "price_std" in wanted:
            out["price_mean"], out["price_std"] = moments(price, size - 1, skip=1, ddof=1, width=width)
        if "volume_mean" in wanted or "volume_std" in wanted:
            out["volume_mean"], out["volume_std"] = moments(quantity, size - 1, skip=1, ddof=1, width=width)
        if "volume_median" in wanted:
            # the largest size of the window, the current trade included, is dropped
            out["volume_median"] = medians(quantity, size, skip=0, width=width, drop_largest=1)
        if "matched_trade_id" in wanted:
            out["matched_trade_id"] = _wash_matches(chunk, rules)
        return {name: out[name] for name in wanted}

    types = {"matched_trade_id": T.StringType()}
    added = [T.StructField(name, types.get(name, T.DoubleType())) for name in wanted]
    schema = T.StructType([*counted.schema.fields, *added])
    return counted.groupBy(*group).applyInArrow(arrow_columns(compute, "_rn"), schema)


def engine_windows(
    tape: DataFrame,
    rules: Rules | None = None,
    statistics: Iterable[str] = STATISTICS,
    rows_per_task: int = ROWS_PER_TASK,
    numbered: bool = False,
) -> DataFrame:
    """Add the columns of :data:`WINDOW_COLUMNS` to a tape.

    ``statistics`` limits the Arrow-computed ones; the frame-based ones are
    pruned by the optimizer when nobody selects them. ``numbered`` adds how many ready rows the row's chunk
    (``_chunk``) of its symbol has up to it.
    """
    rules = rules or Rules()
    cut, group, _, _ = split_by_rank(tape, ["symbol"], ORDER, halo=rules.window.max_trades, rows_per_task=rows_per_task)
    counted = _counts(cut, group, rules)
    if numbered:
        grow = Window.partitionBy(*group).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn(NTH, F.sum(F.when(F.col("ready") & ~F.col(HALO), 1).otherwise(0)).over(grow).cast("long"))
    scratch = ["_lag_price", "_buys", "_buys_cap", "_old_window", "_old_velocity", "_old_sides", "_buys_old"]
    seen = _statistics(counted.drop(*scratch), group, rules, statistics)
    return (seen.filter(~F.col(HALO)).drop(HALO) if numbered else own_rows(seen)).drop("_rn")


RECENT = "array<struct<trade_id:string,event_us:bigint,price:double,quantity:double,side:string>>"


def recent_rows(tape: DataFrame, seconds: float, rules: Rules | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``recent``: the rows of a trade's window that are no older than ``seconds``, itself last.

    At most ``max_trades`` rows each; one bounded chunk takes them by position from its sorted columns.
    """
    rules = rules or Rules()
    held = min(seconds, rules.window.horizon_seconds)
    slim = tape.select("symbol", "trade_id", "event_us", "price", "quantity", "side")
    cut, group, _, _ = split_by_rank(slim, ["symbol"], ORDER, halo=rules.window.max_trades, rows_per_task=rows_per_task)
    by_rank, by_time = Window.partitionBy(*group).orderBy(*ORDER), Window.partitionBy(*group).orderBy("event_us")
    place = F.row_number().over(by_rank).cast("long")
    counted = cut.withColumns({"_rn": place, "_old": F.count(F.lit(1)).over(_older_than(by_time, held))})
    counted = counted.withColumn("_held", F.least(F.lit(rules.window.max_trades), F.col("_rn") - F.col("_old"))).drop("_old")
    fields = ("trade_id", "event_us", "price", "quantity", "side")

    def compute(chunk):
        size = chunk.column("_held").to_numpy()
        ends = np.cumsum(size)
        # the rows i - size + 1 to i, one trade after another
        index = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(np.arange(len(size)) - size + 1, size)
        lists = [chunk.column(name).combine_chunks().take(pa.array(index)) for name in fields]
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return {"recent": pa.chunked_array([pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(lists, list(fields)))])}

    schema = T.StructType([*counted.schema.fields, T.StructField("recent", T._parse_datatype_string(RECENT))])
    out = counted.groupBy(*group).applyInArrow(arrow_columns(compute, "_rn"), schema)
    return own_rows(out).drop("_rn", "_held")


def isolation_features(
    tape: DataFrame, rules: Rules | None = None, rows_per_task: int = ROWS_PER_TASK, numbered: bool = False
) -> DataFrame:
    """The four online-model features of every ready trade (signed, sample deviation)."""
    rules = rules or Rules()
    # the model's velocity always looks five seconds back
    fixed = rules.replace(velocity={"window_seconds": 5.0})
    moments_only = ("price_mean", "price_std", "volume_mean", "volume_std")
    # a cut tape is written out with all its columns
    slim = tape.select("symbol", *ORDER, "price", "quantity", "side")
    seen = engine_windows(slim, fixed, moments_only, rows_per_task=rows_per_task, numbered=numbered).filter("ready")
    last = F.when(F.coalesce("previous_price", F.lit(0.0)) == 0.0, F.col("price")).otherwise(F.col("previous_price"))
    z = lambda x, mean, std: F.when(F.col(std) > 1e-9, (F.col(x) - F.col(mean)) / F.col(std)).otherwise(0.0)
    return seen.select(
        "symbol",
        "trade_id",
        "event_us",
        "price",
        "quantity",
        z("price", "price_mean", "price_std").alias("f_price_z"),
        z("quantity", "volume_mean", "volume_std").alias("f_vol_z"),
        F.when(last > 0, (F.col("price") - last) / last).otherwise(0.0).alias("f_ret"),
        F.col("velocity").cast("double").alias("f_velocity"),
        *([CHUNK, NTH] if numbered else []),
    )
