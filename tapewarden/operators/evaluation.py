"""Event-based scoring of flagged rows against labels, and comparison of scans and rulesets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import Rules
from .rolling import ORDER
from .split import CHUNK, HALO, ROWS_PER_TASK, checkpointed, split_by_rank


def stream_runs(
    records: DataFrame,
    order: Sequence[str] = ORDER,
    keys: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
    rulesets: Sequence[str] = (),
) -> DataFrame:
    """Maximal runs of equal state in stream order, over all symbols.

    The state of a row is its label or, without one, whether it was flagged.
    ``records`` has ``label``, ``flagged`` and the order columns. A global
    order is one group, so it is cut by rank like a hot symbol: one halo row
    tells a chunk whether its first row starts a run, and the run numbers of a
    chunk start after the runs of the chunks before it. ``keys`` separates independent streams.

    With ``rulesets``, ``flagged`` is an array with one entry for each of them. A row is ordered once for all, and
    the runs come with ``ruleset``.
    """
    flagged = F.col("flagged")
    if rulesets:
        flagged = F.array(*[F.coalesce(flagged[i], F.lit(False)) for i in range(len(rulesets))])
    else:
        flagged = F.array(F.coalesce(flagged, F.lit(False)))
    # read twice below (count, then rows), and whatever flagged the rows is dear
    slim = checkpointed(records.select(*keys, *order, "label", flagged.alias("flagged")))
    cut, group, was_cut, _ = split_by_rank(slim, keys, order, halo=1, rows_per_task=rows_per_task)
    within = Window.partitionBy(*group).orderBy(*order)
    upto, last = within.rowsBetween(Window.unboundedPreceding, 0), F.col("_previous")
    names, several = rulesets or [""], ["ruleset"] if rulesets else []
    numbered = cut.withColumn("_previous", F.lag(F.struct("label", "flagged")).over(within))
    starts = {}
    for i in range(len(names)):
        same = F.col("label").isNotNull() | (F.col("flagged")[i] == last["flagged"][i])
        same = last.isNotNull() & F.col("label").eqNullSafe(last["label"]) & same
        starts[f"_start{i}"] = F.when(F.col(HALO) | same, 0).otherwise(1)
    numbered = numbered.withColumns(starts).withColumns({f"_run{i}": F.sum(f"_start{i}").over(upto) for i in range(len(names))})
    told = [F.struct(F.lit(n).alias("ruleset"), F.col(f"_run{i}").alias("run"), F.col("flagged")[i].alias("flagged")) for i, n in enumerate(names)]
    rows = numbered.filter(~F.col(HALO)).select(*keys, CHUNK, "label", F.inline(F.array(*told)))
    # all rows of a run have its label
    totals = lambda n: [F.bool_or("flagged").alias("flagged"), n.alias("rows")]
    runs = rows.groupBy(*keys, CHUNK, *several, "run", "label").agg(*totals(F.count(F.lit(1))))
    if was_cut:
        runs = checkpointed(runs)
        earlier = Window.partitionBy(*keys, *several).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        # one row per chunk and ruleset
        base = runs.groupBy(*keys, *several, CHUNK).agg(F.max("run").alias("_runs"))
        base = base.select(*keys, *several, CHUNK, F.coalesce(F.sum("_runs").over(earlier), F.lit(0)).alias("_base"))
        runs = runs.join(base, [*keys, *several, CHUNK]).withColumn("run", F.col("run") + F.col("_base"))
        runs = runs.groupBy(*keys, *several, "run", "label").agg(*totals(F.sum("rows")))
    return runs.select(*keys, *several, "run", "label", "flagged", "rows")


def engine_runs(tape: DataFrame, rules: Rules | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Runs of a labelled tape, a trade being flagged if it has an alert after the cooldown."""
    from .alerts import run_engine

    alerted = run_engine(tape, rules, rows_per_task=rows_per_task, columns=()).select("trade_id").distinct()
    records = tape.select(*ORDER, "label").join(alerted.withColumn("flagged", F.lit(True)), "trade_id", "left")
    return stream_runs(records, rows_per_task=rows_per_task)


def episodes(runs: DataFrame) -> DataFrame:
    """Labelled runs; one is detected when any of its rows was flagged."""
    return runs.filter(F.col("label").isNotNull()).select("run", "label", F.col("flagged").alias("detected"), "rows")


def label_recall(runs: DataFrame) -> DataFrame:
    return episodes(runs).groupBy("label").agg(F.count_if("detected").alias("detected"), F.count(F.lit(1)).alias("total"))


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def event_metrics(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (per key): events, detections, false alarms and the ratios built from them."""
    event, normal = F.col("label").isNotNull(), F.col("label").isNull()
    zero = F.lit(0)
    totals = runs.groupBy(*keys).agg(
        F.coalesce(F.sum("rows"), zero).alias("total_trades"),
        F.count_if(event).alias("total_events"),
        F.count_if(event & F.col("flagged")).alias("detected_events"),
        F.count_if(normal & F.col("flagged")).alias("false_alarm_episodes"),
        F.coalesce(F.sum(F.when(normal, F.col("rows"))), zero).alias("normal_trades"),
        F.coalesce(F.sum(F.when(normal & F.col("flagged"), F.col("rows"))), zero).alias("normal_trades_flagged"),
    )
    return (
        totals.withColumns(
            {
                "precision": _ratio(
                    F.col("detected_events"), F.col("detected_events") + F.col("false_alarm_episodes")
                ),
                "recall": _ratio(F.col("detected_events"), F.col("total_events")),
                "false_positive_rate": _ratio(F.col("normal_trades_flagged"), F.col("normal_trades")),
            }
        )
        .withColumn(
            "f1",
            _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def ruleset_sweep(
    windows: DataFrame,
    rulesets: dict[str, Rules],
    rows_per_task: int = ROWS_PER_TASK,
    cooldown_alerts: bool = False,
    tapes: Column | None = None,
) -> DataFrame:
    """Event metrics of several threshold sets over features computed once.

    Each set becomes one flag of the same scan (no join, no repeated windows). By default a set is judged on what its
    thresholds flag; with ``cooldown_alerts`` on the alerts that survive its own cooldown, all sets in one
    de-duplication. ``tapes`` names the tape of a trade: then there is one line per ruleset and tape
    (see :func:`sweep_spread`). ``windows`` comes from ``engine_windows`` and has ``label``.
    """
    from .cooldown import mark_cooldown
    from .detectors import enabled_detectors

    keys = [] if tapes is None else ["tape"]
    windows = windows.withColumn("tape", F.lit("") if tapes is None else tapes)
    seconds = {rules.alert_cooldown_seconds for rules in rulesets.values()}
    if cooldown_alerts and len(seconds) > 1:
        raise ValueError(f"one cooldown for all rulesets of a sweep, not {sorted(seconds)}")
    told = []
    for rules in rulesets.values():
        fires = [(d.name, F.coalesce(d.build(rules).fires, F.lit(False))) for d in enabled_detectors(rules)]
        names = F.filter(F.array(*[F.when(f, F.lit(n)) for n, f in fires]), lambda n: n.isNotNull()) if fires else F.array()
        told.append(names.cast("array<string>"))
    # a trade stays one row, whatever the number of rulesets
    slim = windows.select(*ORDER, "symbol", "tape", "label", F.array(*told).alias("told"))
    flagged = [F.size(F.col("told")[i]) > 0 for i in range(len(told))]
    if cooldown_alerts:
        slim = checkpointed(slim)  # read twice, and the windows are dear
        lines = F.array(*[F.struct(F.lit(n).alias("ruleset"), F.col("told")[i].alias("detectors")) for i, n in enumerate(rulesets)])
        fired = slim.select("tape", *ORDER, "symbol", F.inline(lines)).select(
            "ruleset", "tape", *ORDER, F.concat_ws("\u0001", "ruleset", "tape", "symbol").alias("symbol"), F.explode("detectors").alias("detector")
        )
        kept = mark_cooldown(fired, seconds.pop(), rows_per_task).filter("emitted")
        kept = kept.groupBy("trade_id").agg(F.collect_set("ruleset").alias("kept"))
        slim = slim.join(kept, "trade_id", "left")
        flagged = [F.coalesce(F.array_contains("kept", n), F.lit(False)) for n in rulesets]
    records = slim.withColumn("flagged", F.array(*flagged))
    runs = stream_runs(records, keys=keys, rows_per_task=rows_per_task, rulesets=list(rulesets))
    return event_metrics(runs, ["ruleset", *keys])


def sweep_spread(metrics: DataFrame, by: str = "ruleset") -> DataFrame:
    """Mean and spread of F1 per ruleset, for sweeps repeated over several tapes."""
    return metrics.groupBy(by).agg(
        F.avg("f1").alias("f1_mean"),
        F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("f1_std"),
        F.count(F.lit(1)).alias("runs"),
    )


def scan_crosscheck(left: DataFrame, right: DataFrame, left_name: str = "rolling", right_name: str = "history") -> DataFrame:
    """Flag counts of two scans side by side per symbol and detector."""
    keys = ["symbol", "detector"]
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias(left_name))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias(right_name))
    joined = a.join(b, keys, "full_outer").fillna({left_name: 0, right_name: 0})
    return joined.withColumn("both_flag", (F.col(left_name) > 0) & (F.col(right_name) > 0))


def row_agreement(
    left: DataFrame, right: DataFrame, row: Sequence[str] = ("symbol", "price", "quantity"), by: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Flagged rows that both scans have, and those only one has, per ``by``; equal rows are matched one to one.

    A scan need not carry trade ids, so rows match by their values as a multiset: of n and m equal
    rows the smaller number agrees. Both scans are counted in one grouped pass, whatever their overlap.
    """
    sides = [df.select(*row, F.lit(n).alias("_left"), F.lit(1 - n).alias("_right")) for df, n in ((left, 1), (right, 0))]
    counts = sides[0].unionByName(sides[1]).groupBy(*row).agg(F.sum("_left").alias("l"), F.sum("_right").alias("r"))
    return counts.groupBy(*by).agg(
        F.sum(F.least("l", "r")).alias("both"),
        F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("only_left"),
        F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("only_right"),
    )
