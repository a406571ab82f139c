"""Classifier metrics over ``(y, score, predicted)`` rows, all from partial aggregates.

Curves and areas work on distinct scores with counts, so ties are exact and
the ordered part is as small as the number of distinct scores; it is still cut
by rank when that is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .split import ROWS_PER_TASK, checkpointed, running_sums


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def confusion(rows: DataFrame) -> DataFrame:
    """One row ``tn, fp, fn, tp``."""
    actual, said = F.col("y") == 1, F.col("predicted") == 1
    return rows.agg(
        F.count_if(~actual & ~said).alias("tn"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(actual & said).alias("tp"),
    )


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """Ratios of a confusion row, zero where undefined."""
    tp = F.col("tp")
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + F.col("fp")),
            "recall": _ratio(tp, tp + F.col("fn")),
            "f1": _ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")),
        }
    )


def curve_points(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One point per distinct score, from the highest: cumulative hits, rates, precision and recall."""
    steps = (
        rows.groupBy((-F.col("score")).alias("_down"))
        .agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    )
    totals = rows.agg(F.count_if(F.col("y") == 1).alias("_p"), F.count_if(F.col("y") != 1).alias("_n"))
    # totals is a single row
    placed = running_sums(steps, ["_down"], {"tp": F.col("pos"), "fp": F.col("neg")}, rows_per_task)
    return placed.join(F.broadcast(totals)).select(
        (-F.col("_down")).alias("threshold"),
        "pos",
        "neg",
        "tp",
        "fp",
        _ratio(F.col("tp"), F.col("_p")).alias("tpr"),
        _ratio(F.col("fp"), F.col("_n")).alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        "_p",
        "_n",
    )


def area_metrics(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row ``roc_auc`` (ties count half) and ``pr_auc`` (average precision); 0 with a single class."""
    points = curve_points(rows, rows_per_task)
    both = (F.max("_p") > 0) & (F.max("_n") > 0)
    # a positive beats every negative scored lower and ties with those at its own score
    won = F.sum(F.col("pos") * (F.col("_n") - F.col("fp") + F.col("neg") / 2.0))
    steps = F.sum(F.col("pos") * F.col("precision"))
    return points.agg(
        F.when(both, won / F.greatest(F.max("_p") * F.max("_n"), F.lit(1))).otherwise(0.0).alias("roc_auc"),
        F.when(both, steps / F.greatest(F.max("_p"), F.lit(1))).otherwise(0.0).alias("pr_auc"),
    )


def model_metrics(rows: DataFrame, model: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All metrics of one model as one row."""
    # read three times, and the model that scored them is dear
    rows = checkpointed(rows.select("y", "score", "predicted"))
    ratios = precision_recall_f1(confusion(rows))
    areas = area_metrics(rows, rows_per_task)
    columns = ["model", "precision", "recall", "f1", "roc_auc", "pr_auc", "tn", "fp", "fn", "tp"]
    # both sides are single rows
    return ratios.join(F.broadcast(areas)).withColumn("model", F.lit(model)).select(*columns)


def class_balance(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


def class_histogram(rows: DataFrame, feature: str, bins: int = 40) -> DataFrame:
    """Equal-width density histogram per class over the class's own range; empty bins are zero."""
    value = F.col(feature)
    span = rows.groupBy("y").agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    # a class with a single value gets a unit-wide range around it
    span = span.withColumns(
        {
            "_flat": F.col("_hi") == F.col("_lo"),
        }
    ).withColumns(
        {
            "_lo": F.when(F.col("_flat"), F.col("_lo") - 0.5).otherwise(F.col("_lo")),
            "_hi": F.when(F.col("_flat"), F.col("_hi") + 0.5).otherwise(F.col("_hi")),
        }
    ).withColumn("_width", (F.col("_hi") - F.col("_lo")) / bins)
    # one row per class
    spans = F.broadcast(span)
    bucket = F.least(F.lit(bins - 1), F.floor((value - F.col("_lo")) / F.col("_width"))).cast("int")
    counts = rows.join(spans, "y").groupBy("y", bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = grid.join(counts, ["y", "bin"], "left").fillna({"n": 0})
    return filled.select(
        "y",
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("lo"),
        "n",
        (F.col("n") / (F.col("_n") * F.col("_width"))).alias("density"),
    )


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one aggregate over the data."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    lines = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("corr"))
        for a, b in pairs
        for x, y in dict.fromkeys([(a, b), (b, a)])
    ]
    return wide.select(F.inline(F.array(*lines)))


def class_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    c = confusion(rows)
    line = lambda name, hit, wrong, missed: F.struct(
        F.lit(name).alias("class"),
        _ratio(hit, hit + wrong).alias("precision"),
        _ratio(hit, hit + missed).alias("recall"),
        _ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
        (hit + missed).alias("support"),
    )
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    return c.select(F.inline(F.array(line("normal", tn, fn, fp), line("anomaly", tp, fp, fn))))
