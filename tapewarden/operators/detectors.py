"""The rule detectors as column expressions over the rolling window columns.

A detector maps the rules to a nullable alert struct; all detectors of a trade
are evaluated in one projection, so seven rules cost one pass. Users give
their own the same way, or as a pandas function (:class:`PandasDetector`).

Detectors fail open. One that cannot be built or resolved is left out; one that cannot
judge a trade gives no alert for that trade, and its name is put into the trade's ``failed``
array. Expressions are built with ANSI mode off, so a division by zero, a bad cast or an index
out of range is null instead of the end of the job; a verdict that is null although
nothing it may abstain on is null has failed. A pandas function that raises is
called again with halves of its rows until only the failing ones are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.columns import clamp_score, severity_rank
from ..rules import Rules
from ..schema import ALERT_DDL


ALERT_FIELDS = ("detector", "rank", "position", "severity", "score", "reason", "details")


@dataclass(frozen=True)
class Verdict:
    """What a detector says about a trade; a false or null ``fires`` means no alert."""

    fires: Column
    severity: Column
    score: Column
    reason: Column
    details: dict[str, Column]


@dataclass(frozen=True)
class Detector:
    name: str
    build: Callable[[Rules], Verdict]
    #: Arrow-computed window columns the expressions read
    statistics: tuple[str, ...] = ()
    #: columns that may be null: then the detector abstains instead of failing
    abstains: tuple[str, ...] = ()


@dataclass(frozen=True)
class PandasDetector:
    """A detector in Python: ``inspect`` gets rows with ``columns`` and returns ``fires, severity, score, reason, details`` for each."""

    name: str
    inspect: Callable[[pd.DataFrame], pd.DataFrame]
    columns: tuple[str, ...]
    statistics: tuple[str, ...] = ()


AnyDetector = Detector | PandasDetector

_JUDGED = "fires boolean, severity string, score double, reason string, details string, failed boolean"
_JUDGED_COLUMNS = ["fires", "severity", "score", "reason", "details"]


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Expressions that are built in here give null where ANSI mode would raise."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _told(inspect: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame) -> list[np.ndarray] | None:
    """The verdicts on ``rows``, one array a column; none where ``inspect`` raises."""
    try:
        told = inspect(rows.copy())
        if len(told) != len(rows):
            raise ValueError(f"{len(told)} verdicts on {len(rows)} trades")
        kinds = {"fires": bool, "score": float}
        return [told[c].astype(kinds.get(c, object)).to_numpy(dtype=object) for c in _JUDGED_COLUMNS]
    except Exception:  # noqa: BLE001 - whatever a user's function raises
        return None


def judge_rows(inspect: Callable[[pd.DataFrame], pd.DataFrame], rows: pd.DataFrame) -> pd.DataFrame:
    """The verdicts on ``rows``; rows on which ``inspect`` raises are marked as failed, all others judged."""
    out = np.full((len(_JUDGED_COLUMNS), len(rows)), None, dtype=object)
    failed = np.zeros(len(rows), dtype=bool)
    spans = [(0, len(rows))]
    while spans:
        start, end = spans.pop()
        told = _told(inspect, rows.iloc[start:end])
        if told is not None:
            for line, values in zip(out, told, strict=True):
                line[start:end] = values
        elif end - start <= 1:
            failed[start:end] = True
        else:
            middle = start + (end - start) // 2
            spans += [(middle, end), (start, middle)]
    judged = pd.DataFrame(dict(zip(_JUDGED_COLUMNS, out, strict=True)) | {"failed": failed}, index=rows.index)
    judged["score"] = judged["score"].astype(float)
    return judged if failed.any() else judged.astype({"fires": bool})


def _judged(detector: PandasDetector) -> Column:
    inspect = detector.inspect

    @F.pandas_udf(_JUDGED)
    def judge(rows: pd.DataFrame) -> pd.DataFrame:
        return judge_rows(inspect, rows.reset_index(drop=True))

    return judge(F.struct(*detector.columns))


def _col(name: str) -> Column:
    return F.col(name)


def _fixed(column: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", column.cast("double"))


def _tiers(critical: Column, otherwise: str) -> Column:
    return F.when(critical, "critical").otherwise(otherwise)


def zscore_column() -> Column:
    spread = F.col("price_std")
    return F.when(spread > 1e-12, (F.col("price") - F.col("price_mean")) / spread).otherwise(0.0)


# Fixed values from here on: names of detectors and details, severities, and the texts of reasons.


def _zscore(rules: Rules) -> Verdict:
    limit, z = rules.zscore.price_threshold, zscore_column()
    size = F.abs(z)
    score = F.lit(1.0) if limit <= 0 else F.least(F.lit(1.0), 0.6 + 0.4 * (size - limit) / limit)
    return Verdict(
        fires=_col("ready") & (size >= limit),
        severity=_tiers(size >= limit * rules.zscore.critical_multiplier, "high"),
        score=score,
        reason=F.concat(
            F.lit("price "), _fixed(_col("price"), 4), F.lit(" is "), F.format_string("%+.2f", z),
            F.lit("σ from mean "), _fixed(_col("price_mean"), 4), F.lit(" (σ="), _fixed(_col("price_std"), 4), F.lit(")"),
        ),
        details={
            "price_z": F.round(z, 3),
            "price_mean": F.round("price_mean", 4),
            "price_std": F.round("price_std", 4),
        },
    )


def _price_spike(rules: Rules) -> Verdict:
    spike, last = rules.price_spike, F.col("previous_price")
    move = F.when(last > 0, (F.col("price") - last) / last)
    return Verdict(
        fires=(last > 0) & (F.abs(move) >= spike.pct_threshold),
        severity=_tiers(F.abs(move) >= spike.critical_pct, "high"),
        score=F.least(F.lit(1.0), F.abs(move) / max(spike.critical_pct, 1e-9)),
        reason=F.concat(
            F.lit("instantaneous price "), F.when(move > 0, "surge").otherwise("drop"), F.lit(" of "),
            F.format_string("%+.2f", move * 100), F.lit("% ("), _fixed(last, 4), F.lit(" -> "),
            _fixed(_col("price"), 4), F.lit(")"),
        ),
        details={"pct_change": F.round(move, 5), "previous_price": last},
    )


def _volume_spike(rules: Rules) -> Verdict:
    spike, median = rules.volume_spike, F.col("volume_median")
    ratio = F.when(median > 0, F.col("quantity") / median)
    return Verdict(
        fires=_col("ready") & (median > 0) & (ratio >= spike.median_multiplier),
        severity=_tiers(ratio >= spike.critical_multiplier, "high"),
        score=F.least(F.lit(1.0), ratio / max(spike.critical_multiplier, 1e-9)),
        reason=F.concat(
            F.lit("quantity "), _fixed(_col("quantity"), 2), F.lit(" is "), _fixed(ratio, 1),
            F.lit("x median size "), _fixed(median, 2),
        ),
        details={
            "ratio": F.round(ratio, 2),
            "median_quantity": F.round(median, 4),
            "notional": F.round(_col("price") * _col("quantity"), 2),
        },
    )


def _velocity(rules: Rules) -> Verdict:
    limits, count = rules.velocity, F.col("velocity")
    return Verdict(
        fires=count >= limits.max_trades,
        severity=_tiers(count >= limits.critical_trades, "medium"),
        score=F.least(F.lit(1.0), count / F.lit(float(max(limits.critical_trades, 1)))),
        reason=F.concat(
            count.cast("string"), F.lit(f" trades in {limits.window_seconds:.0f}s (limit {limits.max_trades})")
        ),
        details={"count": count, "window_seconds": F.lit(limits.window_seconds)},
    )


def _spoofing(rules: Rules) -> Verdict:
    spoof, buys, sells = rules.spoofing, F.col("buys"), F.col("sells")
    heavy, light = F.greatest(buys, sells), F.least(buys, sells)
    ratio = heavy / (light + 1).cast("double")
    dominant = F.when(buys >= sells, "buy").otherwise("sell")
    return Verdict(
        fires=(F.col("side_total") >= spoof.min_events) & (ratio >= spoof.imbalance_ratio),
        severity=F.lit("high"),
        score=F.least(F.lit(1.0), ratio / (spoof.imbalance_ratio * 2)),
        reason=F.concat(
            F.lit("one-sided burst: "), heavy.cast("string"), F.lit(" "), dominant, F.lit(" vs "),
            light.cast("string"), F.lit(f" opposite in {spoof.window_seconds:.0f}s (ratio "), _fixed(ratio, 1), F.lit(")"),
        ),
        details={"buys": buys, "sells": sells, "dominant_side": dominant, "ratio": F.round(ratio, 2)},
    )


def self_trade_column() -> Column:
    """The account is its own counterparty; empty strings count as absent."""
    account = F.col("account_id")
    return F.coalesce((account != "") & (account == F.col("counterparty_id")), F.lit(False))


def _wash_trade(rules: Rules) -> Verdict:
    own, match = self_trade_column(), F.col("matched_trade_id")
    account = F.col("account_id")
    seconds = f"{rules.wash_trade.window_seconds:.0f}s"
    return Verdict(
        fires=own | match.isNotNull(),
        severity=F.lit("critical"),
        score=F.when(own, 0.98).otherwise(0.95),
        reason=F.when(
            own,
            F.concat(F.lit("self-trade: account "), account, F.lit(" is both buyer and seller of "), _col("symbol")),
        ).otherwise(
            F.concat(
                F.lit("account "), account, F.lit(" crossed both sides of "), _col("symbol"), F.lit(" at ~"),
                _fixed(_col("price"), 4), F.lit(" x "), _fixed(_col("quantity"), 2), F.lit(f" within {seconds}"),
            )
        ),
        details={
            "account_id": account,
            "signal": F.when(own, "self_counterparty").otherwise("matched_cross"),
            "matched_trade_id": F.when(~own, match),
            "price": _col("price"),
            "quantity": F.when(~own, _col("quantity")),
        },
    )


#: Registration order; it breaks ties when the alerts of a trade are ordered.
BUILT_IN = {
    d.name: d
    for d in (
        Detector("zscore", _zscore, ("price_mean", "price_std")),
        Detector("price_spike", _price_spike, abstains=("previous_price",)),
        Detector("volume_spike", _volume_spike, ("volume_median",)),
        Detector("velocity", _velocity),
        Detector("spoofing", _spoofing),
        Detector("wash_trade", _wash_trade, ("matched_trade_id",)),
    )
}


def enabled_detectors(rules: Rules, extra: Iterable[AnyDetector] = ()) -> list[AnyDetector]:
    on = [d for name, d in BUILT_IN.items() if getattr(rules, name).enabled]
    return [*on, *extra]


def _struct(name: str, position: int, severity: Column, score: Column, reason: Column, details: Column) -> Column:
    return F.struct(
        F.lit(name).alias("detector"),
        severity_rank(severity).alias("rank"),
        F.lit(position).alias("position"),
        severity.alias("severity"),
        clamp_score(score).alias("score"),
        reason.alias("reason"),
        details.alias("details"),
    ).cast(ALERT_DDL)


def alert_of(detector: Detector, position: int, rules: Rules, texts: bool = True) -> Column:
    """The alert of a trade, null where the detector does not fire; without ``texts`` its reason and details are null."""
    v = detector.build(rules)
    details = F.to_json(F.struct(*[c.alias(k) for k, c in v.details.items()]))
    told = (v.reason, details) if texts else (F.lit(None), F.lit(None))
    return F.when(v.fires & v.severity.isNotNull() & v.score.isNotNull(), _struct(detector.name, position, v.severity, v.score, *told))


def _failure(detector: Detector, rules: Rules) -> Column:
    """Whether the detector could not judge a trade."""
    v = detector.build(rules)
    lost = v.fires.isNull() | (v.fires & (v.severity.isNull() | v.score.isNull()))
    return reduce(lambda bad, name: bad & F.col(name).isNotNull(), detector.abstains, lost)


def usable_detectors(
    windows: DataFrame, rules: Rules, detectors: Iterable[AnyDetector]
) -> tuple[list[tuple[int, AnyDetector]], list[str]]:
    """Fail open: a detector whose expression cannot be built or resolved is left out and reported."""
    good, broken = [], []
    for position, detector in enumerate(detectors):
        try:
            if isinstance(detector, PandasDetector):
                windows.select(*detector.columns)
            else:
                windows.select(alert_of(detector, position, rules), *detector.abstains)
            good.append((position, detector))
        except (AnalysisException, ArithmeticError, AttributeError, LookupError, TypeError, ValueError):
            broken.append(detector.name)
    return good, broken


def alert_array(
    windows: DataFrame, rules: Rules, detectors: Iterable[AnyDetector], texts: bool = True
) -> tuple[DataFrame, list[str]]:
    """Add ``alerts``, the alerts of each trade in registration order, and ``failed``, the detectors that could not judge it.

    Also returns the detectors that were left out altogether. Without ``texts`` expressions build no reasons and details:
    Spark builds a whole struct in an array, whatever is read of it.
    """
    with lenient(windows.sparkSession):
        good, broken = usable_detectors(windows, rules, detectors)
        told = {f"_judged_{position}": _judged(d) for position, d in good if isinstance(d, PandasDetector)}
        out = windows.withColumns(told) if told else windows
        fired, failed = [], []
        for position, d in good:
            if isinstance(d, PandasDetector):
                v = F.col(f"_judged_{position}")
                sound = v["severity"].isNotNull() & v["score"].isNotNull()
                fired.append(F.when(v["fires"] & sound, _struct(d.name, position, *(v[c] for c in _JUDGED_COLUMNS[1:]))))
                lost = v["failed"] | (v["fires"] & ~sound)
            else:
                fired.append(alert_of(d, position, rules, texts))
                lost = _failure(d, rules)
            failed.append(F.when(lost, F.lit(d.name)))
        present = lambda items, kind: F.filter(F.array(*items), lambda a: a.isNotNull()) if items else F.array().cast(f"array<{kind}>")
        out = out.withColumns({"alerts": present(fired, ALERT_DDL), "failed": present(failed, "string")})
    return out.drop(*told), broken


def raised_by(windows: DataFrame, name: str, rules: Rules | None = None) -> DataFrame:
    """The trades one detector flags, with severity and score."""
    rules = rules or Rules()
    v = BUILT_IN[name].build(rules)
    return windows.filter(v.fires).withColumns({"severity": v.severity, "score": clamp_score(v.score)})
