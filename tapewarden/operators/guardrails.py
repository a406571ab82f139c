"""Sanity checks on incoming trades: first failing check wins, every rejection has a code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import GuardrailRules

# Fixed value: the symbol policy.
SYMBOL_PATTERN = r"^[A-Z0-9][A-Z0-9._\-]{0,31}$"


def _finite(name: str) -> Column:
    value = F.col(name)
    return ~(F.isnan(value) | (F.abs(value) == float("inf")))


def guardrail_code(rules: GuardrailRules | None = None) -> Column:
    """Code of the first failed check, null for a trade that passes them all."""
    rules = rules or GuardrailRules()
    code = F.when(~(_finite("price") & _finite("quantity")), "non_finite")
    if rules.require_symbol_pattern:
        code = code.when(~F.col("symbol").rlike(SYMBOL_PATTERN), "bad_symbol")
    return (
        code.when(F.col("price") > rules.max_price, "price_bound")
        .when(F.col("quantity") > rules.max_quantity, "qty_bound")
        .when(F.col("price") * F.col("quantity") > rules.max_notional, "notional_bound")
    )


# Codes and texts of rejections.


def guardrail_reason(code: Column, rules: GuardrailRules | None = None) -> Column:
    rules = rules or GuardrailRules()
    return (
        F.when(code == "non_finite", "non-finite price or quantity")
        .when(code == "bad_symbol", F.concat(F.lit("symbol '"), "symbol", F.lit("' fails format policy")))
        .when(
            code == "price_bound",
            F.concat(F.lit("price "), F.col("price").cast("string"), F.lit(f" exceeds max {rules.max_price}")),
        )
        .when(
            code == "qty_bound",
            F.concat(F.lit("quantity "), F.col("quantity").cast("string"), F.lit(f" exceeds max {rules.max_quantity}")),
        )
        .when(
            code == "notional_bound",
            F.concat(
                F.lit("notional "), F.format_string("%.0f", F.col("price") * F.col("quantity")), F.lit(" exceeds max")
            ),
        )
        .when(code == "cardinality", "symbol cardinality limit reached")
    )


def admitted_symbols(passing: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` distinct symbols by arrival.

    First arrivals are a partial aggregate and the cut is a top-k, so only
    ``limit`` rows ever meet in one place. Arrival ties break on the symbol.
    """
    first_seen = passing.groupBy("symbol").agg(F.min(F.struct("event_us", "trade_id")).alias("first_seen"))
    return first_seen.orderBy("first_seen", "symbol").limit(limit).select("symbol")


def guardrails(trades: DataFrame, rules: GuardrailRules | None = None) -> DataFrame:
    """Add ``ok``, ``code`` and ``reason``. Needs ``event_us`` and ``trade_id`` for the arrival order."""
    rules = rules or GuardrailRules()
    checked = trades.withColumn("_code", guardrail_code(rules))
    admitted = admitted_symbols(checked.filter(F.col("_code").isNull()), rules.max_symbol_cardinality)
    known = admitted.withColumn("_known", F.lit(True))
    code = F.coalesce("_code", F.when(F.col("_known").isNull(), "cardinality"))
    out = checked.join(known, "symbol", "left").withColumn("code", code).drop("_code", "_known")
    return out.withColumns({"ok": F.col("code").isNull(), "reason": guardrail_reason(F.col("code"), rules)})


def split_rejects(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; the rejected rows keep code and reason for the audit trail."""
    return checked.filter("ok").drop("ok", "code", "reason"), checked.filter("not ok").drop("ok")
