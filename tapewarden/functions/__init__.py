from .columns import (
    SEVERITY_RANK,
    clamp_score,
    event_micros,
    event_seconds,
    normalise_symbol,
    notional,
    severity_rank,
    with_defaults,
)

__all__ = [
    "SEVERITY_RANK",
    "clamp_score",
    "event_micros",
    "event_seconds",
    "normalise_symbol",
    "notional",
    "severity_rank",
    "with_defaults",
]
