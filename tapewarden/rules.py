"""Detection rules: frozen dataclasses that become literals in Spark plans."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, get_type_hints

# The default thresholds every dialect of the rules agrees on.


@dataclass(frozen=True)
class WindowRules:
    max_trades: int = 200
    min_trades: int = 20
    horizon_seconds: float = 300.0


@dataclass(frozen=True)
class ZScoreRules:
    enabled: bool = True
    price_threshold: float = 3.0
    critical_multiplier: float = 1.6


@dataclass(frozen=True)
class PriceSpikeRules:
    enabled: bool = True
    pct_threshold: float = 0.03
    critical_pct: float = 0.08


@dataclass(frozen=True)
class VolumeSpikeRules:
    enabled: bool = True
    median_multiplier: float = 6.0
    critical_multiplier: float = 15.0


@dataclass(frozen=True)
class VelocityRules:
    enabled: bool = True
    window_seconds: float = 5.0
    max_trades: int = 25
    critical_trades: int = 60


@dataclass(frozen=True)
class SpoofingRules:
    enabled: bool = True
    window_seconds: float = 3.0
    imbalance_ratio: float = 5.0
    min_events: int = 8


@dataclass(frozen=True)
class WashTradeRules:
    enabled: bool = True
    window_seconds: float = 5.0
    price_tolerance: float = 0.001
    quantity_tolerance: float = 0.02


@dataclass(frozen=True)
class IsolationForestRules:
    enabled: bool = True
    train_size: int = 300
    retrain_every: int = 150
    contamination: float = 0.02
    score_threshold: float = 0.62


@dataclass(frozen=True)
class GuardrailRules:
    max_price: float = 1e9
    max_quantity: float = 1e12
    max_notional: float = 1e13
    max_symbol_cardinality: int = 10_000
    require_symbol_pattern: bool = True


@dataclass(frozen=True)
class Rules:
    """The whole ruleset; ``alert_cooldown_seconds = 0`` turns de-duplication off."""

    alert_cooldown_seconds: float = 8.0
    window: WindowRules = field(default_factory=WindowRules)
    zscore: ZScoreRules = field(default_factory=ZScoreRules)
    price_spike: PriceSpikeRules = field(default_factory=PriceSpikeRules)
    volume_spike: VolumeSpikeRules = field(default_factory=VolumeSpikeRules)
    velocity: VelocityRules = field(default_factory=VelocityRules)
    spoofing: SpoofingRules = field(default_factory=SpoofingRules)
    wash_trade: WashTradeRules = field(default_factory=WashTradeRules)
    isolation_forest: IsolationForestRules = field(default_factory=IsolationForestRules)

    def replace(self, **blocks: Any) -> Rules:
        """A copy with some blocks changed, e.g. ``rules.replace(zscore={"price_threshold": 4})``."""
        changed = {
            name: dataclasses.replace(getattr(self, name), **value) if isinstance(value, dict) else value
            for name, value in blocks.items()
        }
        return dataclasses.replace(self, **changed)


def _coerce(value: Any, wanted: type) -> Any:
    if wanted is bool:
        if not isinstance(value, bool):
            raise ValueError(f"expected a boolean, got {value!r}")
        return value
    if wanted is int and float(value) != int(value):
        raise ValueError(f"expected a whole number, got {value!r}")
    return wanted(value)


def _block(cls: type, raw: dict[str, Any]) -> Any:
    hints = get_type_hints(cls)
    return cls(**{k: _coerce(v, hints[k]) for k, v in raw.items() if k in hints})


def rules_from_dict(raw: dict[str, Any] | None) -> Rules:
    """Build rules from nested mappings; missing blocks and keys keep their defaults."""
    hints = get_type_hints(Rules)
    built: dict[str, Any] = {}
    for name, value in (raw or {}).items():
        if name not in hints:
            continue
        built[name] = _block(hints[name], value or {}) if dataclasses.is_dataclass(hints[name]) else float(value)
    return Rules(**built)


def load_rules(path: str | Path | None = None) -> Rules:
    """Read a YAML or JSON ruleset; no path or a missing file gives the defaults."""
    if path is None or not Path(path).exists():
        return Rules()
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return rules_from_dict(json.loads(text))
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover - optional dependency
        raise RuntimeError("reading a YAML ruleset needs PyYAML; use a .json ruleset instead") from exc
    return rules_from_dict(yaml.safe_load(text))


def micros(seconds: float) -> int:
    """A duration in whole microseconds, the unit of every event-time frame."""
    return round(seconds * 1_000_000)
