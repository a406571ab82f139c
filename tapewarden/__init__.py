"""Trade surveillance on Spark: rolling statistics, detectors, alerts, analytics, evaluation and models."""

from .operators.alerts import candidate_alerts, decisions, engine_stats, run_engine
from .operators.cooldown import cooldown, mark_cooldown
from .operators.detectors import Detector, PandasDetector, Verdict
from .operators.rolling import engine_windows
from .rules import Rules, load_rules
from .schema import TRADE
from .sources.tape import normalise

__all__ = [
    "TRADE",
    "Detector",
    "PandasDetector",
    "Rules",
    "Verdict",
    "candidate_alerts",
    "cooldown",
    "decisions",
    "engine_stats",
    "engine_windows",
    "load_rules",
    "mark_cooldown",
    "normalise",
    "run_engine",
]
