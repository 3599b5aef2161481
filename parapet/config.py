"""Settings handed to the builders; nothing here is global state."""

from __future__ import annotations

from dataclasses import dataclass, field

from parapet import fixed_values as fv


@dataclass(frozen=True)
class Weights:
    rule: float = fv.RULE_WEIGHT
    classifier: float = fv.CLASSIFIER_WEIGHT
    drift: float = fv.DRIFT_WEIGHT
    cascade: float = fv.CASCADE_WEIGHT


@dataclass(frozen=True)
class Thresholds:
    rule: float = fv.RULE_THRESHOLD
    classifier: float = fv.CLASSIFIER_THRESHOLD
    drift: float = fv.DRIFT_THRESHOLD
    cascade: float = fv.CASCADE_THRESHOLD
    fused: float = fv.FUSED_THRESHOLD


@dataclass(frozen=True)
class Scale:
    """How far work is split before one task sees it.

    ``rows_per_bucket`` bounds the rows one ordered-window task works on.
    """

    rows_per_bucket: int = 1_000_000


@dataclass(frozen=True)
class ScreeningConfig:
    weights: Weights = field(default_factory=Weights)
    thresholds: Thresholds = field(default_factory=Thresholds)
    scale: Scale = field(default_factory=Scale)
    history_length: int = fv.HISTORY_LENGTH
    base_share: float = fv.BASE_SHARE
    history_share: float = fv.HISTORY_SHARE
    queue_length: int = fv.QUEUE_LENGTH
    periodic_rule: bool = True


DEFAULT = ScreeningConfig()
