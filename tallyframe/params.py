"""Every tunable of the marts and analytics, with its default."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    transfer_window_days: int = 3
    order_match_window_days: int = 5
    embedding_model: str = "default"
    embedding_threshold: float = 0.80
    classifier_model: str = "default"
    classifier_threshold: float = 0.50
    known_cities: tuple[str, ...] = ()
    #: Cadence: inclusive range of the average gap in days; the first that holds wins.
    cadences: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {"weekly": (5, 9), "biweekly": (12, 16), "monthly": (25, 35), "quarterly": (80, 100), "yearly": (350, 380)}
    )
    regularity: float = 0.25
    min_occurrences: int = 3
    min_history: int = 6
    horizon: int = 3
    max_horizon: int = 6
    interval_level: int = 80
    interval_floor: float = 0.5
    trend_share: float = 0.10
    history_months: int = 36
    anomaly_z: float = 3.5
    anomaly_amount: float = 50.0
    anomaly_months: int = 3
    merge_threshold: float = 0.90
    row_limit: int = 500
    timeout_s: float = 30.0
