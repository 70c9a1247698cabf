"""Defaults of the operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values: thresholds, limits, rates and seeds
    delivered_status: str = "delivered"
    min_seller_orders: int = 50
    churn_high_days: int = 180
    churn_medium_days: int = 90
    late_high_pct: float = 50
    late_medium_pct: float = 25
    top_categories: int = 15
    top_sellers: int = 20
    cohort_start: str = "2017-01-01"
    cohort_max_month: int = 6
    score_bands: int = 5
    winback_rate_pct: int = 15
    winback_high_rate_pct: int = 25
    high_value_spend: int = 500
    high_value_rate_pct: int = 20
    anomaly_z: float = 2.0
    test_size: float = 0.2
    seed: int = 42
    cv_folds: int = 5
    horizon_days: int = 90
    interval_level: float = 0.95


DEFAULTS = Params()
