"""Thresholds of the telemetry and reconciliation operators; every one can be replaced."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    lat_min: float = 12.90
    lat_max: float = 13.06
    lon_min: float = 77.52
    lon_max: float = 77.68
    rows: int = 4
    cols: int = 4
    watermark_min: int = 10
    idle_alert_min: int = 45
    offline_min: int = 20
    live_min: int = 5
    map_min: int = 10
    max_gap_min: int = 20
    late_grace_min: int = 30
    expense_sla_min: int = 120
    low_margin: float = 0.10
    distance_mismatch: float = 0.15
    invalid_ratio: float = 0.20
    max_speed_kmh: float = 150.0
    base_fare: float = 30.0
    per_km: float = 12.0
    per_min: float = 1.5
    earth_km: float = 6371.0088
    alerts_shown: int = 200
    currency: str = "CU"


DEFAULT = Params()
