"""Thresholds of the analytics. Prices and quantities are integer ticks of 1e-8; times are milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

SCALE = 100_000_000


@dataclass(frozen=True)
class Config:
    # The defaults for a perpetual contract with a tick of 0.10.
    version: str = "phase4-v1"
    tick: int = SCALE // 10
    large_trade: int = 5 * SCALE
    sweep_window: int = 100
    sweep_levels: int = 3
    sweep_volume: int = 5 * SCALE
    absorption_window: int = 1_000
    absorption_volume: int = 20 * SCALE
    absorption_trades: int = 5
    absorption_excursion: int = 3  # contract ticks
    replenishment_window: int = 250
    depth: int = 10
    snapshot_interval: int = 1_000
    intervals: tuple[int, ...] = (100, 1_000, 5_000, 60_000)
    cell: int = 1_000
    retention: int = 900_000
    cluster_gap: int = 100
    cluster_range: int = 3  # contract ticks
    confidence: float = 0.5
    dedup_window: int = 4096


DEFAULT = Config()
