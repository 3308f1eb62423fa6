"""The ledger's columns and the thresholds of the findings."""

from __future__ import annotations

from dataclasses import dataclass

LEDGER = ("statement_id", "source_seq", "date", "narration", "reference", "debit", "credit", "balance")


@dataclass(frozen=True)
class Thresholds:
    tolerance: float = 0.01
    rapid_amount: float = 100_000
    rapid_share: float = 0.8
    rapid_days: int = 1
    bridge_amount: float = 50_000
    bridge_days: int = 3
    bridge_share: float = 0.03
    circle_low: float = 0.90
    circle_high: float = 1.10
    dormant_days: int = 90
    dormant_amount: float = 100_000
    behaviour_times: float = 3
    behaviour_rows: int = 3
    round_amount: float = 50_000
    round_step: float = 10_000
    velocity_rows: int = 15
    critical_amount: float = 1_000_000
    chains: int = 250


DEFAULT = Thresholds()
