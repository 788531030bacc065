"""Parameters that change results, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConf:
    max_pages: int = 100
    max_discovered: int = 500
    interval_hours: int = 24
    min_interval_hours: int = 6
    max_interval_hours: int = 168
    bulk_change_percent: int = 1
    drift_threshold: int = 30
    cooldown_hours: int = 2
    relevance_batch: int = 25
    significance_batch: int = 10
    fingerprint_chars: int = 10_000
    diff_chars: int = 10_000
    min_page_chars: int = 50
    min_visible_chars: int = 500
    progress_ttl_seconds: int = 3600
    full_checks_per_run: int = 100
    light_checks_per_run: int = 500
    light_run_seconds: int = 60
    light_interval_seconds: int = 300
    empty_map_is_error: bool = True


CONF = EngineConf()
