"""The profile that date rules depend on; handed to every operator that needs it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """timezone of day buckets; first day of the record; days after which a day is final; whole weeks or days."""

    timezone: str = "UTC"
    window_start: str = "1992-01-01"
    finalize_after_days: int = 30
    import_weeks: str = "complete"
