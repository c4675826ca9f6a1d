"""Settings, validated on the driver before any plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Rows of one series that a single task may order at a time.
CHUNK = 1 << 16
# Rows of many short series that a single task orders at a time.
TASK_ROWS = 1 << 20


@dataclass(frozen=True)
class SegmentSettings:
    """Segmentation settings; the defaults are fixed values of the behaviour we match."""

    rate: int = 8000
    window_samples: int = 400
    smoothing_windows: int = 5
    margin_db: float = 6.0
    min_gap_seconds: float = 0.75
    max_gap_seconds: float = 15.0
    min_track_seconds: float = 30.0
    active_run_seconds: float = 0.45
    lead_in_seconds: float = 8.0
    tail_seconds: float = 20.0
    auto_score: float = 0.55
    waveform_points: int = 4000
    chunk: int = CHUNK

    def __post_init__(self) -> None:
        numbers = (
            self.margin_db, self.min_gap_seconds, self.max_gap_seconds, self.min_track_seconds,
            self.active_run_seconds, self.lead_in_seconds, self.tail_seconds, self.auto_score,
        )
        if any(not math.isfinite(n) or n < 0 for n in numbers):
            raise ValueError("settings must be finite and not negative")
        if self.rate <= 0 or self.window_samples <= 0 or self.smoothing_windows <= 0 or self.chunk <= 0:
            raise ValueError("rate, window, smoothing and chunk must be positive")
        if self.max_gap_seconds < self.min_gap_seconds:
            raise ValueError("max gap is below min gap")

    @property
    def window_seconds(self) -> float:
        return self.window_samples / self.rate

    @property
    def min_gap_windows(self) -> int:
        return max(1, math.ceil(self.min_gap_seconds / self.window_seconds))

    @property
    def active_run_windows(self) -> int:
        return max(1, math.ceil(self.active_run_seconds / self.window_seconds))

    @property
    def bridge_windows(self) -> int:
        return max(1, round(0.25 / self.window_seconds))

    @property
    def context_windows(self) -> int:
        return max(1, round(1.0 / self.window_seconds))
