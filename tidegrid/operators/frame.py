"""Series in flight: points by offset from the start, and what is known of each series."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Frame:
    """``points``: (sid, off, value, confidence). ``series``: (sid, path, tags).

    ``rms`` and ``n`` (points a series) are known to the driver; off runs from 0 to
    n - 1. ``start_ms`` is where off 0 is shown, whatever time it was read from.
    """

    points: DataFrame
    series: DataFrame
    rms: int
    start_ms: int
    n: int

    def with_points(self, points: DataFrame, **changed) -> "Frame":
        return replace(self, points=points, **changed)


@dataclass(frozen=True)
class Histograms:
    """``points``: (sid, off, lo, unit, cnt), a row for each bucket of each window; lo is null where nothing was recorded."""

    points: DataFrame
    series: DataFrame
    rms: int
    start_ms: int
    n: int
