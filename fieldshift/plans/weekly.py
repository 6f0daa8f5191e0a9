"""The weekly report: one base frame feeding five panels."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from fieldshift.operators import panels


def weekly_report(frame: DataFrame) -> dict[str, DataFrame]:
    """Unit and element panels, diversity, drift and novelty of one base frame.

    ``frame`` also carries the standardised embedding. It is read five times,
    so it is kept (spilling to disk) until the caller unpersists it.
    """
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    units = panels.unit_panel(frame)
    return {
        "frame": frame,
        "unit_panel": units,
        "element_panel": panels.element_panel(frame),
        "entropy": panels.period_entropy(units),
        "drift": panels.centroid_drift(frame),
        "novelty": panels.period_novelty(frame),
    }
