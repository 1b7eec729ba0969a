"""Structured Streaming forms of two operators (additions; the batch forms are the reference for results)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P


def count_paths_stream(records: DataFrame, path: str = "path") -> DataFrame:
    """path, n in update or complete mode; state grows with the distinct paths only."""
    return records.filter(F.size(path) > 0).groupBy(P.canonical(F.col(path)).alias("path")).agg(F.count("*").alias("n"))


def window_loads_stream(events: DataFrame, time: str = "ts", size: str = "50 seconds", step: str = "40 seconds", late: str = "10 minutes") -> DataFrame:
    """Events in overlapping windows, with a watermark for late ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
