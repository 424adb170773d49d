"""Star queries over streams: a streamed fact joined to batch dimensions.

The operators of :mod:`quillspark.operators` take a streaming fact as it is;
aggregates over event time need the watermark set here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.star import Agg


def windowed(events: DataFrame, time: str, window: str, aggs: list[Agg], group_by: list[str] = (), late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Aggregates by event-time window, rows later than ``late`` dropped by the watermark of a stream."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    rows = events.withWatermark(time, late).groupBy(span.alias("w"), *group_by)
    return rows.agg(*(a.build() for a in aggs)).select(F.col("w.start").alias("window_start"), *group_by, *(a.alias for a in aggs))
