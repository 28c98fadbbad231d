"""An extension: message counts by week and type over a stream, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(week_start, kind, n) of events (ts, kind) in 7-day windows that begin on Mondays, on a stream or a table."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    counts = seen.groupBy(F.window("ts", "7 days", "7 days", "4 days"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_date("window.start").alias("week_start"), "kind", "n")
