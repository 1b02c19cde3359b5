"""Extension: the session log as a stream. The library itself has no streams; this is the same statistic kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.activity import session_type


def focus_by_window(sessions: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Completed work by window of the start time; repeated deliveries of a session within the watermark count once."""
    once = sessions.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["id"])
    work = once.filter(F.col("completed") & (session_type() == "work"))
    counted = work.groupBy(F.window("started_at", window)).agg(F.count("*").alias("completed_count"), F.sum("duration_sec").alias("focused_seconds"))
    return counted.select(F.col("window.start").alias("window_start"), "completed_count", "focused_seconds")
