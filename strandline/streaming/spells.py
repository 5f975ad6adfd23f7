"""Active intervals of a stream: events within a gap make one session, by Spark's session windows and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """key, start, end, events of runs of events (batch or stream) at most `gap` apart. Events later than `late` behind the newest are dropped from a stream."""
    rows = events.select(F.col(key), F.col(ts).cast("timestamp").alias("at"))
    if events.isStreaming:
        rows = rows.withWatermark("at", late)
    g = rows.groupBy(F.col(key), F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
