"""Rolling activity statistics over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rolling_stats(activity: DataFrame, delay: str = "1 hour", span: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Calls, failures and total duration per tool; rows later than `delay` are dropped.

    Spark reports the dropped rows in the query progress as numRowsDroppedByWatermark.
    """
    return (
        activity.withWatermark("at", delay)
        .groupBy(F.window("at", span, slide), "tool")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(F.col("status") != "ok").alias("failures"),
            F.sum("duration_ms").alias("total_ms"),
        )
        .select(F.col("window.start").alias("window_start"), "tool", "calls", "failures", "total_ms")
    )


def daily_counts(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """Records per UTC day and project from a stream of dated records."""
    return (
        records.filter("event_time is not null").withWatermark("event_time", delay)
        .groupBy(F.window("event_time", "1 day"), "project_id")
        .agg(F.count(F.lit(1)).alias("records"))
        .select(F.to_date("window.start").alias("day"), "project_id", "records")
    )
