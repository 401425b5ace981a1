"""The common base of the published views: views per local day, channel and video."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions.calendar import local_date, local_hour
from watchloom.functions.constants import LOCAL_ZONE


def with_local_date(events: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    return events.withColumn("local_date", local_date("watched_at", zone))


def activity(events: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """One row per (local_date, channel_id, video_id): views, first_at, last_at.

    Repeated views collapse in the map tasks, so a key with many events reaches the later
    distinct counts as few rows.
    """
    day = events["local_date"] if "local_date" in events.columns else local_date("watched_at", zone)
    return (
        events.select(day.alias("local_date"), "channel_id", "video_id", "watched_at")
        .groupBy("local_date", "channel_id", "video_id")
        .agg(
            F.count(F.lit(1)).alias("views"),
            F.min("watched_at").alias("first_at"),
            F.max("watched_at").alias("last_at"),
        )
    )


def merged_activity(parts: DataFrame) -> DataFrame:
    """``activity`` of all events from that of several sets of them."""
    return parts.groupBy("local_date", "channel_id", "video_id").agg(
        F.sum("views").alias("views"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


def hours(events: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """One row per local day and hour (date_key, hour): views."""
    return events.groupBy(
        local_date("watched_at", zone).alias("date_key"), local_hour("watched_at", zone).alias("hour")
    ).agg(F.count(F.lit(1)).alias("views"))


def merged_hours(parts: DataFrame) -> DataFrame:
    return parts.groupBy("date_key", "hour").agg(F.sum("views").alias("views"))
