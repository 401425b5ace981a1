"""The published views.

With ``approx`` distinct counts are sketches, which need no shuffle of the counted values.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.calendar import local_date, local_hour, local_ts, span_days
from watchloom.functions.constants import LOCAL_ZONE
from watchloom.functions.stages import funnel_stage, safe_ratio
from watchloom.operators.activity import activity, hours
from watchloom.operators.ordering import rank_by_time

_DAY_COLUMNS = [
    "year", "quarter", "month", "month_name", "week_of_year", "day_of_week",
    "day_of_week_num", "is_weekend", "season", "is_danish_holiday",
]


def _distinct(approx: bool, column: str) -> Column:
    """Distinct values, exact or as a sketch of fixed size."""
    return F.approx_count_distinct(column, 0.01) if approx else F.count_distinct(column)


def watch_history(
    events: DataFrame,
    videos: DataFrame,
    channels: DataFrame,
    categories: DataFrame,
    dates: DataFrame,
    zone: str = LOCAL_ZONE,
) -> DataFrame:
    """Every event with video, channel, category and date attributes.

    Events of unknown videos are dropped; the other dimensions are optional.
    """
    described = videos.join(F.broadcast(categories), "category_id", "left").select(
        "video_id", "title", "title_url", "status", "category_name"
    )
    days = dates.withColumnRenamed("date_key", "local_date")
    local = local_ts("watched_at", zone).alias("watched_at_dk")
    joined = (
        events.select("event_id", "video_id", "channel_id", local)
        .withColumn("local_date", F.to_date("watched_at_dk"))
        .join(described, "video_id")
        .join(channels.select("channel_id", "channel_name", "channel_url"), "channel_id", "left")
        .join(days, "local_date", "left")
    )
    return joined.select(
        "event_id",
        "watched_at_dk",
        "video_id", "title", "title_url", "status",
        "channel_name", "channel_url", "category_name",
        *_DAY_COLUMNS,
        F.hour("watched_at_dk").alias("hour"),
    )


def channel_loyalty(
    events: DataFrame, channels: DataFrame, videos: DataFrame, zone: str = LOCAL_ZONE,
    base: DataFrame | None = None, approx: bool = False,
) -> DataFrame:
    """Views, videos, active days and watch span per channel, for known videos."""
    base = base if base is not None else activity(events, zone)
    known = base.join(videos.select("video_id"), "video_id", "left_semi")
    per_channel = known.groupBy("channel_id").agg(
        F.sum("views").alias("total_views"),
        _distinct(approx, "video_id").alias("unique_videos"),
        _distinct(approx, "local_date").alias("active_days"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )
    return per_channel.join(channels, "channel_id").select(
        "channel_name", "channel_url", "total_views", "unique_videos", "active_days",
        local_ts("first_at", zone).alias("first_watched_dk"),
        local_ts("last_at", zone).alias("last_watched_dk"),
    )


def etl_history(log: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Ingest runs, newest first."""
    return log.orderBy(F.desc("run_at")).select(
        "file_name", local_ts("run_at", zone).alias("run_at_dk"), "total_raw_records",
        "ads_filtered", "removed_dropped", "new_events", "duplicate_events", "duration_seconds",
    )


def discovery_events(
    events: DataFrame, channels: DataFrame
) -> DataFrame:
    """Every event with its rank in its channel and its video, and first-time flags.

    Events without channel are ranked together, as one group.
    """
    base = events.select("event_id", "video_id", "channel_id", "watched_at")
    ranked = rank_by_time(
        base, "channel_id", "watched_at", "event_id", "channel_watch_rank"
    )
    ranked = rank_by_time(
        ranked, "video_id", "watched_at", "event_id", "video_watch_rank", source=base
    )
    return ranked.join(
        channels.select("channel_id", "channel_name"), "channel_id", "left"
    ).select(
        "event_id", "video_id", "channel_id", "watched_at", "channel_name",
        "channel_watch_rank", "video_watch_rank",
        (F.col("channel_watch_rank") == 1).alias("is_channel_discovery"),
        (F.col("video_watch_rank") == 1).alias("is_first_watch"),
    )


def daily_summary(
    events: DataFrame, dates: DataFrame, as_of: date | str, zone: str = LOCAL_ZONE,
    base: DataFrame | None = None, approx: bool = False,
) -> DataFrame:
    """Activity per calendar day up to ``as_of``, days without any included."""
    base = base if base is not None else activity(events, zone)
    per_day = base.groupBy(F.col("local_date").alias("date_key")).agg(
        F.sum("views").alias("videos_watched"),
        _distinct(approx, "video_id").alias("unique_videos"),
        _distinct(approx, "channel_id").alias("unique_channels"),
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )
    days = dates.where(F.col("date_key") <= F.lit(as_of).cast("date"))
    return days.join(per_day, "date_key", "left").orderBy("date_key").select(
        "date_key", "year", "quarter", "month", "month_name", "day_of_week", "day_of_week_num",
        "is_weekend", "season", "is_danish_holiday",
        *[
            F.coalesce(c, F.lit(0)).alias(c)
            for c in ("videos_watched", "unique_videos", "unique_channels")
        ],
        local_ts("first_at", zone).alias("first_watch"),
        local_ts("last_at", zone).alias("last_watch"),
    )


def monthly_summary(
    events: DataFrame, dates: DataFrame, as_of: date | str, since: date | str = "2020-01-01",
    zone: str = LOCAL_ZONE, base: DataFrame | None = None, approx: bool = False,
) -> DataFrame:
    """Activity per calendar month, months without any included.

    The events are reduced to months first; only months meet the calendar.
    """
    base = base if base is not None else activity(events, zone)
    days = dates.where(
        F.col("date_key").between(F.lit(since).cast("date"), F.lit(as_of).cast("date"))
    )
    months = days.select("year", "month", "month_name", "season").distinct()
    in_range = base.join(
        days.select(F.col("date_key").alias("local_date"), "year", "month"), "local_date"
    )
    per_month = in_range.groupBy("year", "month").agg(
        F.sum("views").alias("total_views"),
        _distinct(approx, "video_id").alias("unique_videos"),
        _distinct(approx, "channel_id").alias("unique_channels"),
        _distinct(approx, "local_date").alias("active_days"),
    )
    counts = ("total_views", "unique_videos", "unique_channels", "active_days")
    filled = months.join(per_month, ["year", "month"], "left").select(
        "year", "month", "month_name", "season",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )
    return filled.withColumn(
        "avg_videos_per_active_day", safe_ratio(F.col("total_views"), F.col("active_days"))
    ).orderBy("year", "month")


def channel_monthly(
    events: DataFrame, channels: DataFrame, dates: DataFrame, zone: str = LOCAL_ZONE,
    base: DataFrame | None = None, approx: bool = False,
) -> DataFrame:
    """Views and distinct videos per channel and month, for days of the calendar."""
    base = base if base is not None else activity(events, zone)
    days = dates.select(F.col("date_key").alias("local_date"), "year", "month", "month_name")
    per_month = (
        base.where(F.col("channel_id").isNotNull())
        .join(days, "local_date")
        .groupBy("channel_id", "year", "month", "month_name")
        .agg(F.sum("views").alias("views"), _distinct(approx, "video_id").alias("unique_videos"))
    )
    return per_month.join(channels.select("channel_id", "channel_name"), "channel_id").select(
        "channel_id", "channel_name", "year", "month", "month_name", "views", "unique_videos"
    )


def hourly_distribution(
    events: DataFrame, dates: DataFrame, zone: str = LOCAL_ZONE, per_hour: DataFrame | None = None
) -> DataFrame:
    """Views per year, weekday and local hour, for days of the calendar."""
    per_hour = per_hour if per_hour is not None else hours(events, zone)
    days = dates.select("date_key", "year", "day_of_week_num", "day_of_week", "is_weekend")
    return (
        per_hour.join(days, "date_key")
        .groupBy("year", "day_of_week_num", "day_of_week", "is_weekend", "hour")
        .agg(F.sum("views").alias("views"))
    )


def channel_funnel(
    events: DataFrame, channels: DataFrame, zone: str = LOCAL_ZONE, base: DataFrame | None = None, approx: bool = False,
) -> DataFrame:
    """Statistics and loyalty stage of each channel."""
    base = base if base is not None else activity(events, zone)
    per_channel = (
        base.where(F.col("channel_id").isNotNull())
        .groupBy("channel_id")
        .agg(
            F.sum("views").alias("total_views"),
            _distinct(approx, "video_id").alias("unique_videos"),
            _distinct(approx, "local_date").alias("active_days"),
            F.min("first_at").alias("first_watch"),
            F.max("last_at").alias("last_watch"),
        )
        .withColumn("span_days", span_days(F.col("first_watch"), F.col("last_watch")))
    )
    staged = per_channel.withColumn(
        "funnel_stage", funnel_stage(F.col("total_views"), F.col("active_days"), F.col("span_days"))
    )
    return staged.join(channels.select("channel_id", "channel_name"), "channel_id").select(
        "channel_id", "channel_name", "total_views", "unique_videos", "active_days",
        "first_watch", "last_watch", "span_days", "funnel_stage",
    )
