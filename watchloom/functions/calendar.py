"""Local time, date attributes and time differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions.constants import FIXED_HOLIDAYS, LOCAL_ZONE


def local_ts(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock of ``zone`` for a UTC time, daylight saving included."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts))


def local_date(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.to_date(local_ts(ts, zone))


def local_hour(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.hour(local_ts(ts, zone))


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a UTC time."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def minutes_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(60_000_000.0)


def span_days(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(86_400_000_000.0)


def day_of_week_num(day: Column) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(day) - F.lit(1)


def season(day: Column) -> Column:
    month = F.month(day)
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
    )


def is_fixed_holiday(day: Column) -> Column:
    codes = [m * 100 + d for m, d in FIXED_HOLIDAYS]
    return (F.month(day) * 100 + F.dayofmonth(day)).isin(codes)


def date_attributes(day: Column) -> list[Column]:
    """The attributes of the date dimension, in order."""
    return [
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.weekofyear(day).alias("week_of_year"),
        F.dayofmonth(day).alias("day_of_month"),
        day_of_week_num(day).alias("day_of_week_num"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        day_of_week_num(day).isin(0, 6).alias("is_weekend"),
        season(day).alias("season"),
        is_fixed_holiday(day).alias("is_danish_holiday"),
    ]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
