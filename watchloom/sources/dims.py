"""Dimensions that are generated rather than read."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.calendar import date_attributes
from watchloom.functions.constants import CATEGORIES

# Beyond this many days the calendar is joined without a broadcast hint.
MAX_BROADCAST_DAYS = 200_000


def dim_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category_id int, category_name string")


def dim_date(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """One row per day from ``start`` to ``end``, with its attributes.

    The row count is known from the two arguments, so the broadcast is of proven size.
    """
    first, last = _day(start), _day(end)
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("date_key")
    )
    out = days.select("date_key", *date_attributes(F.col("date_key")))
    return F.broadcast(out) if (last - first).days < MAX_BROADCAST_DAYS else out


def _day(d: date | str) -> date:
    return date.fromisoformat(d) if isinstance(d, str) else d
