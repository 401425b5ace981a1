"""Metadata fields: durations and numbers that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = r"\AP(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?\z"
_UNIT_SECONDS = (86_400, 3_600, 60, 1)


def iso_seconds(c: Column) -> Column:
    """Seconds of an ISO 8601 duration in days, hours, minutes, seconds; NULL otherwise."""
    total = F.lit(0).cast("bigint")
    for group, seconds in enumerate(_UNIT_SECONDS, start=1):
        digits = F.nullif(F.regexp_extract(c, _DURATION, group), F.lit(""))
        total = total + F.coalesce(digits.try_cast("bigint"), F.lit(0)) * seconds
    return F.when(c.rlike(_DURATION), total)


def number_or_null(c: Column, to: str = "bigint") -> Column:
    return c.try_cast(to)
