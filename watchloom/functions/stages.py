"""Channel loyalty stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def funnel_stage(views: Column, active_days: Column, span: Column) -> Column:
    """Discovery, Casual, Regular or Loyal; what fits none of them is Casual."""
    return (
        F.when(views == 1, "Discovery")
        .when(views.between(2, 5), "Casual")
        .when(views.between(6, 20) & (active_days >= 3), "Regular")
        .when((views > 20) & (active_days >= 7) & (span >= 30), "Loyal")
        .otherwise("Casual")
    )


def safe_ratio(numerator: Column, denominator: Column, digits: int = 1) -> Column:
    """Rounded decimal ratio, NULL when the denominator is zero."""
    ratio = numerator.cast("decimal(20,0)") / F.nullif(denominator, F.lit(0)).cast("decimal(20,0)")
    return F.round(ratio, digits)
