"""Keyed changes to snapshots: insert-only, update-from, flags, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(wanted: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` whose key ``present`` lacks."""
    return wanted.join(present.select(*on), list(on), "left_anti")


def update_from(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``old`` with ``columns`` taken from the matching row of ``new``, NULLs included.

    Of several rows of ``new`` for a key the largest by ``columns``, in their order, counts.
    """
    changes = (
        new.groupBy(key)
        .agg(F.max(F.struct(*columns)).alias("_new"))
        .select(key, F.lit(True).alias("_hit"), *[F.col(f"_new.{c}").alias(f"_new_{c}") for c in columns])
    )
    joined = old.join(changes, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in old.columns
        ]
    )


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Success rows of ``new`` replace vector and model, and clear an earlier failure."""
    columns = ["embedding", "model_name", "model_version", "created_at"]
    fresh = new.select(
        "video_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = old.join(fresh, "video_id", "full_outer")
    hit = F.coalesce("_hit", F.lit(False))
    return joined.select(
        "video_id",
        *[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        F.when(~hit, F.col("embed_failed_at")).alias("embed_failed_at"),
    )


def flag_failed(
    old: DataFrame, failed: DataFrame, model_name: str, model_version: str, now: Column
) -> DataFrame:
    """Marks ``failed`` ids; a vector that is already there stays."""
    flagged = failed.select("video_id").distinct().withColumn("_failed", F.lit(True))
    joined = old.withColumn("_old", F.lit(True)).join(flagged, "video_id", "full_outer")
    known = F.coalesce("_old", F.lit(False))
    return joined.select(
        "video_id",
        "embedding",
        F.when(known, F.col("model_name")).otherwise(F.lit(model_name)).alias("model_name"),
        F.when(known, F.col("model_version")).otherwise(F.lit(model_version)).alias("model_version"),
        F.when(known, F.col("created_at")).otherwise(now).alias("created_at"),
        F.when(F.col("_failed"), now).otherwise(F.col("embed_failed_at")).alias("embed_failed_at"),
    )


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def append_assignments(old: DataFrame, new: DataFrame) -> DataFrame:
    """New (video, topic) pairs with full score; pairs already stored are left out."""
    on = ["video_id", "topic_id"]
    return (
        missing(new.select(*on).distinct(), old, on).withColumn("score", F.lit(1.0))
    )
