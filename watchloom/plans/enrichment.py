"""Video metadata from landed responses."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.constants import REQUEST_SIZE, REQUESTS_PER_DAY
from watchloom.operators.ordering import batch_number, quota_head
from watchloom.operators.upserts import missing, update_from
from watchloom.sources.store import Store, retried

METADATA_FIELDS = [
    "description", "tags", "category_id", "duration_seconds", "view_count", "like_count",
]


def candidates(videos: DataFrame) -> DataFrame:
    """Active videos that have not been enriched."""
    return videos.where((F.col("status") == "active") & F.col("enriched_at").isNull())


def request_batches(
    videos: DataFrame, size: int = REQUEST_SIZE, requests: int = REQUESTS_PER_DAY
) -> DataFrame:
    """The ids the daily quota allows, numbered, in batches of ``size``."""
    head = quota_head(candidates(videos).select("video_id"), ["video_id"], size * requests)
    return batch_number(head, ["video_id"], size)


def apply_metadata(videos: DataFrame, metadata: DataFrame, now: Column) -> DataFrame:
    """Sets the metadata fields and both time stamps of the videos that were returned."""
    stamped = metadata.withColumns({"enriched_at": now, "updated_at": now})
    return update_from(videos, stamped, "video_id", [*METADATA_FIELDS, "enriched_at", "updated_at"])


def attempts(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """video_id and answered of ``batches`` (video_id, batch).

    ``responses`` (file_name, answered) are files with ``batch-<number>`` in their names; a batch
    is answered if one of its responses is.
    """
    number = F.regexp_extract("file_name", r"batch-(\d+)", 1)
    known = responses.groupBy(F.nullif(number, F.lit("")).cast("bigint").alias("batch")).agg(
        F.bool_or("answered").alias("answered")
    )
    return batches.join(known, "batch", "left").select(
        "video_id", F.coalesce("answered", F.lit(False)).alias("answered")
    )


def answered(attempted: DataFrame) -> DataFrame:
    return attempted.where("answered") if "answered" in attempted.columns else attempted


def flip_missing(
    videos: DataFrame, attempted: DataFrame, metadata: DataFrame, now: Column
) -> DataFrame:
    """Videos that were asked for but not returned become unavailable.

    Those whose request failed stay as they are: rows of ``attempted`` (video_id and, if some
    requests failed, answered) that are not answered flip nothing.
    """
    gone = (
        missing(answered(attempted).select("video_id").distinct(), metadata, ["video_id"])
        .withColumns({"status": F.lit("unavailable"), "updated_at": now})
    )
    return update_from(videos, gone, "video_id", ["status", "updated_at"])


def field_coverage(videos: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Filled values and their share per metadata field, over active videos; one pass.

    An empty tag list counts as not filled.
    """
    fields = fields or METADATA_FIELDS
    active = videos.where(F.col("status") == "active")

    def filled(name: str) -> Column:
        value = F.col(name)
        return F.size(value) > 0 if name == "tags" else value.isNotNull()

    counted = active.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(filled(c)).alias(c) for c in fields]
    )
    return counted.unpivot(["_n"], fields, "field", "populated").select(
        "field",
        "populated",
        F.round(
            F.col("populated").cast("decimal(20,0)") * 100
            / F.nullif(F.col("_n"), F.lit(0)).cast("decimal(20,0)"),
            1,
        ).alias("coverage"),
    )


def enrich(
    store: Store, metadata: DataFrame, attempted: DataFrame, now: datetime | None = None
) -> dict[str, int]:
    """Applies landed responses to the video snapshot and logs the run.

    Only candidates among the attempted videos are flipped, and only if their request was
    answered; the others are reported as unanswered and stay candidates. If the videos changed meanwhile, the
    responses are applied to them as they are then.
    """
    return retried(lambda: _enrich(store, metadata, attempted, now))


def _enrich(store: Store, metadata: DataFrame, attempted: DataFrame, now: datetime | None) -> dict[str, int]:
    began = time.monotonic()
    at = now or datetime.now(UTC).replace(tzinfo=None)
    stamp = F.lit(at).cast("timestamp_ntz")
    before = store.snapshot()
    videos = store.read("dim_videos", before)
    targeted = candidates(videos).count()
    failed = {}
    if "answered" in attempted.columns:
        failed = {"unanswered": attempted.where("NOT answered").select("video_id").distinct().count()}
    attempted = answered(attempted).join(candidates(videos).select("video_id"), "video_id", "left_semi")
    updated = flip_missing(apply_metadata(videos, metadata, stamp), attempted, metadata, stamp)
    folder = store.stage("dim_videos", updated)

    asked = attempted.select("video_id").distinct()
    tally = asked.join(
        metadata.select("video_id").withColumn("_hit", F.lit(True)), "video_id", "left"
    ).agg(
        F.count_if(F.col("_hit")).alias("enriched"),
        F.count_if(F.col("_hit").isNull()).alias("flipped"),
        F.ceil(F.count(F.lit(1)) / REQUEST_SIZE).alias("units"),
    ).first()
    log = store.spark.createDataFrame(
        [(at, targeted, tally["enriched"], tally["flipped"], tally["units"],
          round(time.monotonic() - began, 2))],
        "run_at timestamp_ntz, videos_targeted bigint, videos_enriched bigint, "
        "videos_flipped bigint, api_units_used bigint, duration_seconds double",
    )
    store.publish(
        replace={"dim_videos": folder},
        append={"enrichment_log": store.stage("enrichment_log", log)},
        based_on=before,
    )
    return {
        "targeted": targeted,
        "enriched": tally["enriched"],
        "flipped": tally["flipped"],
        "remaining": targeted - tally["enriched"] - tally["flipped"],
        **failed,
    }
