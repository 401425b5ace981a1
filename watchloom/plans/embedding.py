"""Embedding job."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions.text import input_text
from watchloom.operators.encoders import NO_TEXT, Encoder
from watchloom.operators.upserts import flag_failed, missing, upsert_embeddings
from watchloom.session import materialize
from watchloom.sources.store import Store, retried


def candidates(videos: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Active videos without a row of embeddings; a recorded failure counts as a row."""
    return missing(videos.where(F.col("status") == "active"), embeddings, ["video_id"])


def video_texts(videos: DataFrame) -> DataFrame:
    return videos.select(
        "video_id",
        input_text(F.col("title"), F.col("tags"), F.col("description")).alias("text"),
    )


def embed(texts: DataFrame, encoder: Encoder) -> DataFrame:
    """(video_id, embedding, error): blank texts are reported as errors, not encoded."""
    return encoder.encode(texts).select("video_id", "embedding", "error")


def embed_videos(
    store: Store, encoder: Encoder, now: datetime | None = None
) -> dict[str, int]:
    """Embeds what is new, records failures, logs the run.

    If the stored vectors changed meanwhile, the new ones are put to them as they are then; nothing is encoded twice.
    """
    began = time.monotonic()
    at = now or datetime.now(UTC).replace(tzinfo=None)
    stamp = F.lit(at).cast("timestamp_ntz")
    start = store.snapshot()
    todo = video_texts(candidates(store.read("dim_videos", start), store.read("nlp_embeddings", start)))

    # Encoding is the expensive step: keep its result in the shared folder and read it twice.
    done = materialize(embed(todo, encoder), "vectors")

    fresh = done.where("error is null").select(
        "video_id", "embedding",
        F.lit(encoder.name).alias("model_name"),
        F.lit(encoder.version).alias("model_version"),
        stamp.alias("created_at"),
    )
    failed = done.where("error is not null").select("video_id")

    tally = done.agg(
        F.count(F.lit(1)).alias("targeted"),
        F.count_if(F.col("error").isNull()).alias("embedded"),
        F.count_if(F.col("error") == NO_TEXT).alias("skipped"),
        F.count_if(F.col("error") != NO_TEXT).alias("failed"),
    ).first().asDict()
    log = store.spark.createDataFrame(
        [(at, encoder.name, encoder.version, tally["targeted"], tally["embedded"],
          tally["failed"], tally["skipped"], round(time.monotonic() - began, 2))],
        "run_at timestamp_ntz, model_name string, model_version string, videos_targeted bigint, "
        "videos_embedded bigint, videos_failed bigint, videos_skipped bigint, "
        "duration_seconds double",
    )
    log_folder = store.stage("embed_log", log)

    def put() -> None:
        before = store.snapshot()
        old = store.read("nlp_embeddings", before)
        merged = flag_failed(upsert_embeddings(old, fresh), failed, encoder.name, encoder.version, stamp)
        store.publish(
            replace={"nlp_embeddings": store.stage("nlp_embeddings", merged)}, append={"embed_log": log_folder}, based_on=before
        )

    retried(put)
    return tally
