"""Sessions per viewer on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchloom.functions.constants import SESSION_GAP_MINUTES


def viewer_sessions(
    events: DataFrame,
    viewer: str = "viewer",
    ts: str = "watched_at",
    gap_minutes: int = SESSION_GAP_MINUTES,
    watermark: str | None = None,
) -> DataFrame:
    """Sessions per viewer, for a stream or a batch: count, first and last event.

    A gap of exactly ``gap_minutes`` keeps a session open, as in the batch view.
    """
    # A watermark needs an instant; the session zone is UTC, so the two casts are inverse.
    instants = events.withColumn(ts, F.col(ts).cast("timestamp"))
    source = instants.withWatermark(ts, watermark) if watermark else instants
    return (
        source.groupBy(viewer, F.session_window(ts, f"{gap_minutes} minutes").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("video_count"),
            F.min(ts).cast("timestamp_ntz").alias("session_start"),
            F.max(ts).cast("timestamp_ntz").alias("session_end"),
        )
        .drop("w")
    )


def write_sessions(
    sessions: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Writes closed sessions (``append``) or, for small states, all of them (``complete``)."""
    writer = sessions.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "complete":
        writer = writer.foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(path)
        )
    else:
        writer = writer.format("parquet").option("path", path)
    return writer.trigger(availableNow=True).start()
