"""Export files as they arrive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from watchloom.functions.constants import LOCAL_ZONE
from watchloom.plans.ingest import ingest
from watchloom.sources.export import with_file_name, with_position
from watchloom.sources.schemas import EXPORT_RECORD
from watchloom.sources.store import Store


def stream_exports(
    store: Store,
    folder: str,
    checkpoint: str,
    zone: str = LOCAL_ZONE,
    lines: bool = False,
    files_per_batch: int = 1000,
    now: datetime | None = None,
) -> StreamingQuery:
    """Loads every export file that has arrived in ``folder`` and stops.

    Each export repeats the whole history, so the store itself tells old events from new ones;
    a watermark would not. A batch that is run again, as its commit went through but the stream's own
    record of it did not, adds and logs nothing.
    """
    spark: SparkSession = store.spark
    arriving = (
        spark.readStream.schema(EXPORT_RECORD)
        .option("multiLine", not lines)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )

    def load(batch: DataFrame, epoch: int) -> None:
        ingest(store, with_position(batch), f"batch-{epoch}", zone, now, (checkpoint, epoch))

    return (
        with_file_name(arriving)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
