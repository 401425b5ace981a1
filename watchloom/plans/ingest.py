"""Export records into the star schema."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from watchloom.functions import records as R
from watchloom.functions.calendar import local_date
from watchloom.functions.constants import LOCAL_ZONE
from watchloom.operators.ordering import number_rows
from watchloom.operators.upserts import missing
from watchloom.session import materialize, together
from watchloom.sources.export import read_export
from watchloom.sources.schemas import BROKEN
from watchloom.sources.store import Store, retried

# Records of one file that share a numbering leaf.
_POSITIONS_PER_LEAF = 65_536


def classify(raw: DataFrame) -> DataFrame:
    """Adds the record class; text that is no JSON is ``broken``."""
    kind = R.record_class(F.col("details"), F.col("titleUrl"), F.col("title"))
    if BROKEN in raw.columns:
        kind = F.when(F.col(BROKEN).isNotNull(), "broken").otherwise(kind)
    return raw.withColumn("record_class", kind)


def _class_counters() -> list[Column]:
    kind = F.col("record_class")
    return [
        F.count(F.lit(1)).alias("total_raw_records"),
        F.count_if(kind == "ad").alias("ads_filtered"),
        F.count_if(kind == "removed").alias("removed_dropped"),
        F.count_if(kind == "ghost").alias("ghost_videos_kept"),
        F.count_if(kind == "clean").alias("clean_records"),
    ]


CLASS_COUNTERS = [
    "total_raw_records", "ads_filtered", "removed_dropped", "ghost_videos_kept", "clean_records",
]


def class_counts(classified: DataFrame) -> DataFrame:
    """Records per class in one pass."""
    return classified.agg(*_class_counters())


def extract(classified: DataFrame) -> DataFrame:
    """Fields of every record; ``class_rank`` puts clean records before ghosts."""
    return classified.select(
        "record_class",
        F.when(F.col("record_class") == "clean", 0).otherwise(1).alias("class_rank"),
        "file_name",
        "pos",
        R.video_id(F.col("titleUrl")).alias("video_id"),
        R.clean_title(F.col("title")).alias("title"),
        F.col("titleUrl").alias("title_url"),
        R.utc_time(F.col("time")).alias("watched_at"),
        R.channel_name(F.col("subtitles")).alias("channel_name"),
        R.channel_url(F.col("subtitles")).alias("channel_url"),
    )


def kept(extracted: DataFrame) -> DataFrame:
    """Clean and ghost records with a video id."""
    return extracted.where(
        F.col("record_class").isin("clean", "ghost") & F.col("video_id").isNotNull()
    )


def parse(raw: DataFrame) -> DataFrame:
    """Fields of the records that are kept, without a stored intermediate."""
    wanted = raw.where(~R.is_ad(F.col("details")) & ~R.is_removed(F.col("titleUrl")))
    kind = F.when(R.is_ghost(F.col("title")), "ghost").otherwise("clean")
    return kept(extract(wanted.withColumn("record_class", kind))).drop("record_class")


def land(raw: DataFrame) -> DataFrame:
    """Classifies and extracts all records into a table in the shared folder, and reads it back.

    A load needs the records several times; parsing them is the expensive part.
    """
    return materialize(extract(classify(raw)), "records")


def _place():
    """Order of records: clean before ghost, then along the files."""
    return F.struct("class_rank", "file_name", "pos")


def distinct_channels(parsed: DataFrame) -> DataFrame:
    """Channels with name and address, with the place of their first record."""
    named = parsed.where("channel_name != '' and channel_url != ''")
    return (
        named.groupBy("channel_name", "channel_url")
        .agg(F.min(_place()).alias("place"))
        .select("channel_name", "channel_url", "place.*")
    )


def first_per_video(parsed: DataFrame) -> DataFrame:
    """The first record of each video supplies title, address and channel."""
    row = F.struct("title", "title_url", "channel_name", "channel_url")
    return (
        parsed.groupBy("video_id")
        .agg(F.min_by(row, _place()).alias("r"))
        .select("video_id", "r.*")
    )


def number_by_place(df: DataFrame, name: str, start) -> DataFrame:
    """Consecutive ids in record order."""
    leaf = F.floor(F.col("pos") / _POSITIONS_PER_LEAF)
    return number_rows(
        df.withColumn("_stretch", leaf),
        ["class_rank", "file_name"],
        ["_stretch"],
        ["pos"],
        name,
        start,
    ).drop("_stretch")


def new_channels(stored: DataFrame, parsed: DataFrame, last_id, now) -> DataFrame:
    """Channels the store lacks, with the next ids; stored ones are not touched."""
    fresh = missing(distinct_channels(parsed), stored, ["channel_name", "channel_url"])
    return number_by_place(fresh, "channel_id", last_id).select(
        "channel_id", "channel_name", "channel_url",
        now.alias("created_at"),
        F.lit(None).cast("string").alias("primary_language"),
        F.lit(None).cast("string").alias("language_source"),
    )


def with_channel_id(df: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds the id of the (name, url) pair; NULL when it has none."""
    ids = channels.select("channel_name", "channel_url", "channel_id")
    return df.join(ids, ["channel_name", "channel_url"], "left")


def new_videos(stored: DataFrame, parsed: DataFrame, channels: DataFrame, now) -> DataFrame:
    """Videos the store lacks. A stored row is never improved, so a ghost stays a ghost."""
    fresh = missing(first_per_video(parsed), stored, ["video_id"])
    return with_channel_id(fresh, channels).select(
        "video_id", "title", "title_url", "channel_id",
        R.initial_status(F.col("title")).alias("status"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.lit(None).cast("int").alias("category_id"),
        F.lit(None).cast("bigint").alias("duration_seconds"),
        F.lit(None).cast("bigint").alias("view_count"),
        F.lit(None).cast("bigint").alias("like_count"),
        F.lit(False).alias("has_transcript"),
        F.lit(None).cast("timestamp_ntz").alias("enriched_at"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def distinct_events(parsed: DataFrame) -> DataFrame:
    """First record per (video, time); records without a time are left to the quarantine."""
    row = F.struct("class_rank", "file_name", "pos", "channel_name", "channel_url")
    return (
        parsed.where(F.col("watched_at").isNotNull())
        .groupBy("video_id", "watched_at")
        .agg(F.min(row).alias("r"))
        .select("video_id", "watched_at", "r.*")
    )


def new_events(
    stored: DataFrame, parsed: DataFrame, channels: DataFrame, last_id, zone: str = LOCAL_ZONE
) -> DataFrame:
    """Events the store lacks, with the next ids. The channel is the record's own."""
    fresh = missing(distinct_events(parsed), stored, ["video_id", "watched_at"])
    numbered = number_by_place(fresh, "event_id", last_id)
    return (
        with_channel_id(numbered, channels)
        .select("event_id", "video_id", "channel_id", "watched_at")
        .withColumn("local_date", local_date("watched_at", zone))
        .withColumn("local_month", F.trunc("local_date", "month"))
    )


def quarantine(extracted: DataFrame) -> DataFrame:
    """Records that are no JSON, and those of the kept ones that have no time."""
    fields = ["video_id", "channel_name", "channel_url", "file_name", "pos"]
    broken = extracted.where("record_class = 'broken'").select(
        *[F.lit(None).cast("string").alias(c) for c in fields[:3]], *fields[3:],
        F.lit("not JSON").alias("reason"),
    )
    return kept(extracted).where(F.col("watched_at").isNull()).select(
        *fields, F.lit("time missing or unreadable").alias("reason")
    ).unionByName(broken)


def event_counts(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Submitted, new and duplicate events; repeats within the load are duplicates."""
    on = ["video_id", "watched_at"]
    submitted = (
        parsed.where(F.col("watched_at").isNotNull())
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = submitted.join(stored.select(*on, F.lit(1).alias("known")), on, "left")
    return known.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("submitted"),
        F.count_if(F.col("known").isNull()).alias("new_events"),
    ).withColumn("duplicate_events", F.col("submitted") - F.col("new_events"))


def total_ever_watched(events: DataFrame, log: DataFrame) -> DataFrame:
    """Stored events plus all removed records of all runs."""
    stored = events.agg(F.count(F.lit(1)).alias("watch_events"))
    removed = log.agg(F.sum("removed_dropped").cast("bigint").alias("removed_all_time"))
    both = stored.unionByName(removed, allowMissingColumns=True).agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("watch_events", "removed_all_time")
        ]
    )
    return both.withColumn(
        "total_ever_watched", F.col("watch_events") + F.col("removed_all_time")
    )


@dataclass
class IngestResult:
    total_raw_records: int
    ads_filtered: int
    removed_dropped: int
    ghost_videos_kept: int
    clean_records: int
    new_channels: int
    new_videos: int
    new_events: int
    duplicate_events: int
    broken_records: int


def ingest(
    store: Store, raw: DataFrame, file_name: str, zone: str = LOCAL_ZONE, now: datetime | None = None,
    epoch: tuple[str, int] | None = None,
) -> IngestResult | None:
    """One load: classify, extract, add what the store lacks, log the run.

    The records are parsed once, into a table in the shared folder. All changes become
    visible together. If another load was published meanwhile, what the store lacks is worked out again. A batch of a
    stream (``epoch``: its name and number) that the store holds already adds and logs nothing.
    """
    if epoch and store.snapshot().epochs.get(epoch[0], -1) >= epoch[1]:
        return None
    extracted = land(raw)
    return retried(lambda: _ingest(store, extracted, file_name, zone, now, epoch))


def _ingest(
    store: Store, extracted: DataFrame, file_name: str, zone: str, now: datetime | None, epoch: tuple[str, int] | None
) -> IngestResult:
    began = time.monotonic()
    spark = store.spark
    at = now or datetime.now(UTC).replace(tzinfo=None)
    stamp = F.lit(at).cast("timestamp_ntz")

    before = store.snapshot()
    channels, videos, events = (
        store.read(t, before) for t in ("dim_channels", "dim_videos", "fact_watch_events")
    )
    parsed = kept(extracted)
    profile, last_channel, last_event = together(
        lambda: _profile(extracted, zone),
        lambda: _last(channels, "channel_id"),
        lambda: _last(events, "event_id"),
    )
    # Only days the load touches can hold duplicates of it.
    first_day, last_day = (F.lit(profile[c]).cast("date") for c in ("first_day", "last_day"))
    overlap = events.where(
        F.col("local_month").between(F.trunc(first_day, "month"), F.trunc(last_day, "month"))
        & F.col("local_date").between(first_day, last_day)
    )

    channel_folder = store.stage("dim_channels", new_channels(channels, parsed, last_channel, stamp))
    added_channels = store.staged("dim_channels", channel_folder)
    all_channels = channels.unionByName(added_channels)
    video_folder, event_folder, quarantine_folder = together(
        lambda: store.stage("dim_videos", new_videos(videos, parsed, all_channels, stamp)),
        lambda: store.stage(
            "fact_watch_events", new_events(overlap, parsed, all_channels, last_event, zone)
        ),
        lambda: store.stage("quarantine_events", quarantine(extracted)),
    )
    added = together(
        added_channels.count,
        store.staged("dim_videos", video_folder).count,
        store.staged("fact_watch_events", event_folder).count,
    )
    result = IngestResult(
        **{c: profile[c] for c in CLASS_COUNTERS},
        new_channels=added[0],
        new_videos=added[1],
        new_events=added[2],
        duplicate_events=profile["submitted"] - added[2],
        broken_records=profile["broken"],
    )
    log = spark.createDataFrame(
        [(file_name, at, *vars(result).values(), round(time.monotonic() - began, 2))],
        "file_name string, run_at timestamp_ntz, "
        + ", ".join(f"{c} bigint" for c in vars(result))
        + ", duration_seconds double",
    )
    store.publish(
        append={
            "dim_channels": channel_folder,
            "dim_videos": video_folder,
            "fact_watch_events": event_folder,
            "quarantine_events": quarantine_folder,
            "etl_log": store.stage("etl_log", log),
        },
        based_on=before,
        reads=("dim_channels", "dim_videos", "fact_watch_events"),
        epoch=epoch,
    )
    return result


def ingest_files(
    store: Store, path: str | list[str], name: str | None = None, lines: bool = False, **options
) -> IngestResult:
    """Load one or many export files."""
    label = name or (path if isinstance(path, str) else ",".join(path)).rsplit("/", 1)[-1]
    return ingest(store, read_export(store.spark, path, lines), label, **options)


def _profile(extracted: DataFrame, zone: str) -> Row:
    """Class counters, events submitted and the days they cover, in one pass."""
    loaded = (
        F.col("record_class").isin("clean", "ghost")
        & F.col("video_id").isNotNull()
        & F.col("watched_at").isNotNull()
    )
    at = F.when(loaded, F.col("watched_at"))
    seen = extracted.agg(
        *_class_counters(),
        F.count_if(F.col("record_class") == "broken").alias("broken"),
        F.count_if(loaded).alias("submitted"),
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
    )
    return seen.select(
        *CLASS_COUNTERS,
        "submitted",
        "broken",
        local_date("first_at", zone).alias("first_day"),
        local_date("last_at", zone).alias("last_day"),
    ).first()


def _last(table: DataFrame, column: str) -> int:
    return table.agg(F.coalesce(F.max(column), F.lit(0)).alias("last")).first()["last"]

