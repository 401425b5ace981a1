"""Readers for watch-history exports and landed metadata responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.metadata import iso_seconds, number_or_null
from watchloom.sources.schemas import BROKEN, EXPORT_RECORD, METADATA_RESPONSE


def read_export(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Records of one or many exports, each file one JSON array (or one record per line).

    Files are read in parallel. ``pos`` grows along a file, so (file_name, pos) is its order. A
    file that is no JSON array fails the read; of a file of lines, a line that is no JSON is a
    record with its text in ``_corrupt_record``.
    """
    reader = spark.read.option("multiLine", not lines)
    if lines:
        reader = reader.schema(f"{EXPORT_RECORD}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN)
    else:
        reader = reader.schema(EXPORT_RECORD).option("mode", "FAILFAST")
    return with_position(with_file_name(reader.json(path)))


def with_file_name(raw: DataFrame) -> DataFrame:
    """The whole path, as exports in different folders are mostly called alike."""
    return raw.select("*", F.col("_metadata.file_path").alias("file_name"))


def with_position(raw: DataFrame) -> DataFrame:
    """Numbers records in reading order; stands directly on the scan."""
    return raw.withColumn("pos", F.monotonically_increasing_id())


def read_responses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """landed_at, file_name, items and answered of all landed responses.

    A truncated response, or one that reports an error, has no list of items and is not answered.
    """
    raw = (
        spark.read.schema(f"{METADATA_RESPONSE}, {BROKEN} string")
        .option("multiLine", True).option("columnNameOfCorruptRecord", BROKEN).json(path)
    )
    return raw.select(
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_path").alias("file_name"),
        F.when(F.col(BROKEN).isNull(), F.col("items")).alias("items"),
        (F.col(BROKEN).isNull() & F.col("items").isNotNull()).alias("answered"),
    )


def read_metadata(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One normalized row per video over all landed responses; the newest response wins."""
    items = read_responses(spark, path).select(
        "landed_at", "file_name", F.posexplode("items").alias("pos", "item")
    )
    row = F.struct(*normalize_item(F.col("item")))
    newest = F.max_by(row, F.struct("landed_at", "file_name", "pos"))
    return (
        items.where(F.col("item.id").isNotNull())
        .groupBy(F.col("item.id").alias("id"))
        .agg(newest.alias("r"))
        .select("r.*")
    )


def normalize_item(item) -> list:
    """Fields of a response item: blanks to NULL, missing tags to an empty list."""
    return [
        item["id"].alias("video_id"),
        F.nullif(item["snippet"]["description"], F.lit("")).alias("description"),
        F.coalesce(item["snippet"]["tags"], F.array().cast("array<string>")).alias("tags"),
        number_or_null(item["snippet"]["categoryId"], "int").alias("category_id"),
        iso_seconds(item["contentDetails"]["duration"]).alias("duration_seconds"),
        number_or_null(item["statistics"]["viewCount"]).alias("view_count"),
        number_or_null(item["statistics"]["likeCount"]).alias("like_count"),
    ]


def normalize_metadata(items: DataFrame, column: str = "item") -> DataFrame:
    return items.select(*normalize_item(F.col(column)))
