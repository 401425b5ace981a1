"""The channel review file and the topic report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.constants import REPORT_KEYWORDS, REVIEW_COLUMNS


def write_review_csv(review: DataFrame, path: str) -> None:
    review.select(*REVIEW_COLUMNS).write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, missing ones as blanks."""
    schema = ", ".join(f"{c} string" for c in REVIEW_COLUMNS)
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in REVIEW_COLUMNS])


def topic_report(topics: DataFrame, categories: DataFrame) -> DataFrame:
    """Topics by size with category name and first keywords."""
    named = topics.join(F.broadcast(categories), "category_id", "left")
    return named.select(
        "topic_id",
        "topic_label",
        F.coalesce("category_name", F.lit("Unassigned")).alias("category"),
        "video_count",
        F.array_join(F.slice("keywords", 1, REPORT_KEYWORDS), ", ").alias("keywords"),
    ).orderBy(F.desc("video_count"), "topic_id")


def write_topic_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)
