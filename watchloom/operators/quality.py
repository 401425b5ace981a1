"""Integrity rules of the star schema, which Spark does not enforce.

Each check yields (table_name, rule, violations). Keys are counted before they are compared,
so a frequent key is one row by the time it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.constants import EMBEDDING_DIM, VIDEO_STATUSES


def unique(table: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key; keys with a NULL do not collide."""
    keyed = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    extra = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0))
    return _result(keyed.agg(extra.alias("violations")), table, f"unique({','.join(columns)})")


def foreign_key(table: str, df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Rows that point at a parent that is not there."""
    keys = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    orphans = keys.join(parent.select(column), column, "left_anti")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return _result(orphans.agg(total.alias("violations")), table, f"foreign_key({column})")


def row_rules(table: str, df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Counts rows breaking each rule, all rules in one pass; a rule is what must not be true."""
    counts = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations").select(
        F.lit(table).alias("table_name"), "rule", F.col("violations").cast("bigint")
    )


def not_null(*columns: str) -> dict[str, Column]:
    return {f"not_null({c})": F.col(c).isNull() for c in columns}


def check_schema(
    events: DataFrame,
    videos: DataFrame,
    channels: DataFrame,
    categories: DataFrame,
    topics: DataFrame | None = None,
    video_topics: DataFrame | None = None,
    embeddings: DataFrame | None = None,
    dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """All rules, one row each; a sound store has only zeros."""
    parts = [
        unique("dim_channels", channels, ["channel_id"]),
        unique("dim_channels", channels, ["channel_name", "channel_url"]),
        row_rules("dim_channels", channels, not_null("channel_id")),
        unique("dim_videos", videos, ["video_id"]),
        foreign_key("dim_videos", videos, "channel_id", channels),
        foreign_key("dim_videos", videos, "category_id", categories),
        row_rules("dim_videos", videos, {
            **not_null("video_id"),
            "length(video_id)": F.length("video_id") > 20,
            "status": ~F.col("status").isin(VIDEO_STATUSES),
        }),
        unique("fact_watch_events", events, ["event_id"]),
        unique("fact_watch_events", events, ["video_id", "watched_at"]),
        foreign_key("fact_watch_events", events, "video_id", videos),
        foreign_key("fact_watch_events", events, "channel_id", channels),
        row_rules("fact_watch_events", events, not_null("event_id", "video_id", "watched_at")),
    ]
    if video_topics is not None:
        parts += [
            unique("nlp_video_topics", video_topics, ["video_id", "topic_id"]),
            foreign_key("nlp_video_topics", video_topics, "video_id", videos),
            row_rules("nlp_video_topics", video_topics, {
                **not_null("video_id", "topic_id"),
                "score": (F.col("score") < 0) | (F.col("score") > 1),
            }),
        ]
        if topics is not None:
            parts.append(foreign_key("nlp_video_topics", video_topics, "topic_id", topics))
    if embeddings is not None:
        parts += [
            unique("nlp_embeddings", embeddings, ["video_id"]),
            foreign_key("nlp_embeddings", embeddings, "video_id", videos),
            row_rules("nlp_embeddings", embeddings, {
                **not_null("video_id"),
                "size(embedding)": F.size("embedding") != dim,
                "embedding_or_failure": F.col("embedding").isNull()
                & F.col("embed_failed_at").isNull(),
            }),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _result(counted: DataFrame, table: str, rule: str) -> DataFrame:
    return counted.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.col("violations").cast("bigint").alias("violations"),
    )
