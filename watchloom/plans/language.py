"""Channel languages: detection, review, import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.constants import (
    LANGUAGE_CODES,
    REVIEW_COLUMNS,
    REVIEW_MIN_VIEWS,
    REVIEW_TITLES,
)
from watchloom.functions.text import parse_language_answer, script_language, strip
from watchloom.operators.ordering import top_n
from watchloom.operators.upserts import update_from


def review_candidates(
    channels: DataFrame, funnel: DataFrame, min_views: int = REVIEW_MIN_VIEWS
) -> DataFrame:
    """Channels with enough views, most viewed first."""
    busy = funnel.where(F.col("total_views") >= min_views).select("channel_id", "total_views")
    return channels.join(busy, "channel_id").orderBy(F.desc("total_views"), "channel_id")


def recent_titles(videos: DataFrame, events: DataFrame, n: int = REVIEW_TITLES) -> DataFrame:
    """The ``n`` newest watched titles per channel: channel_id, title, pos (1 = newest)."""
    titled = videos.where((F.col("status") == "active") & (F.col("title") != "")).select(
        "video_id", "channel_id", "title"
    )
    watched = events.select("video_id", "watched_at", "event_id").join(titled, "video_id")
    return top_n(
        watched, ["channel_id"], [F.desc("watched_at"), F.desc("event_id")], n, rank="pos"
    ).select("channel_id", "title", "pos")


def title_lists(titles: DataFrame) -> DataFrame:
    """The newest titles as one list per channel."""
    pairs = F.sort_array(F.collect_list(F.struct("pos", "title")))
    return titles.groupBy("channel_id").agg(pairs.alias("p")).select(
        "channel_id", F.transform("p", lambda x: x["title"]).alias("titles")
    )


def channel_script_language(channels: DataFrame, titles: DataFrame) -> DataFrame:
    """Language by letters: the channel name decides, else most titles, else NULL.

    A tie between title languages goes to the one of the newest title.
    """
    votes = (
        titles.withColumn("lang", script_language(F.col("title")))
        .where(F.col("lang").isNotNull())
        .groupBy("channel_id", "lang")
        .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first_pos"))
    )
    by_titles = top_n(votes, ["channel_id"], [F.desc("votes"), F.asc("first_pos")], 1)
    joined = channels.select("channel_id", "channel_name").join(
        by_titles.select("channel_id", "lang"), "channel_id", "left"
    )
    return joined.select(
        "channel_id",
        F.coalesce(script_language(F.col("channel_name")), F.col("lang")).alias("script_lang"),
    )


def channel_language_review(
    channels: DataFrame,
    funnel: DataFrame,
    titles: DataFrame,
    guesses: DataFrame | None = None,
    min_views: int = REVIEW_MIN_VIEWS,
) -> DataFrame:
    """The review table.

    ``guesses`` holds (channel_id, answer) of any model; an answer is used where letters do
    not decide. Channels tagged by a human keep their tag.
    """
    busy = review_candidates(channels, funnel, min_views)
    detected = channel_script_language(busy, titles)
    base = busy.join(detected, "channel_id")
    if guesses is None:
        base = base.withColumn("guess", F.lit(None).cast("string"))
    else:
        answers = guesses.select("channel_id", parse_language_answer(F.col("answer")).alias("guess"))
        base = base.join(answers, "channel_id", "left")
    human = F.coalesce(F.col("language_source") == "human", F.lit(False))
    by_script = F.col("script_lang").isNotNull()
    named = strip(F.coalesce("channel_name", F.lit(""))) != ""
    guess = F.when(named, F.col("guess"))
    unicode_value = F.when(human, F.col("primary_language")).otherwise(F.col("script_lang"))
    model_value = F.when(human, F.col("primary_language")).when(~by_script, guess)
    method = (
        F.when(human, "already_human")
        .when(by_script, "unicode")
        .when(guess.isNotNull(), "mistral")
        .otherwise("none")
    )
    out = base.select(
        "channel_id",
        _blank("channel_name").alias("channel_name"),
        "total_views",
        _blank("primary_language").alias("existing_language"),
        _blank("language_source").alias("existing_source"),
        F.coalesce(unicode_value, F.lit("")).alias("unicode_detected"),
        F.coalesce(model_value, F.lit("")).alias("mistral_guess"),
        method.alias("detection_method"),
        F.coalesce(unicode_value, model_value, F.lit("")).alias("primary_language"),
        F.lit("").alias("notes"),
    )
    return out.select(*REVIEW_COLUMNS).orderBy(F.desc("total_views"), "channel_id")


def language_source(review: DataFrame) -> DataFrame:
    """Source of each reviewed language; NULL where the row is skipped."""
    chosen = _plain("primary_language")
    script, guess = _plain("unicode_detected"), _plain("mistral_guess")
    auto = F.coalesce(F.nullif(script, F.lit("")), guess)
    source = (
        F.when(~chosen.isin(LANGUAGE_CODES), None)
        .when(_plain("detection_method") == "already_human", None)
        .when((chosen != auto) | (auto == ""), "human")
        .when(chosen == script, "unicode")
        .when(chosen == guess, "mistral")
        .otherwise("human")
    )
    return review.select(
        F.col("channel_id").cast("bigint").alias("channel_id"),
        chosen.alias("primary_language"),
        source.alias("language_source"),
    )


def apply_review(channels: DataFrame, review: DataFrame) -> DataFrame:
    """Channels with the reviewed languages; of several rows for a channel one counts."""
    updates = (
        language_source(review)
        .where(F.col("language_source").isNotNull())
        .groupBy("channel_id")
        .agg(F.max(F.struct("primary_language", "language_source")).alias("r"))
        .select("channel_id", "r.*")
    )
    return update_from(channels, updates, "channel_id", ["primary_language", "language_source"])


def _plain(column: str) -> Column:
    return F.lower(strip(F.coalesce(F.col(column), F.lit(""))))


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
