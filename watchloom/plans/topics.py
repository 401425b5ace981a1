"""Topics: clustering, keywords, categories, labels, assignment of new videos."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.constants import (
    MIN_TOPIC_SIZE,
    STOP_WORDS,
    STORED_KEYWORDS,
    TOPIC_SEED,
)
from watchloom.functions.text import (
    clean_label,
    document_or_unknown,
    keyword_label,
    terms,
    tokens,
)
from watchloom.functions.vectors import cosine
from watchloom.operators.neighbours import similar, unit_rows
from watchloom.operators.ordering import majority, top_n
from watchloom.operators.upserts import append_assignments, missing
from watchloom.session import materialize
from watchloom.sources.store import Store

MODEL_NAME = "kmeans-cosine"
MODEL_VERSION = "v1"
# Topics are a report-sized table; more of them than this are not broadcast.
MAX_BROADCAST_TOPICS = 20_000


def topic_input(embeddings: DataFrame, videos: DataFrame, categories: DataFrame) -> DataFrame:
    """Embedded active videos with category, channel and document text."""
    good = embeddings.where(F.col("embed_failed_at").isNull()).select("video_id", "embedding")
    active = videos.where(F.col("status") == "active").select(
        "video_id", "category_id", "channel_id", document_or_unknown(F.col("title")).alias("document")
    )
    return good.join(active, "video_id").join(F.broadcast(categories), "category_id", "left")


def video_language(videos: DataFrame, channels: DataFrame) -> DataFrame:
    """Language of each active video, by its channel."""
    tagged = channels.where(F.col("primary_language").isNotNull())
    return (
        videos.where(F.col("status") == "active")
        .select("video_id", "channel_id")
        .join(tagged.select("channel_id", "primary_language"), "channel_id")
        .select("video_id", F.col("primary_language").alias("language"))
    )


def fit_topics(
    vectors: DataFrame,
    k: int,
    min_size: int = MIN_TOPIC_SIZE,
    seed: int = TOPIC_SEED,
    outlier_share: float = 0.05,
) -> tuple[DataFrame, DataFrame]:
    """Clusters (video_id, embedding) by direction.

    Returns assignments (video_id, model_topic, cosine), with -1 for members of clusters below
    ``min_size`` and for the ``outlier_share`` of each cluster farthest from its centre, and
    the topic map (model_topic, centroid, radius).
    """
    features = vectors.select("video_id", "embedding", array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(features)
    spark = vectors.sparkSession
    # One row per topic.
    centres = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cluster int, centroid array<double>",
    )
    placed = model.transform(features).select("video_id", "embedding", F.col("prediction").alias("cluster"))
    scored = placed.join(_small(centres, k), "cluster").withColumn(
        "cosine", cosine(F.col("embedding"), F.col("centroid"))
    )
    sizes = scored.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"),
        F.percentile_approx("cosine", outlier_share, 10_000).alias("radius"),
    )
    kept = sizes.where(F.col("members") >= min_size).select("cluster", "radius")
    assigned = scored.join(_small(kept, k), "cluster", "left").select(
        "video_id",
        F.when(F.col("cosine") >= F.col("radius"), F.col("cluster")).otherwise(-1)
        .alias("model_topic"),
        "cosine",
    )
    topic_map = centres.join(kept, "cluster").select(
        F.col("cluster").alias("model_topic"), "centroid", "radius"
    )
    return assigned, topic_map


def nearest_topic(vectors: DataFrame, topic_map: DataFrame, topics: int) -> DataFrame:
    """Nearest topic of each vector by cosine; NULL beyond the topic's radius.

    While topics are few, their centroids go to every task as one matrix and the vectors stay
    where they are. Larger maps are compared block by block.
    """
    radii = topic_map.select("topic_id", "radius")
    if topics <= MAX_BROADCAST_TOPICS:
        best = _nearest_of_matrix(vectors, topic_map)
        placed = best.join(F.broadcast(radii), "topic_id")
    else:
        best = similar(
            topic_map.select("topic_id", F.col("centroid").alias("embedding")),
            vectors,
            1,
            key="topic_id",
            query_key="video_id",
            exclude_self=False,
        ).select(
            F.col("query").alias("video_id"), F.col("neighbour").alias("topic_id"), "cosine"
        )
        placed = best.join(radii, "topic_id")
    return placed.select(
        "video_id",
        F.when(F.col("cosine") >= F.col("radius"), F.col("topic_id")).alias("topic_id"),
        "cosine",
    )


def _nearest_of_matrix(vectors: DataFrame, topic_map: DataFrame) -> DataFrame:
    """(video_id, topic_id, cosine) of the nearest centroid; ties go to the smaller topic id."""
    # At most MAX_BROADCAST_TOPICS rows.
    rows = sorted((r["topic_id"], r["centroid"]) for r in topic_map.collect())
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    centroids = unit_rows([r[1] for r in rows])
    shared = vectors.sparkSession.sparkContext.broadcast((ids, centroids))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        topic_ids, matrix = shared.value
        for frame in frames:
            if frame.empty:
                continue
            scores = np.round(unit_rows(frame["embedding"]) @ matrix.T, 9)
            nearest = scores.argmax(axis=1)
            yield pd.DataFrame({
                "video_id": frame["video_id"].to_numpy(),
                "topic_id": topic_ids[nearest],
                "cosine": scores[np.arange(len(frame)), nearest],
            })

    kind = vectors.schema["video_id"].dataType.simpleString()
    return vectors.select("video_id", "embedding").mapInPandas(
        place, f"video_id {kind}, topic_id bigint, cosine double"
    )


def unassigned(embeddings: DataFrame, videos: DataFrame, assigned: DataFrame) -> DataFrame:
    """Vectors of active videos without a topic."""
    active = videos.where(F.col("status") == "active").select("video_id")
    good = embeddings.where(F.col("embed_failed_at").isNull()).select("video_id", "embedding")
    return missing(good.join(active, "video_id", "left_semi"), assigned, ["video_id"])


def topic_keywords(
    documents: DataFrame,
    n: int = STORED_KEYWORDS,
    min_documents: int = 2,
    stop_words: Sequence[str] = STOP_WORDS,
) -> DataFrame:
    """Terms that mark a topic: topic, term, weight, rank.

    ``documents`` holds (topic, doc_key, document). A term is a word or two-word phrase found
    in at least ``min_documents`` documents. Its weight is its frequency in the topic times
    ln(1 + A / its overall frequency), A being the mean number of terms per topic.
    """
    words = tokens(F.col("document"), stop_words)
    listed = documents.select("topic", "doc_key", terms(words).alias("terms"))
    # Rows of one document are put together, so that a term counts once for it; rows are few against their terms.
    several = documents.groupBy("topic", "doc_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if not several.isEmpty():
        listed = listed.groupBy("topic", "doc_key").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    # Every term, and once more for its document: sums of both need no row per document.
    marked = F.concat(
        F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d"))),
        F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d"))),
    )
    per_topic = listed.select("topic", F.explode(marked).alias("t")).groupBy("topic", F.col("t.term").alias("term")).agg(
        F.sum("t.n").alias("frequency"), F.sum("t.d").alias("documents")
    )
    # A term has at most one row per topic, so its window is no larger than the topic list.
    of_term = Window.partitionBy("term")
    used = (
        per_topic.withColumn("overall", F.sum("frequency").over(of_term))
        .withColumn("documents", F.sum("documents").over(of_term))
        .where(F.col("documents") >= min_documents)
    )
    sizes = used.groupBy("topic").agg(F.sum("frequency").alias("size"))
    mean_terms = sizes.agg(F.avg("size").alias("mean_terms")).scalar()
    weighted = used.withColumn(
        "weight", F.round(F.col("frequency") * F.log(1 + mean_terms / F.col("overall")), 6)
    )
    return top_n(
        weighted.select("topic", "term", "weight"),
        ["topic"],
        [F.desc("weight"), F.asc("term")],
        n,
        rank="rank",
    )


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """Keywords of each topic as a list in rank order; at most ``n`` each."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return keywords.groupBy("topic").agg(pairs.alias("p")).select(
        "topic", F.transform("p", lambda x: x["term"]).alias("keywords")
    )


def topic_category(members: DataFrame, categories: DataFrame) -> DataFrame:
    """Most frequent category per topic; a tie goes to the smallest video id.

    ``members`` holds (topic, video_id, category_id). Topics without any get 'Unknown'.
    """
    winners = majority(members, ["topic"], "category_id", "video_id")
    topics = members.select("topic").distinct()
    return (
        topics.join(winners, "topic", "left")
        .join(F.broadcast(categories), "category_id", "left")
        .select("topic", "category_id", F.coalesce("category_name", F.lit("Unknown")).alias("category_name"))
    )


def topic_language(members: DataFrame, languages: DataFrame) -> DataFrame:
    """Most frequent channel language per topic."""
    tagged = members.select("topic", "video_id").join(languages, "video_id")
    return majority(tagged, ["topic"], "language", "video_id")


def topic_labels(topics: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Supplied label where it is usable, else the keyword label.

    ``topics`` holds (topic, keywords), ``given`` (topic, label).
    """
    base = topics if given is None else topics.join(given.select("topic", "label"), "topic", "left")
    supplied = F.lit(None).cast("string") if given is None else clean_label(F.col("label"))
    keywords = F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.array(F.lit("unknown")))
    return base.select(
        *topics.columns, F.coalesce(supplied, keyword_label(keywords)).alias("topic_label")
    )


def remap(
    store: Store,
    k: int,
    min_size: int = MIN_TOPIC_SIZE,
    given_labels: DataFrame | None = None,
    now: datetime | None = None,
) -> dict[str, int]:
    """Recomputes all topics. Topic ids continue after the largest one ever used."""
    began = time.monotonic()
    at = now or datetime.now(UTC).replace(tzinfo=None)
    spark = store.spark
    before = store.snapshot()
    categories = store.read("dim_categories", before)
    videos = store.read("dim_videos", before)
    base = materialize(
        topic_input(store.read("nlp_embeddings", before), videos, categories), "topic-input"
    )
    assigned, topic_map = fit_topics(base.select("video_id", "embedding"), k, min_size)
    assigned = materialize(assigned, "topic-assigned")

    members = assigned.where("model_topic >= 0").join(
        base.select("video_id", "category_id", "document"), "video_id"
    ).withColumnRenamed("model_topic", "topic")
    keywords = keyword_lists(
        topic_keywords(members.select("topic", "document", F.col("video_id").alias("doc_key")))
    )
    sizes = members.groupBy("topic").agg(F.count(F.lit(1)).alias("video_count"))
    named = topic_labels(
        sizes.join(keywords, "topic", "left").join(topic_category(members, categories), "topic"),
        given_labels,
    )
    # Ids used so far, those of replaced topics included, are kept in the map's info table.
    info = store.read("topic_map_info", before).where("name = 'last_topic_id'")
    last = info.agg(F.coalesce(F.max(F.col("value").cast("bigint")), F.lit(0)).alias("v")).first()["v"]
    numbered = named.withColumn(
        # One row per topic.
        "topic_id", F.lit(last) + F.row_number().over(Window.orderBy("topic"))
    )
    numbered = materialize(numbered, "topics")

    ids = numbered.select(F.col("topic").alias("model_topic"), "topic_id")
    assignments = (
        assigned.join(_small(ids, k), "model_topic")
        .select("video_id", "topic_id")
        .withColumn("score", F.lit(1.0))
    )
    tally = assigned.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("model_topic") >= 0).alias("assigned"),
        F.count_if(F.col("model_topic") < 0).alias("outliers"),
    ).first()
    created = numbered.count()
    settings = [
        ("last_topic_id", str(last + created)), ("k", str(k)), ("min_size", str(min_size)),
        ("seed", str(TOPIC_SEED)), ("n_topics", str(created)),
        ("n_videos", str(tally["processed"])), ("n_outliers", str(tally["outliers"])),
        ("model_name", MODEL_NAME), ("model_version", MODEL_VERSION), ("run_at", at.isoformat()),
    ]
    stored = numbered.select(
        "topic_id", "topic_label", "keywords",
        F.lit(MODEL_NAME).alias("model_name"), F.lit(MODEL_VERSION).alias("model_version"),
        F.lit(at).cast("timestamp_ntz").alias("created_at"), "category_id", "video_count",
    )
    result = {
        "videos_processed": tally["processed"], "videos_assigned": tally["assigned"],
        "videos_outlier": tally["outliers"], "topics_created": created, "topics_total": created,
    }
    store.publish(
        replace={
            "nlp_topics": store.stage("nlp_topics", stored),
            "nlp_video_topics": store.stage("nlp_video_topics", assignments),
            "topic_map": store.stage("topic_map", topic_map.join(ids, "model_topic")),
            "topic_map_info": store.stage(
                "topic_map_info", spark.createDataFrame(settings, "name string, value string")
            ),
        },
        append={"topic_log": store.stage("topic_log", _log(store, at, "remap", result, began))},
        based_on=before,
    )
    return result


def assign_new(store: Store, now: datetime | None = None) -> dict[str, int]:
    """Assigns new vectors to the frozen topics; topic ids do not change."""
    began = time.monotonic()
    at = now or datetime.now(UTC).replace(tzinfo=None)
    before = store.snapshot()
    topic_map = store.read("topic_map", before)
    topics = topic_map.count()
    if topics == 0:
        raise ValueError("there is no topic map yet: run a remap first")
    old = store.read("nlp_video_topics", before)
    todo = unassigned(store.read("nlp_embeddings", before), store.read("dim_videos", before), old)
    placed = materialize(nearest_topic(todo, topic_map, topics), "nearest-topic")
    fresh = append_assignments(old, placed.where("topic_id is not null"))
    tally = placed.agg(
        F.count(F.lit(1)).alias("processed"), F.count("topic_id").alias("assigned")
    ).first()
    result = {
        "videos_processed": tally["processed"], "videos_assigned": tally["assigned"],
        "videos_outlier": tally["processed"] - tally["assigned"],
        "topics_created": 0, "topics_total": store.read("nlp_topics", before).count(),
    }
    store.publish(append={
        "nlp_video_topics": store.stage("nlp_video_topics", fresh),
        "topic_log": store.stage("topic_log", _log(store, at, "incremental", result, began)),
    }, based_on=before, reads=("nlp_video_topics", "topic_map"))
    return result


def _log(store: Store, at: datetime, mode: str, result: dict[str, int], began: float) -> DataFrame:
    return store.spark.createDataFrame(
        [(at, mode, MODEL_NAME, MODEL_VERSION, *result.values(), round(time.monotonic() - began, 2))],
        "run_at timestamp_ntz, run_mode string, model_name string, model_version string, "
        + ", ".join(f"{c} bigint" for c in result) + ", duration_seconds double",
    )


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table with one row per topic while topics are few."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_TOPICS else df
