from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.functions.constants import EMBEDDING_DIM
from watchloom.functions.vectors import cosine, normalize
from watchloom.operators import quality
from watchloom.operators.encoders import BatchEncoder, HashedTermsEncoder
from watchloom.operators.neighbours import similar
from watchloom.plans import embedding, enrichment, language, topics
from watchloom.sources.dims import dim_categories
from watchloom.sources.export import read_metadata
from watchloom.sources.review import read_review_csv, write_review_csv
from watchloom.sources.schemas import TABLES
from watchloom.sources.store import Store

NOW = datetime(2024, 6, 1)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.replace("dim_categories", dim_categories(spark))
    return s


def add_videos(store, rows):
    """rows: (video_id, title, channel_id, status, category_id)"""
    df = store.spark.createDataFrame(
        rows, "video_id string, title string, channel_id bigint, status string, category_id int"
    )
    known = set(df.columns)
    schema = store.spark.createDataFrame([], TABLES["dim_videos"]).schema
    store.replace("dim_videos", df.select(
        *[F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    ))


def test_metadata_responses(spark, store, tmp_path):
    responses = {
        "r1.json": {"items": [
            {"id": "a", "snippet": {"description": "", "tags": ["x"], "categoryId": "10"},
             "contentDetails": {"duration": "PT1M"}, "statistics": {"viewCount": "7", "likeCount": "0"}},
            {"id": "b", "snippet": {"description": "d"}, "contentDetails": {}, "statistics": {"viewCount": "8"}},
        ]},
        "r2.json": {"items": []},
    }
    for name, body in responses.items():
        (tmp_path / name).write_text(json.dumps(body))
    meta = read_metadata(spark, str(tmp_path / "r*.json"))
    got = {r.video_id: r for r in meta.collect()}
    assert tuple(got["a"])[1:] == (None, ["x"], 10, 60, 7, 0)
    assert tuple(got["b"])[1:] == ("d", [], None, None, 8, None)
    add_videos(store, [("a", "A", 1, "active", None), ("b", "B", 1, "active", None),
                       ("c", "C", 1, "active", None), ("d", "D", 1, "private", None)])
    attempted = enrichment.request_batches(store.read("dim_videos"))
    assert enrichment.enrich(store, meta, attempted, NOW) == {
        "targeted": 3, "enriched": 2, "flipped": 1, "remaining": 0}
    videos = {v.video_id: v for v in store.read("dim_videos").collect()}
    assert videos["a"].duration_seconds == 60 and videos["a"].enriched_at == NOW
    assert videos["c"].status == "unavailable" and videos["c"].enriched_at is None
    assert videos["d"].status == "private" and videos["d"].updated_at is None
    log = store.read("enrichment_log").first()
    assert (log.videos_targeted, log.videos_enriched, log.videos_flipped, log.api_units_used) == (3, 2, 1, 1)
    assert enrichment.candidates(store.read("dim_videos")).count() == 0


def test_embed_job_with_hashed_terms(store, tmp_path):
    add_videos(store, [("a", "space travel", 1, "active", None), ("b", "  ", 1, "active", None),
                       ("c", "space food", 1, "active", None), ("d", "x", 1, "private", None)])
    texts = embedding.video_texts(store.read("dim_videos"))
    HashedTermsEncoder.fit(texts).save(str(tmp_path / "model"))
    encoder = HashedTermsEncoder.load(str(tmp_path / "model"))
    assert embedding.embed_videos(store, encoder, NOW) == {
        "targeted": 3, "embedded": 2, "skipped": 1, "failed": 0}
    rows = {r.video_id: r for r in store.read("nlp_embeddings").collect()}
    assert len(rows["a"].embedding) == EMBEDDING_DIM
    assert abs(np.linalg.norm(rows["a"].embedding) - 1) < 1e-6
    assert rows["b"].embedding is None and rows["b"].embed_failed_at == NOW
    assert embedding.embed_videos(store, encoder, NOW)["targeted"] == 0


def test_embed_job_reports_failing_batches(store):
    add_videos(store, [(f"v{i}", "bad" if i == 3 else f"text {i}", 1, "active", None) for i in range(6)]
               + [("e", "", 1, "active", None)])

    def encode(texts):
        if "bad" in texts:
            raise RuntimeError("model broke")
        return np.array([[3.0, 4.0]] * len(texts))

    tally = embedding.embed_videos(store, BatchEncoder(encode, "fake", batch=1), NOW)
    assert tally == {"targeted": 7, "embedded": 5, "skipped": 1, "failed": 1}
    rows = {r.video_id: r for r in store.read("nlp_embeddings").collect()}
    assert np.allclose(rows["v0"].embedding, [0.6, 0.8]) and rows["v3"].embedding is None
    log = store.read("embed_log").first()
    assert (log.model_name, log.videos_failed, log.videos_skipped) == ("fake", 1, 1)


def vectors(spark, n=60, dim=8, groups=3, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, dim)) * 5
    rows = [(f"v{i:03d}", [float(x) for x in centres[i % groups] + rnd.normal(size=dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "video_id string, embedding array<float>")


@pytest.mark.parametrize("block_rows", [7, 16384])
def test_similar_is_exact(spark, block_rows):
    rows, df = vectors(spark)
    got = similar(df, df, 4, block_rows=block_rows).collect()
    matrix = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = np.round(matrix @ matrix.T, 9)
    np.fill_diagonal(scores, -9)
    for i, (name, _) in enumerate(rows):
        want = [rows[j][0] for j in np.argsort(-scores[i], kind="stable")[:4]]
        assert [r.neighbour for r in sorted((r for r in got if r.query == name), key=lambda r: r.rank)] == want


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(normalize(F.col("a")), cosine(F.col("a"), F.col("b")), normalize(F.col("z"))).first()
    assert np.allclose(got[0], [0.6, 0.8]) and abs(got[1] - 0.96) < 1e-9 and list(got[2]) == [0, 0]


def test_remap_and_incremental(spark, store, monkeypatch):
    rows, df = vectors(spark)
    words = ["red apple pie", "blue ocean wave", "green forest tree"]
    add_videos(store, [(v, words[i % 3], 1, "active", [1, 10, None][i % 3]) for i, (v, _) in enumerate(rows)])
    stored = df.select("video_id", "embedding", F.lit("m").alias("model_name"), F.lit("1").alias("model_version"),
                       F.lit(NOW).cast("timestamp_ntz").alias("created_at"),
                       F.lit(None).cast("timestamp_ntz").alias("embed_failed_at"))
    store.replace("nlp_embeddings", stored.where("video_id < 'v050'"))
    first = topics.remap(store, k=3, now=NOW)
    assert first["topics_created"] == 3 and first["videos_processed"] == 50
    found = store.read("nlp_topics").collect()
    assert sorted(t.topic_id for t in found) == [1, 2, 3]
    labels = {t.topic_label for t in found}
    assert any("Apple" in x for x in labels) and any("Ocean" in x for x in labels)
    before = {r.video_id: r.topic_id for r in store.read("nlp_video_topics").collect()}
    store.replace("nlp_embeddings", stored)
    second = topics.assign_new(store, now=NOW)
    assert second["videos_processed"] == 60 - len(before)
    after = {r.video_id: r.topic_id for r in store.read("nlp_video_topics").collect()}
    assert before.items() <= after.items()
    by_group = {}
    for v, t in after.items():
        by_group.setdefault(int(v[1:]) % 3, set()).add(t)
    assert all(len(s) == 1 for s in by_group.values())
    # Block-wise comparison gives what the broadcast matrix gives.
    topic_map = store.read("topic_map")
    small = topics.nearest_topic(df, topic_map, 3).collect()
    monkeypatch.setattr(topics, "MAX_BROADCAST_TOPICS", 1)
    large = topics.nearest_topic(df, topic_map, 3).collect()
    assert sorted(map(tuple, small), key=str) == sorted(map(tuple, large), key=str)
    monkeypatch.undo()
    topics.remap(store, k=3, now=NOW)
    assert sorted(t.topic_id for t in store.read("nlp_topics").collect()) == [4, 5, 6]
    assert [r.run_mode for r in store.read("topic_log").collect()].count("remap") == 2


def test_incremental_needs_a_map(store):
    with pytest.raises(ValueError):
        topics.assign_new(store)


def test_small_clusters_are_outliers(spark):
    _, df = vectors(spark, n=23, groups=2)
    assigned, topic_map = topics.fit_topics(df, k=2, min_size=12, outlier_share=0.0001)
    sizes = {r.model_topic: r["count"] for r in assigned.groupBy("model_topic").count().collect()}
    assert sizes[-1] == 11 and topic_map.count() == 1


def test_review_file_round_trip(spark, tmp_path):
    channels = spark.createDataFrame(
        [(1, 'Søren, "S"', None, None), (2, "Plain", None, None), (3, "Known", "fr", "human"), (4, "Rare", None, None)],
        "channel_id bigint, channel_name string, primary_language string, language_source string")
    funnel = spark.createDataFrame([(1, 30), (2, 20), (3, 10), (4, 9)], "channel_id bigint, total_views bigint")
    titles = spark.createDataFrame([(2, "straße", 1), (2, "señor", 2), (2, "niño", 3), (4, "ø", 1)],
                                   "channel_id bigint, title string, pos int")
    review = language.channel_language_review(channels, funnel, titles)
    path = str(tmp_path / "review")
    write_review_csv(review, path)
    back = read_review_csv(spark, path)
    rows = {r.channel_id: r for r in back.collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"].channel_name == 'Søren, "S"' and rows["1"].primary_language == "da"
    assert (rows["2"].unicode_detected, rows["2"].detection_method, rows["2"].notes) == ("es", "unicode", "")
    assert (rows["3"].detection_method, rows["3"].mistral_guess) == ("already_human", "fr")
    edited = back.withColumn("primary_language", F.when(F.col("channel_id") == "2", "pt").otherwise(F.col("primary_language")))
    done = {r.channel_id: (r.primary_language, r.language_source) for r in language.apply_review(channels, edited).collect()}
    assert done == {1: ("da", "unicode"), 2: ("pt", "human"), 3: ("fr", "human"), 4: (None, None)}


def test_title_tie_goes_to_newest(spark):
    channels = spark.createDataFrame([(1, "c")], "channel_id bigint, channel_name string")
    titles = spark.createDataFrame([(1, "x", 1), (1, "ß", 2), (1, "ñ", 3), (1, "ñ", 4), (1, "ß", 5)],
                                   "channel_id bigint, title string, pos int")
    assert language.channel_script_language(channels, titles).first().script_lang == "de"


def test_topic_ids_and_languages(spark):
    videos = spark.createDataFrame([("a", 1, "active"), ("b", 2, "active"), ("c", 3, "private")],
                                   "video_id string, channel_id bigint, status string")
    channels = spark.createDataFrame([(1, "da"), (2, None), (3, "de")], "channel_id bigint, primary_language string")
    assert [tuple(r) for r in topics.video_language(videos, channels).collect()] == [("a", "da")]


def test_quality_finds_faults(spark):
    events = spark.createDataFrame(
        [(1, "a", 1, NOW), (1, "a", 1, NOW), (2, "zz", 9, NOW), (3, None, None, None)],
        "event_id bigint, video_id string, channel_id bigint, watched_at timestamp_ntz")
    videos = spark.createDataFrame([("a", 1, "gone", 10)], "video_id string, channel_id bigint, status string, category_id int")
    channels = spark.createDataFrame([(1, "c", "u")], "channel_id bigint, channel_name string, channel_url string")
    topics_ = spark.createDataFrame([(1,)], "topic_id bigint")
    pairs = spark.createDataFrame([("a", 1, 1.5), ("a", 2, 0.5)], "video_id string, topic_id bigint, score double")
    vecs = spark.createDataFrame([("a", [1.0], None)], "video_id string, embedding array<float>, embed_failed_at timestamp_ntz")
    found = {(r.table_name, r.rule): r.violations for r in quality.check_schema(
        events, videos, channels, dim_categories(spark), topics_, pairs, vecs).collect() if r.violations}
    assert found == {
        ("dim_videos", "status"): 1,
        ("fact_watch_events", "unique(event_id)"): 1,
        ("fact_watch_events", "unique(video_id,watched_at)"): 1,
        ("fact_watch_events", "foreign_key(video_id)"): 1,
        ("fact_watch_events", "foreign_key(channel_id)"): 1,
        ("fact_watch_events", "not_null(video_id)"): 1,
        ("fact_watch_events", "not_null(watched_at)"): 1,
        ("nlp_video_topics", "score"): 1,
        ("nlp_video_topics", "foreign_key(topic_id)"): 1,
        ("nlp_embeddings", "size(embedding)"): 1,
    }
