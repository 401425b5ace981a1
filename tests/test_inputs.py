"""Broken exports, failed requests, zero vectors, shared folders."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.functions import vectors
from watchloom.operators.encoders import NO_TEXT, BatchEncoder, HashedTermsEncoder
from watchloom.operators.upserts import update_from
from watchloom.plans.enrichment import attempts, flip_missing
from watchloom.plans.ingest import ingest_files
from watchloom.session import shared_dir
from watchloom.sources.export import read_export, read_metadata, read_responses
from watchloom.sources.store import Store

RECORD = (
    '{"title":"Watched A %d","titleUrl":"https://video.example/watch?v=v%d","time":"2024-01-0%dT10:00:00Z",'
    '"subtitles":[{"name":"c","url":"u/c"}]}'
)


def records(n, start=1):
    return [RECORD % (k, k, k) for k in range(start, start + n)]


def test_a_broken_array_stops_the_load(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    (tmp_path / "good.json").write_text("[" + ",".join(records(3)) + "]")
    ingest_files(store, str(tmp_path / "good.json"))
    (tmp_path / "cut.json").write_text(("[" + ",".join(records(5)) + "]")[:-40])
    with pytest.raises(Exception):
        ingest_files(store, str(tmp_path / "cut.json"))
    assert store.read("etl_log").count() == 1 and store.read("fact_watch_events").count() == 3


def test_broken_lines_are_set_aside(spark, tmp_path):
    lines = records(4)
    (tmp_path / "x.json").write_text("\n".join([lines[0], lines[1][:-30], "garbage", *lines[2:]]))
    store = Store(spark, str(tmp_path / "store"))
    result = ingest_files(store, str(tmp_path / "x.json"), lines=True)
    assert (result.total_raw_records, result.broken_records, result.new_events, result.removed_dropped) == (5, 2, 3, 0)
    assert [r.reason for r in store.read("quarantine_events").collect()] == ["not JSON"] * 2
    assert store.read("etl_log").first().broken_records == 2


def test_exports_of_one_name_keep_their_order(spark, tmp_path):
    for year, n in (("2023", 1), ("2024", 9)):
        (tmp_path / year).mkdir()
        text = [RECORD.replace("Watched A", f"Watched {year}") % (1, 1, 1)] * n
        (tmp_path / year / "watch-history.json").write_text("[" + ",".join(text) + "]")
    raw = read_export(spark, [str(tmp_path / "2024"), str(tmp_path / "2023")])
    assert "2023" in raw.orderBy("file_name", "pos").first().title


def test_failed_requests_flip_nothing(spark, tmp_path):
    good = '{"items":[{"id":"v1","snippet":{"description":"d"},"contentDetails":{"duration":"PT5S"},"statistics":{}}]}'
    (tmp_path / "batch-0.json").write_text(good)
    (tmp_path / "batch-1.json").write_text(good[:-20])
    (tmp_path / "batch-2.json").write_text('{"error": {"code": 403}}')
    path = str(tmp_path)
    answers = read_responses(spark, path).select("file_name", "answered")
    batches = spark.createDataFrame([(f"v{k}", (k - 1) // 2) for k in range(1, 9)], "video_id string, batch long")
    attempted = attempts(batches, answers)
    assert {r.video_id for r in attempted.where("answered").collect()} == {"v1", "v2"}
    videos = batches.select("video_id", F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    flipped = flip_missing(videos, attempted, read_metadata(spark, path), now).where("status = 'unavailable'")
    assert [r.video_id for r in flipped.collect()] == ["v2"]


def test_repeated_updates_leave_one_row(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    new = spark.createDataFrame([("a", 5), ("a", 7), ("a", None)], "k string, x int")
    assert sorted(update_from(old, new, "k", ["x"]).collect()) == [("a", 7), ("b", 2)]


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).first().c is None
    texts = spark.createDataFrame([("x", "!!!"), ("y", "word"), ("z", "other term")], "video_id string, text string")
    rows = {r.video_id: r for r in HashedTermsEncoder.fit(texts, 64).encode(texts).collect()}
    assert rows["x"].embedding is None and rows["x"].error == NO_TEXT and rows["y"].error is None
    zero = BatchEncoder(lambda t: np.array([[0.0, 0.0] if x == "!!!" else [3.0, 4.0] for x in t]), "m")
    rows = {r.video_id: r for r in zero.encode(texts).collect()}
    assert rows["x"].error == NO_TEXT and rows["x"].embedding is None and rows["y"].embedding == pytest.approx([0.6, 0.8])


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default=None: folder),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
        )

    assert shared_dir(session("local[4]"))
    assert shared_dir(session("spark://host:7077", "hdfs:///tmp/x")) == "hdfs:///tmp/x"
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
