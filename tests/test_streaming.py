from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchloom.operators.sessions import session_summary
from watchloom.streaming.sessions import viewer_sessions, write_sessions


def test_append_mode_emits_closed_sessions(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.randrange(5), datetime(2024, 1, 1) + timedelta(minutes=rnd.randrange(60 * 24 * 20))) for _ in range(600)]
    events = spark.createDataFrame(rows, "viewer bigint, watched_at timestamp_ntz").dropDuplicates()
    source = str(tmp_path / "events")
    events.coalesce(2).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    write_sessions(viewer_sessions(stream, watermark="1 day"), out, cp).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).select("viewer", "video_count", "session_start", "session_end").collect()}
    batch = {tuple(r) for r in viewer_sessions(events).select("viewer", "video_count", "session_start", "session_end").collect()}
    last = max(r[1] for r in rows)
    closed = {b for b in batch if b[3] + timedelta(minutes=45) <= last - timedelta(days=1)}
    assert closed <= got <= batch


def test_batch_twin_equals_gap_rule(spark):
    rows = [(i, i % 3, datetime(2024, 1, 1) + timedelta(minutes=45 * (i // 3)) + timedelta(microseconds=i % 7))
            for i in range(300)]
    e = spark.createDataFrame(rows, "event_id bigint, viewer bigint, watched_at timestamp_ntz")
    gap_rule = session_summary(e, keys=["viewer"])
    windows = viewer_sessions(e)
    assert sorted(r.video_count for r in gap_rule.collect()) == sorted(r.video_count for r in windows.collect())
    assert gap_rule.agg(F.sum("video_count")).first()[0] == 300
