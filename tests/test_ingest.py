from __future__ import annotations

import json
from datetime import datetime

import pytest

from watchloom.plans.ingest import ingest_files, parse, total_ever_watched
from watchloom.plans.refresh import refresh_all
from watchloom.plans.views import etl_history
from watchloom.sources.export import read_export
from watchloom.sources.store import Store
from watchloom.streaming.ingest import stream_exports


def record(video, minute, title=None, channel="C", ad=False, time=None):
    r = {
        "title": f"Watched {title or 'T' + video}",
        "titleUrl": f"https://video.example/watch?v={video}",
        "time": time or f"2024-05-01T10:{minute:02d}:00Z",
    }
    if channel:
        r["subtitles"] = [{"name": channel, "url": "u/" + channel}]
    if ad:
        r["details"] = [{"name": "From Google Ads"}]
    return r


def ghost(video, minute):
    url = f"https://video.example/watch?v={video}"
    return {"title": f"Watched {url}", "titleUrl": url, "time": f"2024-05-01T11:{minute:02d}:00Z"}


FIRST = [
    ghost("g1", 0),
    record("a1", 1),
    record("a1", 1, title="again"),
    record("a2", 2, channel="D"),
    record("ad", 3, ad=True),
    {"title": "Watched x", "time": "2024-05-01T10:04:00Z"},
    ghost("a2", 5),
    {"title": "Watched B", "titleUrl": "https://video.example/none", "time": "2024-05-01T10:06:00Z"},
    record("a3", 7, channel=None),
    record("bad", 0, time="yesterday"),
]
SECOND = FIRST + [record("g1", 20, title="Found"), record("a4", 21, channel="E"), record("a1", 22)]


@pytest.fixture
def exports(tmp_path):
    for name, rows in (("one", FIRST), ("two", SECOND)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    return tmp_path


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_read_export_keeps_order_and_shapes(spark, exports):
    rows = read_export(spark, str(exports / "one.json")).orderBy("pos").collect()
    assert [r.titleUrl for r in rows] == [r.get("titleUrl") for r in FIRST]
    assert {r.file_name.rsplit("/", 1)[-1] for r in rows} == {"one.json"} and "/" in rows[0].file_name


def test_load_and_counts(store, exports):
    r = ingest_files(store, str(exports / "one.json"))
    assert (r.total_raw_records, r.ads_filtered, r.removed_dropped, r.ghost_videos_kept, r.clean_records) == (
        10, 1, 1, 2, 6)
    # a1 twice at the same minute is one event; the record without a time is set aside.
    assert (r.new_channels, r.new_videos, r.new_events, r.duplicate_events) == (2, 5, 5, 1)
    videos = {v.video_id: v for v in store.read("dim_videos").collect()}
    assert videos["a1"].title == "Ta1" and videos["a1"].status == "active"
    assert videos["g1"].title is None and videos["g1"].status == "unavailable"
    assert videos["a2"].title == "Ta2"
    channels = {c.channel_name: c.channel_id for c in store.read("dim_channels").collect()}
    assert channels == {"C": 1, "D": 2}
    events = store.read("fact_watch_events").orderBy("event_id").collect()
    assert [e.event_id for e in events] == [1, 2, 3, 4, 5]
    assert [e.video_id for e in events] == ["a1", "a2", "a3", "g1", "a2"]
    assert [e.channel_id for e in events] == [1, 2, None, None, None]
    assert [q.video_id for q in store.read("quarantine_events").collect()] == ["bad"]


def test_overlapping_and_repeated_loads(store, exports):
    ingest_files(store, str(exports / "one.json"), now=datetime(2024, 6, 1))
    before = {v.video_id: v for v in store.read("dim_videos").collect()}
    r = ingest_files(store, str(exports / "two.json"), now=datetime(2024, 6, 2))
    assert (r.new_channels, r.new_videos, r.new_events, r.duplicate_events) == (1, 1, 3, 6)
    after = {v.video_id: v for v in store.read("dim_videos").collect()}
    assert after["g1"] == before["g1"]  # a stored ghost is not improved
    assert {c.channel_name: c.channel_id for c in store.read("dim_channels").collect()}["E"] == 3
    again = ingest_files(store, str(exports / "two.json"), now=datetime(2024, 6, 3))
    assert (again.new_channels, again.new_videos, again.new_events, again.duplicate_events) == (0, 0, 0, 9)
    events = store.read("fact_watch_events")
    assert events.count() == events.select("video_id", "watched_at").distinct().count() == 8
    assert sorted(e.event_id for e in events.collect()) == list(range(1, 9))
    history = etl_history(store.read("etl_log")).collect()
    assert [h.file_name for h in history] == ["two.json", "two.json", "one.json"]
    assert history[0].run_at_dk == datetime(2024, 6, 3, 2)
    total = total_ever_watched(events, store.read("etl_log")).first()
    assert tuple(total) == (8, 3, 11)


def test_failed_load_leaves_nothing_visible(store, exports, monkeypatch):
    ingest_files(store, str(exports / "one.json"))
    before = store.folders()
    monkeypatch.setattr(Store, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ingest_files(store, str(exports / "two.json"))
    assert store.folders() == before
    assert store.read("fact_watch_events").count() == 5


def test_reset_and_counts(store, exports):
    ingest_files(store, str(exports / "one.json"))
    counts = {r.table_name: r.row_count for r in store.table_counts().collect()}
    assert counts["dim_videos"] == 5 and counts["nlp_topics"] == 0
    store.compact("fact_watch_events")
    assert store.read("fact_watch_events").count() == 5
    store.reset()
    assert all(r.row_count == 0 for r in store.table_counts().collect())


def test_stream_equals_batch(spark, store, exports, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "one.json").write_text(json.dumps(FIRST))
    checkpoint = str(tmp_path / "cp")
    stream_exports(store, str(inbox), checkpoint).awaitTermination()
    (inbox / "two.json").write_text(json.dumps(SECOND))
    stream_exports(store, str(inbox), checkpoint).awaitTermination()
    batch = Store(spark, str(tmp_path / "batch"))
    for name in ("one", "two"):
        ingest_files(batch, str(exports / f"{name}.json"))
    for table in ("fact_watch_events", "dim_channels"):
        columns = [c for c in store.read(table).columns if c != "created_at"]
        assert sorted(map(str, store.read(table).select(*columns).collect())) == sorted(
            map(str, batch.read(table).select(*columns).collect()))


def test_parse_equals_landed_parse(spark, exports):
    raw = read_export(spark, str(exports / "two.json"))
    from watchloom.plans.ingest import kept, land

    direct = parse(raw)
    landed = kept(land(raw)).select(*direct.columns)
    assert sorted(map(str, direct.collect())) == sorted(map(str, landed.collect()))


def test_refresh(store, exports, tmp_path):
    ingest_files(store, str(exports / "two.json"))
    built = refresh_all(store, str(tmp_path / "views"), "2024-12-31")
    assert built["mv_daily_summary"].where("videos_watched > 0").count() == 1
    assert built["mv_daily_summary"].count() == 366 + 365 * 3 + 366
    month = built["mv_monthly_summary"].where("year = 2024 and month = 5").first()
    assert (month.total_views, month.active_days, float(month.avg_videos_per_active_day)) == (8, 1, 8.0)
    assert built["mv_session_summary"].count() == 1
    assert built["mv_channel_funnel"].count() == 3
