"""Refreshes that read only what came since, and publish all views at once."""

from __future__ import annotations

import json
import os

import pytest

from watchloom.operators import activity
from watchloom.plans import refresh, views
from watchloom.plans.ingest import ingest_files
from watchloom.sources.store import Store

AS_OF, START, END = "2024-12-31", "2024-01-01", "2024-12-31"


def export(tmp_path, name, days):
    rows = [
        {"title": f"Watched V{d}", "titleUrl": f"https://y/watch?v=v{d % 7}", "time": f"2024-{1 + d % 9:02d}-{1 + d % 27:02d}T{d % 24:02d}:30:00Z",
         "subtitles": [{"name": f"C{d % 4}", "url": f"u/{d % 4}"}]}
        for d in days
    ]
    (tmp_path / name).write_text(json.dumps(rows))
    return str(tmp_path / name)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(built):
    return {name: sorted(map(str, df.collect())) for name, df in built.items()}


def test_delta_equals_full(spark, store, tmp_path, monkeypatch):
    root = str(tmp_path / "views")
    run = lambda where, **more: refresh.refresh_all(store, where, AS_OF, START, END, **more)
    ingest_files(store, export(tmp_path, "one.json", range(0, 40)))
    first = run(root)
    before = rows(first)
    ingest_files(store, export(tmp_path, "two.json", range(20, 70)))
    read = []
    monkeypatch.setattr(refresh, "activity", lambda e, z, own=activity.activity: read.append(e.count()) or own(e, z))
    second = run(root)
    assert read == [30]  # the repeated events are not new
    want = rows(run(str(tmp_path / "full")))
    assert read == [30, 70] and rows(second) == want != before
    # Who holds the first refresh still reads all of it.
    assert rows(first) == before
    published = refresh.Views(spark, root)
    assert published.versions() == [1, 2] and set(published.folders()) == {*refresh.VIEWS, "activity", "hours"}
    assert len(published.folders()["activity"]) == 2
    # A rewritten table cannot be followed; sums start anew.
    store.compact("fact_watch_events")
    assert rows(run(root)) == want and read[-1] == 70 and len(published.folders()["activity"]) == 1
    # Nothing new: no event is read.
    assert rows(run(root)) == want and read[-1] == 0


def test_failed_refresh_changes_nothing(spark, store, tmp_path, monkeypatch):
    root = str(tmp_path / "views")
    ingest_files(store, export(tmp_path, "one.json", range(0, 10)))
    refresh.refresh_all(store, root, AS_OF, START, END)
    published = refresh.Views(spark, root)
    before = published.snapshot()

    def broken(*args, **kwargs):
        raise RuntimeError("no space")

    monkeypatch.setattr(views, "channel_funnel", broken)
    ingest_files(store, export(tmp_path, "two.json", range(10, 20)))
    with pytest.raises(RuntimeError):
        refresh.refresh_all(store, root, AS_OF, START, END)
    assert published.snapshot() == before
    folders = set(os.listdir(f"{root}/activity"))
    assert published.vacuum(older_than=-10) > 0 and set(os.listdir(f"{root}/activity")) < folders
    assert published.read("mv_daily_summary").count() == 366
