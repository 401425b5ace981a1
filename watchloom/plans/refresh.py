"""Refresh of the materialized views: what came since the last one is added to stored sums, and all views switch at once."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions.constants import LOCAL_ZONE, SESSION_GAP_MINUTES
from watchloom.operators.activity import activity, hours, merged_activity, merged_hours
from watchloom.operators.sessions import session_summary
from watchloom.plans import views
from watchloom.sources.dims import dim_date
from watchloom.sources.store import Snapshot, Store, retried

VIEWS = (
    "mv_daily_summary", "mv_monthly_summary", "mv_session_summary", "mv_channel_monthly", "mv_hourly_distribution", "mv_channel_funnel",
)
#: The mark that says which version of the store the views show.
SOURCE = "store"


class Views(Store):
    """Published views and the sums they are made from, with the versions and commits of a store and layouts of their own."""

    def stage(self, table: str, df: DataFrame) -> str:
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{table}/{folder}")
        return folder

    def read_folders(self, table: str, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{table}/{f}" for f in folders])


def refresh_all(
    store: Store,
    root: str,
    as_of: date | str,
    start: date | str = "2020-01-01",
    end: date | str = "2030-12-31",
    gap_minutes: float = SESSION_GAP_MINUTES,
    zone: str = LOCAL_ZONE,
    full: bool = False,
) -> dict[str, DataFrame]:
    """Brings the six materialized views below ``root`` up to the newest state of the store; returns them.

    Sums per day, channel and video, and per day and hour, are kept beside the views. If events were only added since the
    last refresh, just these are read and their sums are added; ``full`` (needed where the zone changes) or a rewritten
    table starts anew. Sessions are cut from all events, as their numbers follow from all. The views of one refresh are
    published in one commit: a reader with a snapshot sees the views of one refresh and no other, and one that fails
    changes nothing.
    """
    return retried(lambda: _refresh(store, Views(store.spark, root), as_of, start, end, gap_minutes, zone, full))


def _added(store: Store, old: Snapshot, now: Snapshot) -> DataFrame | None:
    """Events that came since the views' last refresh, or None where that cannot be told."""
    since = old.epochs.get(SOURCE)
    if since is None or since not in store.versions():
        return None
    return store.added("fact_watch_events", store.snapshot(since), now)


def _refresh(store, published: Views, as_of, start, end, gap_minutes, zone, full) -> dict[str, DataFrame]:
    now, old = store.snapshot(), published.snapshot()
    events, channels = store.read("fact_watch_events", now), store.read("dim_channels", now)
    dates = dim_date(store.spark, start, end)
    fresh = None if full else _added(store, old, now)
    kept = {} if fresh is None else {t: old.tables[t] for t in ("activity", "hours")}
    source = events if fresh is None else fresh
    sums = {
        "activity": kept.get("activity", []) + [published.stage("activity", activity(source, zone))],
        "hours": kept.get("hours", []) + [published.stage("hours", hours(source, zone))],
    }
    base = merged_activity(published.read_folders("activity", sums["activity"]))
    per_hour = merged_hours(published.read_folders("hours", sums["hours"]))
    built = {
        "mv_daily_summary": views.daily_summary(events, dates, as_of, zone, base),
        "mv_monthly_summary": views.monthly_summary(events, dates, as_of, start, zone, base),
        "mv_session_summary": session_summary(events, gap_minutes, zone),
        "mv_channel_monthly": views.channel_monthly(events, channels, dates, zone, base),
        "mv_hourly_distribution": views.hourly_distribution(events, dates, zone, per_hour),
        "mv_channel_funnel": views.channel_funnel(events, channels, zone, base),
    }
    folders = {name: [published.stage(name, view)] for name, view in built.items()}
    made = published.publish(
        tables=sums | folders, based_on=old, reads=("activity", "hours"), marks={SOURCE: now.version}
    )
    return {name: published.read(name, made) for name in VIEWS}
