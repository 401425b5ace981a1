from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from watchloom.operators import ordering
from watchloom.operators.sessions import session_summary, sessions, transitions
from watchloom.plans.views import channel_funnel, discovery_events

T0 = datetime(2024, 3, 30, 22, 0)


@pytest.fixture(scope="module")
def events(spark):
    """Tied times, a channel with most of the events, events without channel."""
    rnd = random.Random(5)
    at, rows = 0, []
    for i in range(3000):
        at += rnd.choice([0, 0, 1, 30, 600, 2700, 2701, 4000])
        channel = rnd.choice([1, 1, 1, 1, 2, 3, None, rnd.randrange(4, 40)])
        rows.append((i, f"v{rnd.randrange(60)}", channel, T0 + timedelta(seconds=at, microseconds=rnd.choice([0, 5]))))
    rnd.shuffle(rows)
    return spark.createDataFrame(
        rows, "event_id bigint, video_id string, channel_id bigint, watched_at timestamp_ntz"
    ).repartition(6)


@pytest.mark.parametrize("key", ["channel_id", "video_id"])
def test_rank_by_time_equals_window(events, key):
    got = ordering.rank_by_time(events, key, "watched_at", "event_id", "r")
    naive = events.withColumn(
        "r", F.row_number().over(Window.partitionBy(key).orderBy("watched_at", "event_id")).cast("bigint")
    )
    assert sorted(got.select("event_id", "r").collect()) == sorted(naive.select("event_id", "r").collect())


def test_rank_with_missing_times(events):
    """Events without time come first, and the others go on behind them."""
    some = events.withColumn("watched_at", F.when(F.col("event_id") % 3 != 0, F.col("watched_at")))
    test_rank_by_time_equals_window(some, "channel_id")


def naive_sessions(events, gap):
    order = Window.orderBy("watched_at", "event_id")
    previous = F.lag("watched_at").over(order)
    gap_us = F.unix_micros(F.col("watched_at").cast("timestamp")) - F.unix_micros(previous.cast("timestamp"))
    flagged = events.withColumn("g", gap_us).withColumn(
        "f", F.when(F.col("g").isNull() | (F.col("g") > gap * 60_000_000), 1).otherwise(0))
    return flagged.withColumn("session_id", F.sum("f").over(order.rowsBetween(Window.unboundedPreceding, 0)))


@pytest.fixture(scope="module")
def crowded(spark, events):
    """A third of all events in one second, half of those at one time."""
    rows = [(10_000 + i * 40_000, "v1", 1, T0 + timedelta(hours=9, microseconds=(i % 2) * (i % 97))) for i in range(1500)]
    return events.unionByName(spark.createDataFrame(rows, events.schema)).repartition(5)


def test_rank_with_a_crowded_second(crowded):
    test_rank_by_time_equals_window(crowded, "channel_id")


def test_sessions_with_a_crowded_second(crowded):
    test_sessions_equal_naive_window(crowded, 10)


@pytest.mark.parametrize("gap", [1, 10, 45])
def test_sessions_equal_naive_window(events, gap):
    want = naive_sessions(events, gap)
    got = sessions(events, gap)
    pick = ["event_id", "session_id"]
    assert sorted(got.select(*pick).collect()) == sorted(want.select(*pick).collect())
    gaps = {r.event_id: r.g for r in want.collect()}
    for r in got.collect():
        g = gaps[r.event_id]
        assert r.gap_minutes is None if g is None else abs(r.gap_minutes - g / 60e6) < 1e-9
    per = want.groupBy("session_id").agg(F.count("*").alias("n"), F.min("watched_at"), F.max("watched_at"))
    want_totals = {r[0]: tuple(r)[1:] for r in per.collect()}
    assert {r.session_id: (r.session_video_count, r.session_start, r.session_end) for r in got.collect()} == want_totals
    summary = session_summary(events, gap).collect()
    assert {r.session_id: r.video_count for r in summary} == {k: v[0] for k, v in want_totals.items()}


def test_gap_is_strict(spark):
    rows = [(1, "a", None, T0), (2, "a", None, T0 + timedelta(minutes=45)),
            (3, "a", None, T0 + timedelta(minutes=90, microseconds=1))]
    e = spark.createDataFrame(rows, "event_id bigint, video_id string, channel_id bigint, watched_at timestamp_ntz")
    assert [r.session_id for r in sessions(e).orderBy("event_id").collect()] == [1, 1, 2]


def test_gap_smaller_than_leaf_is_refused(events):
    with pytest.raises(ValueError):
        sessions(events, gap_minutes=0.001)


def test_transitions_with_a_crowded_second(crowded):
    test_transitions_equal_naive(crowded)


def test_transitions_equal_naive(events):
    order = Window.partitionBy("session_id").orderBy("watched_at", "event_id")
    want = (
        naive_sessions(events, 45).withColumn("p", F.lag("channel_id").over(order))
        .where("p is not null and channel_id is not null")
        .groupBy("p", "channel_id").count()
    )
    assert sorted(tuple(r) for r in transitions(events).collect()) == sorted(tuple(r) for r in want.collect())


def single_partition_inputs(df) -> list[str]:
    """The operator below each exchange into a single partition."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    below = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below.append(re.sub(r"^[\s:|+*\-()\d]*", "", lines[i + 1]))
    return below


def test_no_single_partition_over_events(events):
    for df in (sessions(events), session_summary(events), transitions(events)):
        for child in single_partition_inputs(df):
            assert child.startswith(("HashAggregate", "SortAggregate", "Project")), child


def test_number_rows(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randrange(1000)) for _ in range(500)]
    df = spark.createDataFrame([(f, p, i) for i, (f, p) in enumerate(rows)], "f string, p bigint, i bigint")
    out = ordering.number_rows(
        df.withColumn("leaf", F.floor(F.col("p") / 50)), ["f"], ["leaf"], ["p", "i"], "n", start=7
    )
    got = [r.i for r in out.orderBy("n").collect()]
    assert got == [i for _, _, i in sorted((f, p, i) for i, (f, p) in enumerate(rows))]
    assert [r.n for r in out.orderBy("n").collect()] == list(range(8, 508))


def test_majority_tie_goes_to_first_seen(spark):
    rows = [("t", 5, "v3"), ("t", 6, "v1"), ("t", 6, "v9"), ("t", 5, "v2"), ("u", None, "v1"), ("w", 1, "v1")]
    df = spark.createDataFrame(rows, "topic string, c int, video_id string")
    got = {r.topic: r.c for r in ordering.majority(df, ["topic"], "c", "video_id").collect()}
    assert got == {"t": 6, "w": 1}


def test_batches(spark):
    df = spark.range(130).select(F.format_string("v%03d", "id").alias("video_id"))
    out = ordering.batch_number(ordering.quota_head(df, ["video_id"], 120), ["video_id"], 50).collect()
    assert len(out) == 120
    assert {r.batch: sum(x.batch == r.batch for x in out) for r in out} == {0: 50, 1: 50, 2: 20}


def test_discovery_flags_first_event_without_channel(events):
    channels = events.select("channel_id").dropna().distinct().withColumn("channel_name", F.lit("n"))
    found = discovery_events(events, channels).where("is_channel_discovery")
    assert found.where("channel_id is null").count() == 1
    assert found.count() == events.select("channel_id").distinct().count()


def test_approximate_distinct_counts(events):
    channels = events.select("channel_id").dropna().distinct().withColumn("channel_name", F.lit("n"))
    exact = {r.channel_id: r for r in channel_funnel(events, channels).collect()}
    near = {r.channel_id: r for r in channel_funnel(events, channels, approx=True).collect()}
    assert exact.keys() == near.keys()
    for key, r in exact.items():
        assert near[key].total_views == r.total_views
        assert abs(near[key].unique_videos - r.unique_videos) <= 2
