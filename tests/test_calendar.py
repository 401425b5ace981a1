from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from watchloom.functions import calendar as K
from watchloom.sources.dims import dim_categories, dim_date


def test_local_time_follows_daylight_saving(spark):
    at = [datetime(2024, 3, 31, 0, 59, 59), datetime(2024, 3, 31, 1, 0), datetime(2024, 10, 27, 0, 30),
          datetime(2024, 10, 27, 1, 30), datetime(2023, 12, 31, 23, 30)]
    rows = spark.createDataFrame([(t,) for t in at], "t timestamp_ntz")
    got = [tuple(r) for r in rows.select(K.local_ts("t"), K.local_date("t"), K.local_hour("t")).collect()]
    zone = ZoneInfo("Europe/Copenhagen")
    for t, (local, day, hour) in zip(at, got):
        want = t.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone).replace(tzinfo=None)
        assert (local, day, hour) == (want, want.date(), want.hour)


def test_dim_date(spark):
    rows = {r["date_key"]: r for r in dim_date(spark, "2020-01-01", "2021-12-31").collect()}
    assert len(rows) == 731
    r = rows[date(2021, 1, 1)]
    assert (r.week_of_year, r.day_of_week, r.day_of_week_num, r.season, r.is_danish_holiday) == (
        53, "Friday", 5, "Winter", True)
    for d, r in rows.items():
        assert r.day_of_week_num == (d.weekday() + 1) % 7
        assert r.is_weekend == (d.weekday() >= 5)
        assert r.week_of_year == d.isocalendar().week
        assert (r.year, r.quarter, r.month, r.day_of_month) == (d.year, (d.month + 2) // 3, d.month, d.day)
        assert r.month_name == d.strftime("%B")
    holidays = {(d.month, d.day) for d, r in rows.items() if r.is_danish_holiday}
    assert holidays == {(1, 1), (6, 5), (12, 24), (12, 25), (12, 26), (12, 31)}
    assert rows[date(2020, 2, 29)].day_of_month == 29


def test_categories(spark):
    rows = dim_categories(spark).collect()
    assert len(rows) == 32
    assert [r.category_id for r in rows if r.category_name == "Comedy"] == [23, 34]


def test_differences(spark):
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 1) + timedelta(minutes=45, microseconds=1)
    row = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz").select(
        K.minutes_between(F.col("a"), F.col("b")), K.span_days(F.col("a"), F.col("b"))).first()
    assert abs(row[0] - 45.0000000167) < 1e-8
    assert abs(row[1] - 45 / 1440) < 1e-8
