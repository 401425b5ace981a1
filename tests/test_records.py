from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from watchloom.functions import records as R
from watchloom.functions.metadata import iso_seconds
from watchloom.functions.stages import funnel_stage, safe_ratio


@pytest.mark.parametrize(
    "url,expected",
    [
        ("https://video.example/watch?v=hMEyBtsuAJE", "hMEyBtsuAJE"),
        ("https://video.example/watch?list=x&v=a1&t=5#top", "a1"),
        ("https://video.example/watch?v=&v=b", "b"),
        ("https://video.example/watch?v=", None),
        ("https://video.example/watch?vv=a", None),
        ("https://video.example/watch?v=a%2Fb+c", "a/b c"),
        ("https://video.example/watch?v=100%+x", "100% x"),
        ("https://video.example/watch?title=a b|c&v=z", "z"),
        ("https://video.example/watch#?v=a", None),
        ("http://[bad/watch?v=a", None),
        ("watch?v=rel", "rel"),
        ("no query", None),
        ("", None),
        (None, None),
    ],
)
def test_video_id(one, url, expected):
    assert one(R.video_id(F.col("u")), u=url) == expected


@pytest.mark.parametrize(
    "details,expected",
    [
        ('[{"name":"From Google Ads"}]', True),
        ('["x",{"name":"From Google Ads"}]', True),
        ('[{"name":"Other"},{"name":3}]', False),
        ("{}", False),
        ('{"name":"From Google Ads"}', False),
        ("[]", False),
        (None, False),
    ],
)
def test_is_ad(one, details, expected):
    assert one(R.is_ad(F.try_parse_json(F.col("d"))), d=details) is expected


@pytest.mark.parametrize(
    "title,ghost,cleaned",
    [
        ("Watched A", False, "A"),
        ("Watched https://x/watch?v=a", True, None),
        ("Watched http://x", True, None),
        ("I Watched https://x", False, "I Watched https://x"),
        ("Watched https://x Watched y", True, None),
        ("Watched ", False, None),
        ("Watched    ", False, None),
        (" Watched https://x", True, "Watched https://x"),
        ("Watched  https://x", True, "https://x"),
        (" Padded\n", False, "Padded"),
        ("", False, None),
        (None, False, None),
    ],
)
def test_titles(one, title, ghost, cleaned):
    assert one(R.is_ghost(F.col("t")), t=title) is ghost
    assert one(R.clean_title(F.col("t")), t=title) == cleaned


@pytest.mark.parametrize(
    "subtitles,name,url",
    [
        ('[{"name":"C","url":"u"},{"name":"D"}]', "C", "u"),
        ('[{"name":"C"}]', "C", None),
        ("[]", None, None),
        ('["x"]', None, None),
        ('"x"', None, None),
        ("{}", None, None),
        (None, None, None),
    ],
)
def test_channel(one, subtitles, name, url):
    parsed = F.try_parse_json(F.col("s"))
    assert one(R.channel_name(parsed), s=subtitles) == name
    assert one(R.channel_url(parsed), s=subtitles) == url


def test_record_class_priority(one):
    kind = R.record_class(F.try_parse_json(F.col("d")), F.col("u"), F.col("t"))
    ad = '[{"name":"From Google Ads"}]'
    assert one(kind, d=ad, u=None, t="Watched x") == "ad"
    assert one(kind, d=None, u="", t="Watched http://x") == "removed"
    assert one(kind, d=None, u="u", t="Watched http://x") == "ghost"
    assert one(kind, d=None, u="u", t=None) == "clean"


def test_status_and_time(one):
    assert one(R.initial_status(F.col("t")), t="A") == "active"
    assert one(R.initial_status(F.col("t")), t=None) == "unavailable"
    assert one(R.utc_time(F.col("t")), t="2024-01-01T10:00:00.123Z") == datetime(2024, 1, 1, 10, 0, 0, 123000)
    assert one(R.utc_time(F.col("t")), t="2024-01-01T10:00:00+02:00") == datetime(2024, 1, 1, 8)
    assert one(R.utc_time(F.col("t")), t="soon") is None


@pytest.mark.parametrize(
    "text,seconds",
    [
        ("PT1H2M3S", 3723), ("PT30S", 30), ("PT0S", 0), ("P1DT2H", 93600), ("P", 0), ("PT", 0),
        ("P2D", 172800), ("x", None), ("PT5", None), ("PT1S ", None), ("PT1S\n", None),
        ("", None), (None, None),
    ],
)
def test_iso_seconds(one, text, seconds):
    assert one(iso_seconds(F.col("d")), d=text) == seconds


@pytest.mark.parametrize(
    "views,days,span,stage",
    [
        (1, 1, 0, "Discovery"), (2, 1, 0, "Casual"), (5, 5, 90, "Casual"), (6, 3, 0, "Regular"),
        (20, 3, 90, "Regular"), (6, 2, 90, "Casual"), (21, 7, 30, "Loyal"), (21, 7, 29.9, "Casual"),
        (21, 6, 300, "Casual"),
    ],
)
def test_funnel_stage(one, views, days, span, stage):
    assert one(funnel_stage(F.lit(views), F.lit(days), F.lit(float(span)))) == stage


def test_safe_ratio(one):
    assert float(one(safe_ratio(F.lit(5), F.lit(4)))) == 1.3
    assert one(safe_ratio(F.lit(5), F.lit(0))) is None
