from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from watchloom.functions import constants as C
from watchloom.functions import text as X


def expected_cleaning(text):
    """The cleaning rules applied one after the other by Python's own engine."""
    out = text or ""
    for pattern, flags in (
        (C.URL_PATTERN, 0), (C.CLOCK_PATTERN, 0), (C.HASHTAG_PATTERN, 0),
        (C.CALL_TO_ACTION_PATTERN, re.IGNORECASE), (C.SOCIAL_PATTERN, re.IGNORECASE),
        (r"\s{2,}", 0),
    ):
        out = re.sub(pattern, " ", out, flags=flags)
    return out.strip()[: C.DESCRIPTION_CHARS]


CASES = [
    None, "", "   ", "plain text", "see https://a.b/c?d=e now", "www.x.org\tend", "at 1:23 and 01:02:03!",
    "12:345 no", "#tag #Ærø middle #", "SUBSCRIBE now", "Link In The Bio please", "link in bio",
    "use code ÅBC12 today", "This Video Is Sponsored by X", "Twitter: @someone else",
    "follow on INSTAGRAM-name rest", "reddit", "a  b  c", "x" * 600,
    "ſubscribe Kiosk linK in bİo", "sub#tag scribe", "line\n\n\nline",
    "the bell", "hit the bell https://t.co/x", "facebook", "discord @ me now",
]


def test_clean_description_matches_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    got = dict(rows.select("i", X.clean_description(F.col("t"))).collect())
    assert got == {i: expected_cleaning(t) for i, t in enumerate(CASES)}


PIECES = st.sampled_from(
    ["subscribe", "Twitter", ":", " ", "\n", "@", "a", "é", "#", "12:30", "https://", "www.", "link in ",
     "the ", "bio", "use code ", "ſ", "K", "İ", "-", "_", "5", " ", "sponsored by"]
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=40, max_size=60))
def test_clean_description_property(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(rows.select("i", X.clean_description(F.col("t"))).collect())
    assert got == {i: expected_cleaning(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    "title,tags,description,expected",
    [
        ("A", ["x", " y "], "d", "A. x, y. d"),
        (" A ", None, None, "A"),
        (None, ["x"], "", "x"),
        ("  ", ["x"], None, ". x"),
        ("A", [" ", ""], "d", "A. . d"),
        ("A", [], "https://x", "A"),
        (None, None, None, ""),
    ],
)
def test_input_text(spark, title, tags, description, expected):
    row = spark.createDataFrame([(title, tags, description)], "t string, g array<string>, d string")
    assert row.select(X.input_text(F.col("t"), F.col("g"), F.col("d"))).first()[0] == expected


@pytest.mark.parametrize(
    "text,lang",
    [
        ("smørrebrød", "da"), ("straße", "de"), ("señor", "es"), ("¿qué?", "es"), ("привет", "ru"),
        ("مرحبا", "ar"), ("日本", "ja"), ("ひらがな", "ja"), ("한국", "ko"), ("საქართველო", "ka"),
        ("straße på ø", "da"), ("plain", None), ("café", None), ("", None), (None, None),
    ],
)
def test_script_language(one, text, lang):
    assert one(X.script_language(F.col("t")), t=text) == lang


@pytest.mark.parametrize(
    "answer,lang",
    [
        ("en", "en"), (" DA\n", "da"), ("Code: fr.", "fr"), ("is french", None), ("eng", None),
        ("xx or en", None), ("", None), (None, None),
    ],
)
def test_parse_language_answer(one, answer, lang):
    assert one(X.parse_language_answer(F.col("t")), t=answer) == lang


@pytest.mark.parametrize(
    "label,expected",
    [
        ('"Space Travel"', "Space Travel"), ("' x '", "x"), ('""q""', '"q"'), ("I'm sorry, no", None),
        ("I Cannot say", None), ("   ", None), ("y" * 120, "y" * 100), (None, None),
        ("We said I cannot", "We said I cannot"),
    ],
)
def test_clean_label(one, label, expected):
    assert one(X.clean_label(F.col("t")), t=label) == expected


def test_keyword_label(spark):
    words = ["war drugs", "it's o'clock", "foo-bar", "x1y", "fifth"]
    row = spark.createDataFrame([(words,)], "k array<string>")
    want = " / ".join(w.title() for w in words[:4])
    assert row.select(X.keyword_label(F.col("k"))).first()[0] == want


def test_document_or_unknown(one):
    assert one(X.document_or_unknown(F.col("t")), t=" \t") == "unknown"
    assert one(X.document_or_unknown(F.col("t")), t="a ") == "a "


def test_tokens_and_terms(spark):
    row = spark.createDataFrame([("The War on_Drugs, été a 7 77!",)], "t string")
    words = row.select(X.tokens(F.col("t"))).first()[0]
    assert words == ["war", "on_drugs", "été", "77"]
    terms = row.select(X.terms(X.tokens(F.col("t")))).first()[0]
    assert terms == words + ["war on_drugs", "on_drugs été", "été 77"]
    empty = spark.createDataFrame([("a",)], "t string")
    assert empty.select(X.terms(X.tokens(F.col("t")))).first()[0] == []
