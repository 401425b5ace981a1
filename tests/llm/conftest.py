from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from conftest_llm import sentence  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = sentence(99, 30_000)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, copies and near copies."""
    base = sentence(1, 60)
    near = base.split()
    near[30] = "changed"
    return [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (3, " ".join(near), "en", None, 10),
        (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n\x0b ", "de", "b", 5), (None, sentence(2, 50), "en", "a", 1),
        (7, LONG, "en", "c", 1), (8, "one two", None, "c", 7), (8, "one two", None, "c", 7), (9, "12345 !!! 999", "en", "d", 3),
        (10, sentence(3, 12) + "\n\n" + sentence(4, 12) + "\nshort", "fr", "d", 1), (None, None, None, None, None),
        (11, "Ünïcödé 😀 " + sentence(5, 20), "fr", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
