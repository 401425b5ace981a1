"""License scan against a brute-force version of the base rules, its SQL, and planted texts."""

from __future__ import annotations

import re

import duckdb
import pytest
from conftest_llm import sentence
from pyspark.sql import functions as F

from watchloom.llm import licenses

MIT = licenses.TEXTS["mit-text"]


def planted():
    words = MIT.split()
    changed = " ".join(w if k % 25 else "another" for k, w in enumerate(words))
    longer = " ".join([*words[:30], "and", "more", *words[30:50], *words[53:]])
    return [
        (1, "Released under the MIT License. Under the mit-license, too; MIT\nLICENSE!"), (2, "GNU General Public License, general public general public license"),
        (3, "the KK mit licenses, mit licensé émit license apache  license"), (4, sentence(1, 50) + MIT + sentence(2, 50)),
        (5, sentence(3, 20) + changed), (6, longer + "\n" + longer), (7, " ".join(words[:40])), (8, None), (9, ""), (10, "mit"),
        (11, "Licensed under CC BY-NC 4.0."), (12, licenses.TEXTS["gpl-text"].upper()), (13, MIT.replace(" ", "  x ")),
        (14, " ".join(words[len(words) // 2:]) + " " + " ".join(words[:len(words) // 2])), (15, "É apache license " * 50),
        *[(20 + k, text) for k, text in enumerate(licenses.TEXTS.values())],
    ]


def brute_base(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for label, phrase in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return (
        len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))
    )


@pytest.fixture(scope="module")
def result(spark):
    df = licenses.labelled(spark.createDataFrame(planted(), "doc_id long, text string"))
    return {r.doc_id: r for r in df.collect()}


def test_base_against_brute_force(result):
    for doc_id, text in planted():
        r = result[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text), text


def test_planted_texts(result):
    labels = {k: r.labels.split(",") for k, r in result.items()}
    assert all("mit-text" in labels[k] for k in (4, 5, 6, 20)) and not any("mit-text" in labels[k] for k in (7, 13, 14))
    assert labels[11] == ["cc-by", "cc-by-nc"] and "gpl-text" in labels[12]
    assert all(label in labels[20 + k] for k, label in enumerate(licenses.TEXTS))
    assert result[4].score == 1.0 and 0.6 <= result[5].score < 1.0 and result[7].score == 0.0 and result[15].n_base == 50
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in result.values())


def test_spans(spark):
    _, found = licenses.scan(spark.createDataFrame([(1, sentence(1, 50) + " " + MIT)], "doc_id long, text string"))
    [r] = found.where("label = 'mit-text'").collect()
    assert r["first"] == 50 and r["last"] == 50 + len(re.findall("[A-Za-z0-9]+", MIT)) - 1


def test_against_sql(spark, odd_rows):
    rows = planted() + [r[:2] for r in odd_rows]
    got = licenses.labelled(spark.createDataFrame(rows, "doc_id long, text string"))
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(rows, "doc_id long, text string").toArrow())
    want = con.sql(licenses.sql())
    names = got.columns
    key = lambda t: [(x is None, x) for x in t]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.select(*names).fetchall(), key=key)


def test_odd_rows(spark, odd, empty):
    extra = odd.withColumn("words", F.lit(1)).withColumn("label", F.lit("x")).withColumn("uid", F.lit(1))
    assert licenses.labelled(extra).count() == odd.count()
    assert licenses.labelled(empty).collect() == []


def test_native(spark, odd):
    plan = licenses.labelled(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
