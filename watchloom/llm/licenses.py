"""License scan by diagonal voting: word grams joined to their places in templates, votes per diagonal, spans compared word by word.

Built-in expressions only. A place of a gram in a text less its place in a template is its diagonal; a copy of the template
puts all its grams on one, and words put in or left out move the rest to a neighbouring one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.llm.common import documents
from watchloom.session import materialize

#: What separates words: ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a gram: of phrases, which count only as a whole, and of texts.
PHRASE, TEXT = 2, 4
#: Phrases of the base rules and their labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Further phrases.
PHRASES = {
    "bsd": "bsd license", "isc": "isc license", "cc-by": "cc by", "cc-by-nc": "cc by nc", "cc-by-sa": "cc by sa", "cc0": "cc0 1 0",
    "mpl": "mozilla public license", "creative-commons": "creative commons attribution", "proprietary": "all rights reserved",
}
#: License texts and notices, as they are published. Their labels end in "-text".
TEXTS = {
    "mit-text": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software.""",
    "apache-text": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    "gpl-text": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd-text": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc-text": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.""",
}
#: Neighbouring diagonals this close are one copy; a text is found if this share of its words stands in one.
SLACK, SHARE = 6, 0.6


def words_of(text: Column) -> Column:
    """Words of a text column that is not null."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def template_words() -> list[tuple[str, str, int, list[str]]]:
    """(label, kind, words of a gram, words) of every template."""
    import re

    def cut(text: str) -> list[str]:
        return re.findall(r"[a-z0-9]+", text.lower())

    return (
        [(label, "base", PHRASE, cut(text)) for label, text in BASE.items()]
        + [(label, "phrase", PHRASE, cut(text)) for label, text in PHRASES.items()]
        + [(label, "text", TEXT, cut(text)) for label, text in TEXTS.items()]
    )


def gram_hash(size: int, words: Column, i: Column) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, i + k) for k in range(size)])


def grams(words: Column, size: int) -> Column:
    """Hashes of all rolling grams of an array of words."""
    last = F.size(words) - size
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: gram_hash(size, words, i))
    )


def template_grams(spark: SparkSession) -> DataFrame:
    """h, template, spot, k, gram: every gram of every template with its place; some hundred rows."""
    rows = [
        (label, kind, k, len(words), spot, words[spot:spot + k])
        for label, kind, k, words in template_words() for spot in range(len(words) - k + 1)
    ]
    table = spark.createDataFrame(rows, "label string, kind string, k int, total int, spot int, gram array<string>")
    h = F.when(F.col("k") == PHRASE, gram_hash(PHRASE, F.col("gram"), F.lit(0))).otherwise(gram_hash(TEXT, F.col("gram"), F.lit(0)))
    return table.withColumn("h", h)


def votes(docs: DataFrame) -> DataFrame:
    """A row per text, with uid, doc_id and n_words, and one per gram that stands in a template, with label, kind, k, total,
    spot and diagonal besides.

    All grams of a text are joined by hash; a hit must have the template's words. A text's own row comes from a hash of
    its own in front of its grams, so that texts are read once.
    """
    spark = docs.sparkSession
    own = F.xxhash64(F.lit("text"))
    words = F.col("words")
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", words_of(F.coalesce(F.col("text"), F.lit(""))).alias("words")
    )
    rows = rows.select(
        "uid", "doc_id", "words", F.posexplode(F.concat(F.array(own), grams(words, PHRASE), grams(words, TEXT))).alias("at", "h")
    )
    places = template_grams(spark)
    mark = spark.range(1).select(
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("k"),
        F.lit(0).alias("total"), F.lit(0).alias("spot"), F.array().cast("array<string>").alias("gram"), own.alias("h"),
    )
    # Fixed by the templates, so fit to broadcast whatever the corpus.
    hits = rows.join(F.broadcast(places.unionByName(mark)), "h")
    first = F.greatest(F.size("words") - PHRASE + 1, F.lit(0))
    at = F.when(F.col("k") == TEXT, F.col("at") - 1 - first).otherwise(F.col("at") - 1)
    is_mark = (F.col("k") == 0) & (F.col("at") == 0)
    hits = hits.withColumn("place", at).where(
        is_mark | ((F.col("k") > 0) & (F.col("place") >= 0) & (F.slice("words", F.greatest(F.col("place"), F.lit(0)) + 1, F.col("k")) == F.col("gram")))
    )
    return hits.select(
        "uid", "doc_id", F.size("words").cast("long").alias("n_words"), "label", "kind", "k", "total", "spot",
        (F.col("place") - F.col("spot")).alias("diagonal"),
    )


def spans(hits: DataFrame) -> DataFrame:
    """uid, label, kind, first, last, share: where templates stand, first and last word of the span, from 0.

    Phrases stand where all their grams are on one diagonal. Texts: diagonals at most ``SLACK`` apart are one copy; the
    template's words that its grams cover must make up ``SHARE`` of it, in a span at most twice as long.
    """
    ballots = hits.where("label IS NOT NULL").groupBy("uid", "label", "kind", "k", "total", "diagonal").agg(
        F.collect_list("spot").alias("spots")  # at most one per word of the template
    )
    phrases = ballots.where((F.col("kind") != "text") & (F.size("spots") == F.col("total") - F.col("k") + 1)).select(
        "uid", "label", "kind", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("total") - 1).alias("last"),
        F.lit(1.0).alias("share"),
    )
    along = Window.partitionBy("uid", "label").orderBy("diagonal")
    # Diagonals of one text and template, which its own length bounds.
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > SLACK).cast("int")
    copies = ballots.where("kind = 'text'").withColumn("new", F.coalesce(apart, F.lit(0)))
    copies = copies.withColumn("copy", F.sum("new").over(along)).groupBy("uid", "label", "kind", "k", "total", "copy").agg(
        F.min(F.col("diagonal") + F.array_min("spots")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("spots") + F.col("k") - 1).alias("last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("spots"),
    )
    # Each gram covers the words up to the next one, k at most.
    steps = F.transform("spots", lambda s, i: F.least(F.col("k"), F.coalesce(F.get("spots", i + 1) - s, F.col("k"))))
    covered = F.aggregate(steps, F.lit(0), lambda total, step: total + step)
    copies = copies.withColumn("share", covered / F.col("total"))
    texts = copies.where((F.col("share") >= SHARE) & (F.col("last") - F.col("first") < 2 * F.col("total")))
    return phrases.unionByName(texts.select("uid", "label", "kind", "first", "last", "share"))


def scan(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, n_words of every row of ``df`` (doc_id, text), its ``spans``)."""
    hits = materialize(votes(df), "license-votes")
    return hits.where("label IS NULL").select("uid", "doc_id", "n_words"), spans(hits)


def labelled(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are the smallest and the largest of their starts.
    Labels are distinct, sorted and joined by commas. score is the largest share of a template that stands in the text: 1 for
    phrases, 0 if there is none. A null text counts as empty: no words, no labels. Rows that repeat are judged each on
    its own; an empty table gives none.
    """
    texts, found = scan(df.select("doc_id", "text"))
    base = F.col("kind") == "base"

    def joined(label: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(label)), ",")  # no more values than templates

    judged = found.groupBy("uid").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    return texts.join(judged, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    return labelled(documents(spark, sf_dir))


def sql() -> str:
    """The same in DuckDB: grams as texts, places joined to places."""
    templates = ", ".join(f"('{label}', '{kind}', {k}, {words})" for label, kind, k, words in template_words())
    return rf"""
WITH t(label, kind, k, words) AS (VALUES {templates}),
p AS (SELECT label, kind, k, len(words) AS total, i AS spot, array_to_string(words[i + 1:i + k], ' ') AS gram
  FROM t, unnest(range(0, len(words) - k + 1)) AS u(i)),
d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
g AS (SELECT r, k, i, array_to_string(words[i + 1:i + k], ' ') AS gram
  FROM d, unnest([{PHRASE}, {TEXT}]) AS s(k), unnest(range(0, greatest(len(words) - k + 1, 0))) AS u(i)),
b AS (SELECT r, label, kind, p.k, total, i - spot AS diagonal, count(*) AS n, list(spot) AS spots, min(i) AS low, max(i + p.k - 1) AS high
  FROM g JOIN p ON g.gram = p.gram AND g.k = p.k GROUP BY ALL),
whole AS (SELECT r, label, kind, diagonal AS first, 1.0::DOUBLE AS share FROM b WHERE kind <> 'text' AND n = total - k + 1),
c AS (SELECT *, sum(new) OVER (PARTITION BY r, label ORDER BY diagonal) AS copy FROM (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, label ORDER BY diagonal) > {SLACK}, false)::INT AS new
  FROM b WHERE kind = 'text')),
cover AS (SELECT r, label, copy, count(DISTINCT spot + j) AS n
  FROM (SELECT r, label, copy, k, unnest(spots) AS spot FROM c), unnest(range(0, k)) AS u(j) GROUP BY ALL),
copies AS (SELECT c.r, c.label, c.kind, min(low) AS first, max(high) AS last, any_value(cover.n) / any_value(total) AS share, any_value(total) AS total
  FROM c JOIN cover USING (r, label, copy) GROUP BY c.r, c.label, c.kind, copy),
f AS (SELECT * FROM whole UNION ALL
  SELECT r, label, kind, first, share FROM copies WHERE share >= {SHARE} AND last - first < 2 * total),
j AS (SELECT r, count(*) FILTER (kind = 'base') AS n_base, min(first) FILTER (kind = 'base') AS first_word,
  max(first) FILTER (kind = 'base') AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (kind = 'base')), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM f GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN j USING (r)"""
