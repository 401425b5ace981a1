"""Line-first cleaning: rules judge lines, failing lines go, and documents that lose too much of their text are rejected.

Built-in expressions only. Everything is computed row by row: no shuffle, and memory follows the longest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import SPACES, WORD, documents, word_array

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_SHARE, WINDOW = 10, 20, 5

#: A line is navigation if it has this many separators, one for every two words at least.
SEPARATORS = r"[|»›•·>]"
MIN_SEPARATORS = 3
#: A line is boilerplate if it holds one of these phrases, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "licensed under", "lorem ipsum", "privacy policy",
    "public license", "released under", "sign up for our newsletter", "terms of service", "terms of use",
    "use of cookies",
)
#: A line fails on punctuation if symbols and exclamation marks make up more than this share of its characters.
MAX_MARKS_SHARE = 0.1
#: A document is rejected if less than this share of its words is left.
MIN_LEFT = 0.5


def base_counts(text: Column) -> dict[str, Column]:
    """The base counts of a text column that is not null."""
    bare = F.translate(text, SPACES, "")
    return {
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the same text."""
    last = F.size(words) - WINDOW + 1
    # Hash and place of each window, sorted, so that equal windows stand together.
    windows = F.sort_array(F.transform(
        F.sequence(F.lit(0), last - 1),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("at")),
    ))
    hashes = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def places(found: Column) -> Column:
        twins = F.filter(
            found,
            lambda x, i: (x["h"] == F.get(found, i - 1)["h"]) | (x["h"] == F.get(found, i + 1)["h"]),
        )
        return F.array_sort(F.transform(twins, lambda x: x["at"]))

    def covered(at: Column) -> Column:
        # Each window adds the words up to the next one, five at most.
        steps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    full = let(windows, lambda w: let(places(w), covered))
    return F.when(last < 2, F.lit(0)).when(some, full).otherwise(F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though ``body`` names it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_fails(line: Column) -> Column:
    """Whether a line breaks the punctuation, the navigation or the boilerplate rule."""
    marks = F.length(line) - F.length(F.translate(line, SYMBOLS + "!", ""))
    separators = F.length(line) - F.length(F.regexp_replace(line, SEPARATORS, ""))
    lower = F.lower(line)
    phrase = F.lit(False)
    for words in BOILERPLATE:
        phrase = phrase | lower.contains(words)
    return (
        (marks > F.length(line) * MAX_MARKS_SHARE)
        | ((separators >= MIN_SEPARATORS) & (separators * 2 >= F.size(word_array(line)) - separators))
        | phrase
    )


def clean(df: DataFrame) -> DataFrame:
    """``df`` with the base counts, clean_text, n_words_left, base_failed and kept.

    A null text counts as empty: no words, hence base_failed and not kept, with an empty clean_text. Lines without a word
    never fail and never count. A document is kept unless it is base_failed or less than ``MIN_LEFT`` of its words is
    left. Every row is judged on its own: repeated rows get equal results, an empty table gives none. Columns of
    ``df`` with the names of results are replaced, others pass unchanged.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words_left", "clean_text",
               "base_failed", "kept"]
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(
        *[c for c in df.columns if c not in results],
        t.alias("__text"), word_array(t).alias("__words"), F.split(t, "\n", -1).alias("__lines"),
    )
    lines = F.col("__lines")
    worded = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACES)) != "")
    left = F.filter(lines, lambda x: (F.btrim(x, F.lit(SPACES)) == "") | ~line_fails(x))
    rows = rows.withColumns({
        "n_words": F.size("__words").cast("long"),
        **base_counts(F.col("__text")),
        "n_dup_lines": (F.size(worded) - F.size(F.array_distinct(worded))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")),
        "clean_text": F.array_join(left, "\n"),
    }).drop("__words", "__lines", "__text")
    rows = rows.withColumn("n_words_left", F.size(word_array(F.col("clean_text"))).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_SHARE * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("n_words_left") >= F.col("n_words") * MIN_LEFT)
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return clean(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_words_left",
    )


def sql() -> str:
    """The same in DuckDB, with windows as texts instead of hashes and a set of covered places."""
    words = f"regexp_extract_all(t, '{WORD}')"
    phrases = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    has_word = f"regexp_matches(x, '{WORD}')"
    fails = (
        "(length(regexp_replace(x, '[^#*$%&|<>!]', '', 'g')) > length(x) * 0.1"
        " OR (length(regexp_replace(x, '[^|»›•·>]', '', 'g')) >= 3 AND"
        f" length(regexp_replace(x, '[^|»›•·>]', '', 'g')) * 2 >= len(regexp_extract_all(x, '{WORD}'))"
        " - length(regexp_replace(x, '[^|»›•·>]', '', 'g')))"
        f" OR {phrases})"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {words} AS words, string_split(t, chr(10)) AS lines, row_number() OVER () AS r FROM d),
g AS (SELECT r, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS g
      FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
places AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2, 3, 4]) AS u(k) GROUP BY r),
c AS (
  SELECT w.doc_id, len(words) AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(lines, lambda x: {has_word})) - len(list_distinct(list_filter(lines, lambda x: {has_word}))) AS n_dup_lines,
    coalesce(places.n, 0) AS n_repeat_words,
    coalesce(list_sum(list_transform(list_filter(lines, lambda x: NOT {fails}),
      lambda x: len(regexp_extract_all(x, '{WORD}')))), 0) AS n_words_left
  FROM w LEFT JOIN places ON places.r = w.r),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_words_left >= n_words * 0.5 AS kept, n_words_left::BIGINT AS n_words_left
FROM v"""
