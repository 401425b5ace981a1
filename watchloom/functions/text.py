"""Text cleaning, language hints, labels and terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions.constants import (
    CALL_TO_ACTION_PATTERN,
    CLOCK_PATTERN,
    DESCRIPTION_CHARS,
    HASHTAG_PATTERN,
    LABEL_CHARS,
    LANGUAGE_CODES,
    REFUSALS,
    SCRIPT_PATTERNS,
    SOCIAL_PATTERN,
    STOP_WORDS,
    URL_PATTERN,
)

# Every whitespace character, the four ASCII separators included.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]{2,}"

# A pattern can only match a text that holds one of these, so most texts skip the expression.
_URL_HINTS = ("http", "www.")
_CLOCK_HINTS = (":",)
_HASHTAG_HINTS = ("#",)
_CALL_HINTS = (
    "subscribe", "the bell", "turn on notifications", "follow us", "join the channel",
    "support us on patreon", "check out our merch", "link in ", "use code ", "affiliate link",
    "sponsored",
)
_SOCIAL_HINTS = (
    "instagram", "twitter", "tiktok", "facebook", "twitch", "discord", "reddit", "linkedin",
    "snapchat",
)


def strip(c: Column) -> Column:
    """Trim all kinds of whitespace, not only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_description(c: Column) -> Column:
    """Description without addresses, clock times, hashtags, calls to action and handles.

    Each step is a lambda over a one-element array, so its input is worked out once.
    """
    text = F.coalesce(c, F.lit(""))
    # Outside ASCII there are letters that ignoring case treats as i, k or s.
    folded = F.translate(text, "\u0130\u0131\u212a\u017f", "iiks")
    plain = F.lower(F.when(F.octet_length(text) > F.length(text), folded).otherwise(text))
    steps = F.array(F.struct(text.alias("text"), plain.alias("plain")))
    for pattern, hints, flags in (
        (URL_PATTERN, _URL_HINTS, "U"),
        (CLOCK_PATTERN, _CLOCK_HINTS, "U"),
        (HASHTAG_PATTERN, _HASHTAG_HINTS, "U"),
        (CALL_TO_ACTION_PATTERN, _CALL_HINTS, "iuU"),
        (SOCIAL_PATTERN, _SOCIAL_HINTS, "iuU"),
    ):
        steps = F.transform(steps, _remover(f"(?{flags}){pattern}", hints))
    text = F.get(steps, F.lit(0))["text"]
    return F.substring(strip(F.regexp_replace(text, _SPACE_RUN, " ")), 1, DESCRIPTION_CHARS)


def _remover(pattern: str, hints: Sequence[str]):
    def step(x: Column) -> Column:
        possible = F.lit(False)
        for hint in hints:
            possible = possible | F.contains(x["plain"], F.lit(hint))
        text = F.when(possible, F.regexp_replace(x["text"], pattern, " ")).otherwise(x["text"])
        return F.struct(text.alias("text"), x["plain"].alias("plain"))

    return step


def input_text(title: Column, tags: Column, description: Column) -> Column:
    """Title, tags and cleaned description as one text.

    A blank title or a list of blank tags still adds an empty part.
    """
    kept_tags = F.filter(F.transform(tags, strip), lambda t: t != "")
    named = F.array(
        F.when(title != "", strip(title)),
        F.when(F.size(tags) > 0, F.array_join(kept_tags, ", ")),
    )
    described = F.array_remove(F.array(clean_description(description)), "")
    return F.array_join(F.concat(F.array_compact(named), described), ". ")


def script_language(c: Column) -> Column:
    """Language given away by letters or script; NULL when none is."""
    hits = [F.when(c.rlike(pattern), code) for code, pattern in SCRIPT_PATTERNS]
    # All of them are outside ASCII, where a character takes more than one byte.
    return F.when(F.octet_length(c) > F.length(c), F.coalesce(*hits))


def parse_language_answer(c: Column) -> Column:
    """First isolated two-letter word of an answer, if it is a known code."""
    code = F.regexp_extract(F.lower(strip(c)), r"(?U)\b([a-z]{2})\b", 1)
    return F.when(code.isin(LANGUAGE_CODES), code)


def clean_label(c: Column) -> Column:
    """Supplied label without outer quotes, cut to size; NULL for a blank or a refusal."""
    bare = F.regexp_replace(strip(c), "^[\"']|[\"']$", "")
    label = F.substring(strip(bare), 1, LABEL_CHARS)
    refused = F.lit(False)
    for opening in REFUSALS:
        refused = refused | F.lower(label).startswith(opening)
    return F.when(~refused, F.nullif(label, F.lit("")))


def title_case(c: Column) -> Column:
    """Capital first letter of every run of letters."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def keyword_label(keywords: Column) -> Column:
    """First four keywords, title-cased."""
    return F.array_join(F.transform(F.slice(keywords, 1, 4), title_case), " / ")


def document_or_unknown(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.when(strip(text) == "", "unknown").otherwise(text)


def tokens(c: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case words of two or more characters without stop words."""
    words = F.split(F.lower(c), r"(?U)\W+")
    stop = list(stop_words)
    return F.filter(
        words, lambda w: (F.length(w) > 1) & (~w.isin(stop) if stop else F.lit(True))
    )


def terms(words: Column) -> Column:
    """The words and their two-word phrases, repeats kept."""

    def with_phrases(w: Column) -> Column:
        pairs = F.greatest(F.size(w) - 1, F.lit(0))
        phrases = F.zip_with(
            F.slice(w, F.lit(1), pairs),
            F.slice(w, F.lit(2), pairs),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        return F.concat(w, phrases)

    # As a lambda argument the words are worked out once.
    return F.flatten(F.transform(F.array(words), with_phrases))

