"""Export records: ids, classes, titles, channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchloom.functions.constants import AD_MARKER, TITLE_PREFIX
from watchloom.functions.text import strip


def video_id(url: Column) -> Column:
    """First non-blank ``v`` parameter of the query string, decoded.

    Worked out on the text, since URL parsers reject addresses with stray characters.
    """
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    open_bracket = F.contains(host, F.lit("["))
    close_bracket = F.contains(host, F.lit("]"))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    values = F.transform(
        F.filter(
            F.split(query, "&"),
            lambda p: p.startswith("v=") & (F.length(p) > 2),
        ),
        lambda p: F.substring(p, 3, 2_147_483_647),
    )
    raw = F.get(values, F.lit(0))
    decoded = F.coalesce(F.try_url_decode(raw), F.replace(raw, F.lit("+"), F.lit(" ")))
    return F.when(open_bracket == close_bracket, F.nullif(decoded, F.lit("")))


def is_ad(details: Column) -> Column:
    """Any element of the ``details`` list carries the advertisement marker."""
    elements = F.try_variant_get(details, "$", "array<variant>")
    return F.coalesce(
        F.exists(elements, lambda d: F.try_variant_get(d, "$.name", "string") == AD_MARKER),
        F.lit(False),
    )


def is_removed(url: Column) -> Column:
    return F.coalesce(url, F.lit("")) == ""


def is_ghost(title: Column) -> Column:
    """The title, without the first prefix found anywhere in it, is an address."""
    text = F.coalesce(title, F.lit(""))
    at = F.locate(TITLE_PREFIX, text)
    rest = F.when(
        at > 0,
        F.concat(
            F.substring(text, F.lit(1), at - 1),
            F.substring(text, at + len(TITLE_PREFIX), F.length(text)),
        ),
    ).otherwise(text)
    return _is_address(strip(rest))


def clean_title(title: Column) -> Column:
    """Title without a leading prefix; NULL for an address or a blank.

    The address test comes before trimming.
    """
    text = F.coalesce(title, F.lit(""))
    rest = F.when(
        text.startswith(TITLE_PREFIX), F.substring(text, len(TITLE_PREFIX) + 1, 2_147_483_647)
    ).otherwise(text)
    return F.when(~_is_address(rest), F.nullif(strip(rest), F.lit("")))


def channel_name(subtitles: Column) -> Column:
    return F.try_variant_get(subtitles, "$[0].name", "string")


def channel_url(subtitles: Column) -> Column:
    return F.try_variant_get(subtitles, "$[0].url", "string")


def record_class(details: Column, url: Column, title: Column) -> Column:
    """ad > removed > ghost > clean."""
    return (
        F.when(is_ad(details), "ad")
        .when(is_removed(url), "removed")
        .when(is_ghost(title), "ghost")
        .otherwise("clean")
    )


def initial_status(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", "active").otherwise("unavailable")


def utc_time(text: Column) -> Column:
    """UTC time of an ISO 8601 text; NULL when it is not one."""
    instant = text.try_cast("timestamp").cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant)


def _is_address(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://")
