"""Personal data in texts: fixed patterns, and a character tagger for forms that the patterns leave out.

Each kind needs a digit or an at sign (written or in brackets). Only places within reach of such an anchor can hold a
span, so the network reads these stretches, in overlapping windows, and whatever the patterns need is read everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.common import documents, text_slices
from watchloom.llm.tagger import PAD, Tagger, codes

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive repeats and the look-behind change no match, only the time on long runs.
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]")
#: Characters read on both sides of an anchor; windows and their steps.
REACH, WINDOW, STEP = 48, 96, 48
#: Documented bound of the sample: so many background windows, and so many labelled windows made from them.
BACKGROUND, LABELLED, ROUNDS = 256, 2400, 300
#: Least mean probability of a span's tags.
SURE = 0.9
#: A stretch is decoded in pieces of at most so many characters, which memory has to hold.
PIECE = 1 << 16


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(text: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits(text))):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The conditions on a match of a kind, which spans of the tagger have to meet too."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in re.findall("[0-9]+", text))
    n = len(digits(text))
    if kind == "card":
        return CARD_DIGITS[0] <= n <= CARD_DIGITS[1] and luhn(text)
    return PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: around each at sign, since a match holds exactly one."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind, then by start."""
    spans = [(0, s, e) for s, e in emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            if valid(KINDS[kind], m[0]):
                spans.append((kind, m.start(), m.end()))
    return spans


# -- training ------------------------------------------------------------------------------


def background(docs: DataFrame, windows: int = BACKGROUND) -> list[str]:
    """At most ``windows`` pieces of text without anchors, one for each class of a hash; exact copies count once."""
    h = F.xxhash64("text")
    start = F.pmod(F.shiftright(h, 8), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1
    piece = F.regexp_replace(F.substring(F.col("text"), start, F.lit(WINDOW)), r"[0-9@\[\]()]", "")
    rows = (
        docs.select("text").where(F.length("text") > 0)
        .select(F.pmod(h, F.lit(windows)).alias("slice"), h.alias("h"), piece.alias("piece"))
        .groupBy("slice").agg(F.min_by("piece", "h").alias("piece"))
    )
    return [r.piece for r in sorted(rows.collect(), key=lambda r: r.slice)]  # bounded by `windows`


def _made(rng: np.random.Generator, kind: int, words: list[str]) -> str:
    """A made-up span of a kind, in common spellings that the patterns know and in others that they don't."""
    def number(n):
        return "".join(str(d) for d in rng.integers(0, 10, n))

    def pick(*options):
        return options[rng.integers(len(options))]

    def name():
        word = re.sub("[^a-z]", "", words[rng.integers(len(words))].lower()) or "mail"
        return word[:12] if rng.random() < 0.7 else "".join(chr(97 + x) for x in rng.integers(0, 26, 6))

    if kind == 0:
        local = name() + pick("", "." + number(2), "_" + name(), number(1), "." + name())
        sign, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"))
        return local + sign + dot.join([name() + pick("", number(1)), pick("example", name()), pick("com", "org", "net", "de", "fr")][rng.integers(2):])
    if kind == 1:
        sep = pick(".", ".", ".", " . ", "[.]")
        return sep.join(str(x) for x in rng.integers(1, 256, 4))
    if kind == 2:
        body = pick("4", "5", "2", "9") + number(14)
        last = next(d for d in "0123456789" if luhn(body + d))
        full = body + last
        sep = pick("", "", " ", "-", ".", "_")
        return sep.join(full[k:k + 4] for k in range(0, 16, 4))
    a, b, c = number(3), number(3), number(4)
    return pick(f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}",
                f"00{number(2)} {a} {b} {c}", f"0{number(2)}/{b}{c}")


def _decoy(rng: np.random.Generator) -> str:
    """Text with digits or at signs that is no personal data."""
    def number(n):
        return "".join(str(d) for d in rng.integers(0, 10, n))

    hexes = "".join("0123456789abcdef"[d] for d in rng.integers(0, 16, 40))
    options = [
        f"Version {number(1)}.{number(1)}", f"version {number(1)}", f"BY-NC {number(1)}.{number(1)}", number(rng.integers(1, 6)),
        f'token = "{hexes}"', f"password={hexes[:18]}", f"AKIA{number(2)}XQ{number(3)}ZB{number(2)}KD{number(2)}M", f"{number(4)}-{number(2)}-{number(2)}",
        f"{number(2)}:{number(2)}", f"{number(1)},{number(3)},{number(3)}", f"{number(2)}.{number(2)} %", f"@{hexes[:5]}", number(20),
        f"({number(1)})", f"[{number(2)}]", f"{number(1)}.{number(1)}.{number(1)}",
    ]
    return options[rng.integers(len(options))]


def labelled(pieces: list[str], count: int, seed: int) -> tuple[np.ndarray, np.ndarray, list]:
    """(ids, tags, spans) of windows: pieces of text with labelled spans and decoys set between their words.

    Tag 0 is outside; kind k begins with 2k + 1 and goes on with 2k + 2.
    """
    rng = np.random.default_rng(seed)
    pieces = [p for p in pieces if p.strip()] or ["a plain line of words stands here for want of any text at all"]
    words = [w for p in pieces for w in p.split()]
    ids = np.full((count, WINDOW), PAD)
    tags = np.zeros((count, WINDOW), dtype=np.int64)
    spans = []
    for row in range(count):
        parts = pieces[rng.integers(len(pieces))].split(" ")
        text, own = "", []
        wanted = 1 + rng.integers(2)
        places = set(rng.integers(0, len(parts), wanted).tolist())
        for n, part in enumerate(parts):
            if n in places:
                if rng.random() < 0.7:
                    kind = int(rng.integers(4))
                    inner = _made(rng, kind, words)
                    own.append((kind, len(text), len(text) + len(inner)))
                else:
                    inner = _decoy(rng)
                text += inner + ["", "", ".", ",", "!!", "###", "%%%"][rng.integers(7)] + " "
            text += part + " "
        text = text[:WINDOW]
        own = [x for x in own if x[2] <= WINDOW]
        found = codes(text)
        ids[row, :len(found)] = found
        for kind, start, end in own:
            tags[row, start:end] = 2 * kind + 2
            tags[row, start] = 2 * kind + 1
        spans.append((text, own))
    return ids, tags, spans


def train(pieces: list[str], count: int = LABELLED, rounds: int = ROUNDS) -> Tagger:
    ids, tags, _ = labelled(pieces, count, seed=11)
    tagger = Tagger(tags=2 * len(KINDS) + 1, hidden=16)
    tagger.fit(ids, tags, rounds)
    return tagger


# -- finding -------------------------------------------------------------------------------


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of the anchors."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1] and end - out[-1][0] <= PIECE:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger is sure of.

    Windows overlap by half. A character's tag scores are the mean over its windows, weighted by the distance from the
    window's edges; one best path over the whole stretch then settles the windows' differences.
    """
    jobs = [(n, s, codes(t[s:e])) for n, t in enumerate(texts) for s, e in stretches(t)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for group in _grouped(jobs):
        windows, owners = [], []
        for k, (_, _, ids) in enumerate(group):
            last = max(0, -(-(len(ids) - WINDOW) // STEP)) * STEP
            for at in range(0, last + 1, STEP):
                row = np.full(WINDOW, PAD)
                part = ids[at:at + WINDOW]
                row[:len(part)] = part
                windows.append(row)
                owners.append((k, at, len(part)))
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        sums = [np.zeros((len(ids), tagger.tags), np.float32) for _, _, ids in group]
        norms = [np.zeros((len(ids), 1), np.float32) for _, _, ids in group]
        for low in range(0, len(windows), 512):
            scores = tagger.scores(np.array(windows[low:low + 512]).T)
            for col, (k, at, n) in enumerate(owners[low:low + 512]):
                sums[k][at:at + n] += scores[:n, col] * weight[:n]
                norms[k][at:at + n] += weight[:n]
        scores = [s / n for s, n in zip(sums, norms, strict=True)]
        for (n, base, _), (path, sure) in zip(group, tagger.decode(scores), strict=True):
            for start in np.flatnonzero((path % 2 == 1)):
                inside = path[start] + 1
                end = start + 1
                while end < len(path) and path[end] == inside:
                    end += 1
                if sure[start:end].mean() >= SURE:
                    found[n].append((int(path[start] // 2), base + int(start), base + end))
    return found


def _grouped(jobs, limit: int = 1 << 17):
    """Jobs in groups of bounded length, so that memory does not follow the number of anchors."""
    group, held = [], 0
    for job in jobs:
        if group and held + len(job[2]) > limit:
            yield group
            group, held = [], 0
        group.append(job)
        held += len(job[2]) + WINDOW
    if group:
        yield group


def settle(text: str, base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans, and those of the tagger that meet the conditions of their kind and touch no base span."""
    out = list(base)
    for kind, start, end in sorted(more, key=lambda x: (x[1], x[0])):
        inner = text[start:end]
        start += len(inner) - len(inner.lstrip())
        end -= len(inner) - len(inner.rstrip())
        inner = text[start:end]
        if not inner or any(s < end and start < e for _, s, e in out):
            continue
        if kind == 0 and not re.search(r"[A-Za-z0-9][^A-Za-z0-9]*(@|[\[(]at[\])])\W*[A-Za-z0-9]", inner):
            continue
        if kind == 1 and len(re.findall("[0-9]+", inner)) != 4:
            continue
        # A span that cuts a run of digits or letters in two is no whole item.
        if kind and ((start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())):
            continue
        if kind in (2, 3) and re.search(r"[^0-9\s()+./_ -]", inner):
            continue
        if valid(KINDS[kind], inner):
            out.append((kind, start, end))
    return sorted(out)


def find(df: DataFrame, tagger: Tagger) -> DataFrame:
    """``df`` with base and spans: arrays of (kind, start, end), in code points, by kind as listed, then by start.

    The whole text is read. Null and empty texts have none. Rows are independent: repeated rows get equal results, an
    empty table gives none. Columns of ``df`` with these names are replaced, others pass unchanged.
    """
    kept = [c for c in df.columns if c not in ("base", "spans")]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def plain(spans):
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                some = [n for n, t in enumerate(texts) if ANCHOR.search(t)]
                base = [[] for _ in texts]
                spans = [[] for _ in texts]
                for n, more in zip(some, tagged(tagger, [texts[n] for n in some]), strict=True):
                    base[n] = base_spans(texts[n])
                    spans[n] = settle(texts[n], base[n], more)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([plain(b) for b in base], kind), pa.array([plain(s) for s in spans], kind)],
                    names=[*kept, "base", "spans"],
                )

    source = df.select(*kept)
    span = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
    return source.mapInArrow(run, T.StructType([*source.schema.fields]).add("base", span).add("spans", span))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, train(background(docs))).drop("text")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )
