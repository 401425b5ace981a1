"""Token alignment of two tokenizers: groups between common ends, links of overlapping tokens, and corpus-wide pair counts.

Texts are cut where neither tokenizer can merge, so that a piece is aligned once however often it occurs. Pairs that the
identity map holds (an id of A and the id of B with the same bytes) are counted in a vector of A's vocabulary; only other
pairs are shuffled.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import documents, text_slices
from watchloom.session import materialize

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces of text whose alignment a Python worker remembers, and bytes of text taken at a time.
REMEMBERED, SLICE = 400_000, 2 << 20
#: Pieces that are encoded in one go.
RUN = 32
#: Pairs in more than one of so many of all (document, pair) rows are settled without a shuffle. There are at most as many.
FREQUENT = 1 << 17
#: In front of a blank or a line feed that follows anything but white space, both tokenizers start anew.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: How B writes a blank.
BLANK = "▁"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, the identity map, and the pieces of text aligned so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = byte_level()
        entries = {n: e for e, n in self.a.get_vocab().items()}
        self.size_a, self.size_b = max(entries) + 1, self.b.get_piece_size()
        self.bytes_a = [
            bytes(to_byte[c] for c in entries[n]) if all(c in to_byte for c in entries.get(n, "\0")) else b""
            for n in range(self.size_a)
        ]
        pieces = [self.b.id_to_piece(n) for n in range(self.size_b)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace(BLANK, " ").encode() for n, p in enumerate(pieces)
        ]
        # Byte pieces come first, so that an ordinary piece of the same bytes takes their place.
        order = sorted(range(self.size_b), key=lambda n: not self.b.is_byte(n))
        same = {self.bytes_b[n]: n for n in order if not (self.b.is_control(n) or self.b.is_unknown(n))}
        #: For each id of A the id of B with the same bytes, or -1.
        self.identity = np.array([same.get(x, -1) if x else -1 for x in self.bytes_a], dtype=np.int64)
        # Cuts are exact if no piece of B reaches over one. A starts anew at white space in any case.
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.blank = self.b.piece_to_id(BLANK)
        # How ids are written in a group: inside, and as the last of their side.
        self.names = [
            np.array([f"{n}{mark}" for n in range(size)], dtype=object) for size in (self.size_a, self.size_b) for mark in (",", "|;"[size == self.size_b])
        ]
        self.long_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.long_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: Per piece: its groups as text with a closing semicolon, empty where its bytes are not kept.
        self.texts: list[bytes] = []
        #: Per piece: whether its bytes are kept, numbers of tokens of A and of B, of groups and of links.
        self.counts = np.empty((0, 5), dtype=np.int64)
        #: Where the links of each piece begin, and all links as id of A * size_b + id of B.
        self.begins, self.codes = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def split(self, text: str) -> list[str]:
        return CUT.split(" " + text) if self.cuts else [" " + text]

    def ids(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B of stretches of text, each with the blank or line feed that it starts with."""
        own = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        # B puts a blank in front itself. Before a line feed, with which it merges nothing, that is a token to take off.
        raw = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        other = [(x or [self.blank]) if p[0] == " " else x[1:] for p, x in zip(parts, raw, strict=True)]
        return own, other

    def learn(self, parts: list[str]) -> None:
        """Aligns new pieces of text."""
        if self.cuts:
            # Pieces are cut where both tokenizers start anew, so that several in a row are encoded in one go, but for those
            # that end in white space: they ended a text.
            bare = [p for p in parts if not p[-1].isspace()]
            runs = [bare[k:k + RUN] for k in range(0, len(bare), RUN)] + [[p] for p in parts if p[-1].isspace()]
        else:
            runs = [[p] for p in parts]
        for low in range(0, len(runs), 4096 // RUN):
            some = runs[low:low + 4096 // RUN]
            good, bad = [], []
            for run, a, b in zip(some, *self.ids(["".join(run) for run in some]), strict=True):
                want = "".join(run).encode()
                kept = b"".join([self.bytes_a[x] for x in a]) == want and b"".join([self.bytes_b[x] for x in b]) == want
                (good if kept else bad).append((run, a, b))
            if good:
                self.align(*zip(*good, strict=True))
            for run, *_ in bad:
                if len(run) > 1:
                    for p, a, b in zip(run, *self.ids(run), strict=True):
                        want = p.encode()
                        if b"".join([self.bytes_a[x] for x in a]) == want and b"".join([self.bytes_b[x] for x in b]) == want:
                            self.align([[p]], [a], [b])
                        else:
                            self.add([p], np.zeros((1, 5), dtype=np.int64), [b""], np.empty(0, dtype=np.int64))
                else:
                    self.add(run, np.zeros((1, 5), dtype=np.int64), [b""], np.empty(0, dtype=np.int64))

    def add(self, parts: list[str], counts: np.ndarray, texts: list[bytes], codes: np.ndarray) -> None:
        """Remembers pieces with their links in a row."""
        self.known.update(zip(parts, range(len(self.texts), len(self.texts) + len(parts)), strict=True))
        self.texts += texts
        self.fresh.append((counts, codes))

    def align(self, runs: list[list[str]], a: list[list[int]], b: list[list[int]]) -> None:
        """Groups and links of runs of pieces whose ids come to the same bytes, for all of them at once."""
        parts = [p for run in runs for p in run]
        a, b = np.fromiter(chain.from_iterable(a), np.int64), np.fromiter(chain.from_iterable(b), np.int64)
        # Places in the bytes of all pieces in a row.
        ends_a, ends_b = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b])
        ends = np.cumsum(np.array([len(p.encode()) for p in parts], dtype=np.int64))
        to_a, to_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        if not (np.array_equal(ends_a[to_a - 1], ends) and np.array_equal(ends_b[to_b - 1], ends)):
            raise ValueError("a token reaches over a cut")
        # Where a token of each side ends, a group ends.
        last_a, last_b = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # A token of A is linked to those of B from the one that covers its first byte to the one that covers its last.
        first = np.searchsorted(ends_b, ends_a - self.long_a[a], side="right")
        number = np.searchsorted(ends_b, ends_a) - first + 1
        linked = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
        codes = np.repeat(a * self.size_b, number) + b[linked]

        def per_part(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])[to_a]
            return np.diff(total, prepend=0)

        counts = np.stack([np.ones(len(parts), np.int64), np.diff(to_a, prepend=0), np.diff(to_b, prepend=0), per_part(last_a), per_part(number)], axis=1)
        # A group is written as its ids of A, then its ids of B.
        sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
        written = np.empty(len(a) + len(b), dtype=object)
        written[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = np.where(last_a, self.names[1][a], self.names[0][a])
        written[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = np.where(last_b, self.names[3][b], self.names[2][b])
        own = [0, *(to_a + to_b).tolist()]
        written = written.tolist()
        self.add(parts, counts, ["".join(written[s:e]).encode() for s, e in zip(own, own[1:])], codes)

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of A and B, groups and links by text; digests; text, code and number of links, sorted by both)."""
        split = [self.split(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = set().union(*split)
        if fresh:
            self.fresh = []
            self.learn(list(fresh))
            self.counts = np.concatenate([self.counts, *[c for c, _ in self.fresh]])
            self.codes = np.concatenate([self.codes, *[c for _, c in self.fresh]])
            self.begins = np.cumsum(self.counts[:, 4]) - self.counts[:, 4]
        numbers = [list(map(self.known.__getitem__, parts)) for parts in split]
        sizes = np.array([len(n) for n in numbers], dtype=np.int64)
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, count=int(sizes.sum()))
        rows = np.repeat(np.arange(len(texts)), sizes)
        sums = np.zeros((len(texts), 5), dtype=np.int64)
        full = np.flatnonzero(sizes)
        if len(full):
            sums[full] = np.add.reduceat(self.counts[flat], (np.cumsum(sizes) - sizes)[full])
        # One piece that does not come back as it was takes the whole text with it.
        good = (sizes > 0) & (sums[:, 0] == sizes)
        sums[~good] = 0
        digests = [
            hashlib.sha256(b"".join(map(self.texts.__getitem__, own))[:-1]).hexdigest() if ok else "" for own, ok in zip(numbers, good, strict=True)
        ]
        place, often = np.unique(((rows << 32) + flat)[good[rows]], return_counts=True)
        row, piece = place >> 32, place & 0xFFFFFFFF
        length = self.counts[piece, 4]
        at = np.arange(length.sum()) + np.repeat(self.begins[piece] - (np.cumsum(length) - length), length)
        # A code has 31 bits.
        key = (np.repeat(row, length) << 32) + self.codes[at]
        number = np.repeat(often, length)
        order = np.argsort(key)
        key, number = key[order], number[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(number, starts) if len(starts) else number
        return sums[:, 1:], digests, key[starts] >> 32, key[starts] & 0xFFFFFFFF, times


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python worker, kept from task to task."""
    home = sys.modules.setdefault("_watchloom_worker", types.ModuleType("_watchloom_worker"))
    known = home.__dict__.setdefault("aligners", {})
    if (path_a, path_b) not in known:
        known[path_a, path_b] = Aligner(path_a, path_b)
    return known[path_a, path_b]


def lists(rows: np.ndarray, size: int, values: np.ndarray) -> pa.Array:
    """``values`` as one list per row; ``rows`` says where each belongs, in order."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def aligned(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``df`` (doc_id, text): uid, doc_id, the numbers n_a, n_b, n_groups, n_links, groups_sha256, and its links.

    ``same`` lists the ids of A that it links to the id of B with the same bytes, ``pairs`` all other links as
    a * (size of B) + b; ``same_n`` and ``pairs_n`` say how often. Null and empty texts, and those that either
    tokenizer doesn't give back byte by byte, have zeros, '' and no links.
    """
    source = df.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                size = part.num_rows
                sums, digests, row, code, times = own.of_texts(part.column("text").to_pylist())
                a, b = code // own.size_b, code % own.size_b
                same = own.identity[a] == b
                yield pa.RecordBatch.from_arrays([
                    part.column("uid"), part.column("doc_id"), *[pa.array(sums[:, k]) for k in range(4)], pa.array(digests),
                    lists(row[same], size, a[same]), lists(row[same], size, times[same]),
                    lists(row[~same], size, code[~same]), lists(row[~same], size, times[~same]),
                ], names=["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "pairs", "pairs_n"])

    return source.mapInArrow(
        run, f"uid long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "same array<long>, same_n array<long>, pairs array<long>, pairs_n array<long>",
    )


def same_counts(rows: DataFrame, size_a: int) -> DataFrame:
    """(a, n): in how many rows of ``aligned`` an id of A is linked to its like; one vector of A's vocabulary per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size_a, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("same").flatten().to_numpy(zero_copy_only=False), minlength=size_a)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["a", "n"])

    return rows.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def numbers(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a small table, sorted by the first."""
    table = df.toArrow().sort_by(names[0])
    return [table.column(c).to_numpy() for c in names]


def align(df: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The count of a pair of ids is the number of rows that hold it linked; rows that repeat a document count each. n_best
    is the number of links whose count is the highest of all pairs with the same id of A, ties included, count_sum the
    sum of the counts over links. Rows without tokens have zeros and an empty groups_sha256. An empty table gives none.

    Two vectors over A's vocabulary, and the at most ``FREQUENT`` pairs that hold more than one in ``FREQUENT`` of all
    rows, travel to the tasks. Other pairs are joined by their code; none of them has rows enough to make a task long.
    """
    tokenizers = Aligner(path_a, path_b)
    size_a, size_b = tokenizers.size_a, tokenizers.size_b
    rows = materialize(aligned(df, path_a, path_b), "aligned")
    same = materialize(same_counts(rows, size_a), "aligned-same")
    pairs = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "aligned-pairs")
    left = F.expr(f"pair DIV {size_b}")
    # One row per id of A: fit to broadcast whatever the corpus.
    highest = materialize(
        same.unionByName(pairs.select(left.alias("a"), "n")).groupBy("a").agg(F.max("n").alias("most")), "aligned-most"
    )
    judged = pairs.withColumn("a", left).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    known_a, known_n, known_best = numbers(
        same.join(F.broadcast(highest), "a").select("a", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "a", "n", "best"
    )
    often, often_n, often_best = numbers(
        judged.where(F.col("n") * F.lit(FREQUENT) > F.lit(total)).select("pair", "n", F.col("best").cast("long").alias("best")),
        "pair", "n", "best",
    )

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            sums, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)

            def add(name: str, keys: np.ndarray, n: np.ndarray, is_best: np.ndarray):
                column = batch.column(name)
                row = np.repeat(np.arange(size), np.diff(column.offsets.to_numpy()))
                key = column.flatten().to_numpy(zero_copy_only=False)
                times = batch.column(name + "_n").flatten().to_numpy(zero_copy_only=False)
                at = np.searchsorted(keys, key)
                hit = at < len(keys)
                hit[hit] = keys[at[hit]] == key[hit]
                np.add.at(sums, row[hit], n[at[hit]] * times[hit])
                np.add.at(best, row[hit], is_best[at[hit]] * times[hit])
                return row[~hit], key[~hit], times[~hit]

            add("same", known_a, known_n, known_best)
            row, key, times = add("pairs", often, often_n, often_best)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(best), pa.array(sums), lists(row, size, key), lists(row, size, times)],
                names=[*kept, "n_best", "count_sum", "pairs", "pairs_n"],
            )

    kept = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    found = materialize(
        rows.mapInArrow(settle, schema + ", n_best long, count_sum long, pairs array<long>, pairs_n array<long>"), "aligned-rows"
    )
    rare = found.select("uid", F.explode(F.arrays_zip("pairs", "pairs_n")).alias("p")).select("uid", "p.pairs", "p.pairs_n")
    more = rare.join(judged, F.col("pairs") == F.col("pair")).groupBy("uid").agg(
        F.sum(F.col("n") * F.col("pairs_n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("pairs_n"))).alias("more_best")
    )
    zero = F.lit(0)
    return found.join(more, "uid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", zero)).cast("long").alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).cast("long").alias("count_sum"), "groups_sha256",
    )


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), tokenizer_path(TOKENIZER_A), tokenizer_path(TOKENIZER_B))
