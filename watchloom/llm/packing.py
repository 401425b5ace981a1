"""Best-two-fit packing of tokenised documents into sequences of a fixed capacity.

The plan is made from the number of pieces of each length, so its size follows the capacity and not the documents: each
step makes a filling and repeats it as long as the lengths last. Spark numbers the pieces of each length and looks up where
the n-th of them goes.
"""

from __future__ import annotations

import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import documents, text_slices
from watchloom.session import materialize

CAPACITY = 2048
#: Ends each document.
END = 0
TOKENIZER = "word_bpe_49k.json"
#: Classes into which the pieces of a length are dealt, so that a length that most pieces have is numbered by many tasks.
DEAL = 256
#: Parts of words whose ids a Python worker remembers.
REMEMBERED = 600_000
#: Bytes of text taken at a time; more would share more words and take more memory.
SLICE = 8 << 20
TAIL = ".,!?;:%&*$#|"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- tokens --------------------------------------------------------------------------------


def word_ids(path: str) -> "WordIds":
    """One tokenizer and memory per Python worker, kept from task to task."""
    home = sys.modules.setdefault("_watchloom_worker", types.ModuleType("_watchloom_worker"))
    known = home.__dict__.setdefault("tokenizers", {})
    if path not in known:
        from tokenizers import Tokenizer

        known[path] = (Tokenizer.from_file(path), {})
    return WordIds(*known[path])


class WordIds:
    """Token ids of texts by way of their distinct words.

    The tokenizer splits at white space before it merges, so a text's ids are those of its words in turn. A word's
    closing punctuation is split off too where the tokenizer cuts in any case: behind a letter or a digit.
    ``memory`` holds the ids of such parts as bytes.
    """

    def __init__(self, tokenizer, memory: dict[str, bytes]) -> None:
        self.tokenizer, self.memory = tokenizer, memory

    def of_words(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words as bytes, four for each id."""
        bare = pc.ascii_rtrim(words, TAIL)
        # The last character must stay one letter or digit in lower case, too.
        fits = pc.and_(pc.match_substring_regex(bare, r"[\p{L}\p{N}]$"), pc.invert(pc.ends_with(bare, "\u0130")))
        cores = pc.if_else(fits, bare, words)
        long = (pc.binary_length(words).to_numpy(zero_copy_only=False) - pc.binary_length(cores).to_numpy(zero_copy_only=False))
        tailed = np.flatnonzero(long)
        tails = [w[-k:] for w, k in zip(words.take(pa.array(tailed)).to_pylist(), long[tailed].tolist(), strict=True)]
        # A special token keeps its case; it is the only word for which case matters.
        cores = pc.if_else(pc.match_substring_regex(cores, "^[A-Za-z]+$"), pc.ascii_lower(cores), cores).dictionary_encode()
        parts = cores.dictionary.to_pylist()
        memory = self.memory
        fresh = [p for p in {*parts, *tails} if p not in memory]
        if len(memory) + len(fresh) > REMEMBERED:
            memory.clear()
            fresh = list({*parts, *tails})
        for low in range(0, len(fresh), 4096):
            some = fresh[low:low + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                memory[p] = array("I", e.ids).tobytes()
        ids = np.array([*map(memory.__getitem__, parts), b""], dtype=object)[cores.indices.to_numpy(zero_copy_only=False)]
        ids[tailed] += np.array([*map(memory.__getitem__, tails), b""], dtype=object)[:-1]
        return ids.tolist()

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        distinct = self.of_words(words.dictionary)
        lengths = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct)) // 4
        flat = np.frombuffer(b"".join(distinct), dtype=np.uint32)
        begins = np.cumsum(lengths) - lengths
        which = words.indices.to_numpy(zero_copy_only=False)
        took = lengths[which]
        ends = np.concatenate([[0], np.cumsum(took)])
        # Where each id lies in `flat`: its word's begin and the steps since that word began.
        at = np.repeat((begins[which] - ends[:-1]).astype(np.int32), took)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = flat[at]
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, np.diff(bounds)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids: the documents as pieces of at most ``capacity`` tokens.

    A document is its token ids and a closing 0; a null text is empty and so is one piece of one token. Only longer
    documents are cut, the last piece may be shorter. Every row of ``df`` (doc_id, text) is a document of its own.
    """
    source = df.select("doc_id", "text")
    fields = [source.schema["doc_id"].dataType.simpleString()]
    schema = f"doc_id {fields[0]}, piece int, start long, length long, ids_crc32 long" + (
        ", ids array<long>" if with_ids else ""
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for part in text_slices(batch, "text", SLICE):
                flat, counts = words.of_texts(part.column("text"))
                # Each document's ids and its end.
                bounds = np.cumsum(counts)
                flat = np.insert(flat, bounds, END).astype("<u4", copy=False)
                sizes = counts + 1
                bounds = np.cumsum(sizes)
                often = -(-sizes // capacity)
                rows = np.repeat(np.arange(len(sizes)), often)
                number = np.arange(len(rows)) - np.repeat(np.cumsum(often) - often, often)
                start = number * capacity
                length = np.minimum(sizes[rows] - start, capacity)
                begin = (bounds - sizes)[rows] + start
                spans = list(zip(begin.tolist(), (begin + length).tolist(), strict=True))
                check = [zlib.crc32(flat[low:high]) for low, high in spans]
                ids = [flat[low:high].astype(np.int64) for low, high in spans] if with_ids else []
                columns = [
                    part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


# -- plan ----------------------------------------------------------------------------------


def fillings(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) from the number of pieces of each length.

    A filling takes the longest piece, then again and again the longest that fits the gap. While a gap is left, its
    smallest piece is replaced by the two unpacked pieces that together fit the gap and its place most tightly, if they
    fill more than it did. The filling repeats while the lengths last.
    """
    left = counts.astype(np.int64).copy()
    out: list[tuple[list[int], int]] = []
    lengths = np.arange(len(left))
    while left.any():
        taken: list[int] = []
        gap = capacity
        while True:
            fits = np.flatnonzero(left[:gap + 1])
            if not len(fits):
                break
            best = int(fits[-1])
            times = min(int(left[best]), gap // best)
            taken += [best] * times
            left[best] -= times
            gap -= best * times
        while gap:
            smallest = min(taken)
            room = gap + smallest
            here = np.flatnonzero(left[:room])
            pair = None
            if len(here):
                # For each shorter piece, the longest partner that fits beside it.
                upto = np.maximum.accumulate(np.where(left > 0, lengths, 0))
                partner = upto[room - here]
                # A length with a single piece cannot be its own partner.
                alone = (partner == here) & (left[here] < 2)
                partner = np.where(alone, upto[np.maximum(here - 1, 0)], partner)
                both = np.where(partner > 0, here + partner, 0)
                k = int(both.argmax())
                if both[k] > smallest:
                    pair = (int(here[k]), int(partner[k]))
            if pair is None:
                break
            taken.remove(smallest)
            left[smallest] += 1
            for length in pair:
                taken.append(length)
                left[length] -= 1
            gap = capacity - sum(taken)
        need = np.bincount(taken, minlength=len(left))
        used = np.flatnonzero(need)
        again = int((left[used] // need[used]).min())
        left -= need * again
        out.append((taken, again + 1))
    return out


def places(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset): pieces of a length, by rank, go to sequences in turn."""
    rank = np.zeros(len(counts), dtype=np.int64)
    sequence, out = 0, []
    for taken, times in fillings(counts, capacity):
        offset = 0
        for length in taken:
            out.append((length, int(rank[length]), int(rank[length]) + times, sequence, offset))
            rank[length] += times
            offset += length
        sequence += times
    return out


def pack(df: DataFrame, order: list[Column], capacity: int = CAPACITY) -> DataFrame:
    """``df`` (with length, from 1 to ``capacity``) with sequence_id and offset.

    Pieces of a length are dealt into classes by a hash of ``order`` and numbered within each; rows that agree in all of
    ``order`` are interchangeable. Sequences are gapless from 0. An empty table gives none. Columns of ``df`` with the
    names of results are replaced.
    """
    rows = df.drop("sequence_id", "offset")
    rows = rows.withColumn("__deal", F.pmod(F.xxhash64(*order), F.lit(DEAL)))
    sizes = rows.groupBy("length", "__deal").count().collect()  # at most capacity * DEAL short rows
    cells = np.zeros((capacity + 1, DEAL), dtype=np.int64)
    for r in sizes:
        cells[r["length"], r["__deal"]] = r["count"]
    begins = np.cumsum(cells, axis=1) - cells
    table = sorted(places(cells.sum(axis=1), capacity))
    by_length: dict[int, tuple] = {}
    for length in {t[0] for t in table}:
        own = [t for t in table if t[0] == length]
        by_length[length] = tuple(np.array(x) for x in zip(*own, strict=True))
    window = Window.partitionBy("length", "__deal").orderBy(*order)
    ranked = rows.withColumn("__rank", F.row_number().over(window) - 1)
    kept = [c for c in rows.columns if c != "__deal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            deal = batch.column("__deal").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False) + begins[length, deal]
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                _, first, _, base, off = by_length[int(value)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[k] + rank[at] - first[k]
                offset[at] = off[k]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__deal")
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of the documents of ``df`` (doc_id, text), with its sequence and its place there."""
    cut = materialize(pieces(df, path, capacity, with_ids=False), "pieces")
    order = [F.col(c) for c in ("doc_id", "piece", "ids_crc32", "length")]
    return pack(cut, order, capacity)


def op6_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces with their sequences. Repeated rows of a document are packed each on its own."""
    return pack_documents(docs, tokenizer_path())


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of ``packed`` pieces that hold their ids: the sequences themselves, at most ``CAPACITY`` ids each."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
