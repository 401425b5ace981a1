"""Language identification by compression: the dictionary that shortens a text most names its language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchloom.llm.common import text_slices

UNKNOWN = "und"
#: Sample per language: at most so many slices of so many characters, hence a dictionary of about 60 KB.
SLICES, SLICE_CHARS = 128, 448
#: Texts are encoded in pieces, so that the dictionary, not the text's own start, stays the context.
PIECE = 4096
#: Below this relative gap between the two shortest encodings the text is rejected.
MIN_MARGIN = 0.01
LEVEL = 6


def learn(labelled: DataFrame, slices: int = SLICES, slice_chars: int = SLICE_CHARS) -> dict[str, bytes]:
    """A raw-content dictionary for each language of ``labelled`` (text, lang).

    The sample is bounded: texts are dealt into ``slices`` classes by their hash, and the text of smallest hash stands
    for its class with ``slice_chars`` characters, from a place that the hash gives. Exact copies count once. Rows
    without language or without a letter teach nothing.
    """
    h = F.xxhash64("text")
    spare = F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1
    piece = F.substring(F.col("text"), F.pmod(F.shiftright(h, 8), spare).cast("int") + 1, F.lit(slice_chars))
    rows = (
        labelled.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", F.pmod(h, F.lit(slices)).alias("slice"), h.alias("h"), piece.alias("piece"))
        .groupBy("lang", "slice").agg(F.min_by("piece", "h").alias("piece"))
    )
    found: dict[str, list[tuple[int, str]]] = {}
    for row in rows.collect():  # at most `slices` short rows per language
        found.setdefault(row.lang, []).append((row.slice, row.piece))
    return {k: "\n".join(p for _, p in sorted(v)).lower().encode() for k, v in sorted(found.items())}


class Encoders:
    """One compressor per language, its dictionary prepared once."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self.encoders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
            ))
        self.frame = [len(e.compress(b"")) for e in self.encoders]

    def sizes(self, text: str) -> list[int]:
        """Bytes that the whole text, in lower case, takes with each dictionary, frames aside."""
        data = text.lower().encode("utf-8", "replace")
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        return [
            sum(len(e.compress(p)) for p in pieces) - frame * len(pieces)
            for e, frame in zip(self.encoders, self.frame, strict=True)
        ]

    def decide(self, text: str | None) -> tuple[str, float]:
        """The language and the margin: 1 - shortest / second shortest; 1 if only one language is known."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        sizes = sorted(zip(self.sizes(text), self.langs, strict=True))
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        return sizes[0][1], max(0.0, 1.0 - max(sizes[0][0], 0) / max(sizes[1][0], 1))


def identify(df: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``df`` with lang_pred, score and rejected; the whole text is encoded.

    A text that is null or has no letter gets ``und`` and score 0 and is rejected, as is one with a margin below
    ``min_margin``. Ties go to the language first in code point order, with score 0. Columns of ``df`` with these names
    are replaced; all others pass unchanged, row by row, so repeated rows and empty tables need no care. Without any
    dictionary all texts are ``und``.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(dictionaries)
        for batch in batches:
            for part in text_slices(batch, "text"):
                decided = [encoders.decide(t) for t in part.column("text").to_pylist()]
                margins = [m for _, m in decided]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([k for k, _ in decided], pa.string()),
                        pa.array(margins, pa.float64()),
                        pa.array([k == UNKNOWN or m < min_margin for k, m in decided], pa.bool_()),
                    ],
                    names=[*kept, "lang_pred", "score", "rejected"],
                )

    source = df.select(*kept)
    schema = T.StructType([*source.schema.fields]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return source.mapInArrow(run, schema)


def held_out(doc_id):
    """Documents that teach nothing: a remainder of the checksum of the id. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the rows of ``docs`` that are not held out."""
    own = docs.select("doc_id", "text", "lang")
    dictionaries = learn(own.where(~held_out(F.col("doc_id"))))
    rows = own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, dictionaries).drop("text")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    from watchloom.llm.common import documents

    return predict(documents(spark, sf_dir))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with enough margin."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    own = docs.select(*columns)
    return identify(own, learn(own.where(~held_out(F.col("doc_id"))))).where("NOT rejected").select(*columns)
