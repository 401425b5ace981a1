"""What several operators share: words, slices of Arrow batches, hashes, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.operators.graph import components, lowered  # noqa: F401

#: The characters between words, as the contract of the word counts gives them.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a character class, for Java's and DuckDB's regular expressions alike.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_array(text):
    """Words of a text column as an array; null and blank texts give an empty one."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, SPACE_CLASS + "+"))


def word_count(text):
    return F.size(word_array(text)).cast("long")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows, so that a piece holds about ``limit`` bytes of text or a single row.

    Memory in a Python worker then follows the longest text, not the rows of a batch.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the given links."""
    label = np.arange(n)
    while len(left):
        low = label.copy()
        np.minimum.at(low, left, label[right])
        np.minimum.at(low, right, label[left])
        low = np.minimum(low, low[low])
        if np.array_equal(low, label):
            break
        label = low
    return label
