"""Exact cosine neighbours.

Corpus and queries are cut into blocks of bounded size; a block pair is one matrix product in
one task and keeps only its best ``k`` per query. No list of all pairs is ever made. Products
in single precision tell which rows can be among the best; these are settled in double.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of a block: 16,384 vectors of 384 floats are 24 MB.
BLOCK_ROWS = 16_384
#: Queries that are compared with a block at a time, and numbers gathered at a time to settle what is left.
STRIP, GATHERED = 512, 1 << 21


def similar(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "video_id",
    exclude_self: bool = True,
    query_key: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest corpus rows of each query: query, neighbour, cosine, rank.

    Both sides hold (key, embedding); ties go to the smaller key.
    """
    query_key = query_key or key
    corpus_blocks = _block_count(corpus, block_rows)
    query_blocks = _block_count(queries, block_rows)

    left = (
        corpus.select(F.col(key).alias("neighbour"), "embedding")
        .withColumn("corpus_block", F.pmod(F.xxhash64("neighbour"), F.lit(corpus_blocks)).cast("int"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    )
    right = (
        queries.select(F.col(query_key).alias("query"), "embedding")
        .withColumn("query_block", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int"))
        .withColumn("corpus_block", F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1))))
    )

    return best_of_all(left, right, ["query_block", "corpus_block"], k, exclude_self)


def best_of_all(left: DataFrame, right: DataFrame, on: list[str], k: int, exclude_self: bool) -> DataFrame:
    """query, neighbour, cosine, rank: the ``k`` nearest of ``left`` (on, neighbour, embedding) for each query of ``right`` (on,
    query, embedding) over all blocks ``on`` that it is in."""

    def best(items: pa.Table, asked: pa.Table) -> pa.Table:
        return _best_of_block(items, asked, k, exclude_self)

    query, neighbour = [df.schema[c].dataType.simpleString() for df, c in ((right, "query"), (left, "neighbour"))]
    schema = f"query {query}, neighbour {neighbour}, cosine double"
    partial = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(best, schema)
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), F.asc("neighbour"))
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_count(df: DataFrame, block_rows: int) -> int:
    return max(1, -(-df.count() // block_rows))


def _best_of_block(items: pa.Table, asked: pa.Table, k: int, exclude_self: bool) -> pa.Table:
    """The ``k`` best rows of one block for each query of another: query, neighbour, cosine; ties go to the smaller key."""
    items = items.sort_by("neighbour")
    matrix, good = unit_matrix(items.column("embedding"))
    items, matrix = items.filter(pa.array(good)), matrix[good]
    queries, good = unit_matrix(asked.column("embedding"))
    names, queries = asked.column("query").filter(pa.array(good)), queries[good]
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if len(items) and len(names):
        keys, own = items.column("neighbour").to_numpy(), names.to_numpy()
        if exclude_self:
            low, high = (np.searchsorted(keys, own, side) for side in ("left", "right"))
        # Columns of the product that stand in one group, of which there are at least k; it is filled up to whole groups.
        width = max(1, min(64, len(keys) // (4 * k)))
        groups = -(-len(keys) // width)
        small = np.zeros((groups * width, matrix.shape[1]), dtype=np.float32)
        small[: len(keys)] = matrix
        # Twice what the single precision of factors and sums can be off, on either side.
        margin = np.float32(4 * (matrix.shape[1] + 8) * 2.0**-24)
        for at in range(0, len(own), STRIP):
            some = slice(at, at + STRIP)
            scores = queries[some].astype(np.float32) @ small.T
            scores[:, len(keys):] = -np.inf
            if exclude_self:
                times = (high - low)[some]
                row = np.repeat(np.arange(len(times)), times)
                scores[row, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[some], times)] = -np.inf
            scores = scores.reshape(len(scores), width, groups)
            tops = scores.max(axis=1)
            # At least k rows reach the k-th of the groups' maxima, so what stays below it is not among the best.
            least = np.full(len(scores), -np.inf, dtype=np.float32) if groups < k else np.partition(tops, groups - k, axis=1)[:, groups - k]
            least = least - margin
            row, group = np.nonzero(tops >= least[:, None])
            # Queries with many equal rows bring more of them; a portion is what fits, one query at least.
            ends = np.searchsorted(row, np.arange(len(scores)), side="right")
            step = max(1, GATHERED // (4 * width))
            begin = 0
            while begin < len(row):
                end = int(ends[max(np.searchsorted(ends, begin + step, side="right") - 1, row[begin])])
                found.append(_settled(scores, row[begin:end], group[begin:end], least, queries[some], matrix, k, at))
                begin = end
    row, column, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({
        "query": names.take(pa.array(row)), "neighbour": items.column("neighbour").take(pa.array(column)), "cosine": cosine,
    })


def _settled(
    scores: np.ndarray, row: np.ndarray, group: np.ndarray, least: np.ndarray, queries: np.ndarray, matrix: np.ndarray, k: int, at: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in the block, cosine) of the ``k`` best of each query in these groups, by products in double precision."""
    close = scores[row, :, group]
    which, place = np.nonzero((close >= least[row, None]) & (close > -np.inf))
    row, column = row[which], place * scores.shape[2] + group[which]
    exact = np.empty(len(row))
    step = max(1, GATHERED // matrix.shape[1])
    for low in range(0, len(row), step):
        some = slice(low, low + step)
        exact[some] = np.einsum("ij,ij->i", queries[row[some]], matrix[column[some]])
    exact = np.round(exact, 9)
    order = np.lexsort((column, -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep] + at, column[keep], exact[keep]


def unit_matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix of unit rows, and which rows are finite."""
    if not len(vectors):
        return np.empty((0, 0)), np.empty(0, dtype=bool)
    if vectors.null_count:
        raise ValueError("vectors must not be null")
    values = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = _unit(values.reshape(len(vectors), -1))
    return matrix, np.isfinite(matrix).all(axis=1)


def unit_rows(vectors: Iterable) -> np.ndarray:
    """Vectors as a matrix of unit rows."""
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1, lengths)
