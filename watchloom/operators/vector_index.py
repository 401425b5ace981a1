"""Inverted file over vectors: cells around centroids, one folder each; a search reads the cells nearest to its queries.

Centroids are fitted on a bounded sample, every vector is stored in the cell of its nearest centroid. New vectors go to the
cells that are there, and cells that have grown too large are split by themselves, so nothing is ever built anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.operators.neighbours import BLOCK_ROWS, best_of_all, unit_matrix, unit_rows
from watchloom.session import remove

#: Vectors that centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
#: Centroids at most: they travel to every task.
MAX_CELLS = 4096
#: Queries of a cell that one task compares with it.
QUERY_BLOCK = BLOCK_ROWS
#: Products with centroids that a task holds at a time.
SCORES = 1 << 21


def centroids_of(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; empty cells take the vector farthest from its centroid."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    found = sample[rng.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        scores = sample @ found.T
        nearest = scores.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=cells) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(scores.max(axis=1))[:len(empty)]]
        found = unit_rows(sums)
    return found


class VectorIndex:
    """An index of (id, embedding) below one folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cells: int | None = None, seed: int = 42) -> VectorIndex:
        """Fits centroids on at most ``SAMPLE`` vectors, chosen by hash, and stores all; cells: the root of their number."""
        own = cls(vectors.sparkSession, root)
        some = vectors.orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow().column("embedding").to_pylist()
        number = cells or int(np.sqrt(vectors.count()))
        own._write_cells([(k, c) for k, c in enumerate(centroids_of(unit_rows(some), max(1, min(number, MAX_CELLS)), seed))])
        own.add(vectors)
        return own

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, centroids) of the cells; at most ``MAX_CELLS``, and what splits have added."""
        table = self.spark.read.parquet(f"{self.root}/cells").orderBy("cell").toArrow()
        return table.column("cell").to_numpy(), np.array(table.column("centroid").to_pylist())

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors")

    def add(self, vectors: DataFrame) -> None:
        """Stores more vectors in the cells that are there."""
        rows = self._placed(vectors, 1).withColumnRenamed("place", "cell")
        rows.repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{self.root}/vectors")

    def search(self, queries: DataFrame, k: int, probes: int, exclude_self: bool = True) -> DataFrame:
        """The ``k`` nearest stored vectors of each of ``queries`` (id, embedding) among its ``probes`` nearest cells: query,
        neighbour, cosine, rank. Only the folders of cells that are probed are read."""
        asked = self._placed(queries, probes).withColumnsRenamed({"id": "query", "place": "cell"})
        # One row per cell.
        counts = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
        stored = self.vectors().where(F.col("cell").isin(sorted(counts)))
        held = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}
        asking = {c: -(-n // QUERY_BLOCK) for c, n in counts.items()}
        holding = {c: max(1, -(-held.get(c, 0) // BLOCK_ROWS)) for c in counts}

        def of_cell(numbers: dict[int, int]) -> Column:
            pairs = [F.lit(x) for pair in sorted(numbers.items()) for x in pair]
            return F.create_map(*pairs)[F.col("cell")] if pairs else F.lit(None).cast("int")

        def dealt(name: str, numbers: dict[int, int]) -> Column:
            return F.pmod(F.xxhash64(name), of_cell(numbers)).cast("int")

        def each(numbers: dict[int, int]) -> Column:
            return F.explode(F.sequence(F.lit(0), of_cell(numbers) - 1))

        left = stored.select(F.col("id").alias("neighbour"), "embedding", "cell").withColumn("part", dealt("neighbour", holding))
        right = asked.withColumn("block", dealt("query", asking))
        return best_of_all(
            left.withColumn("block", each(asking)), right.withColumn("part", each(holding)), ["cell", "block", "part"], k, exclude_self
        )

    def split(self, limit: int, seed: int = 42) -> int:
        """Cuts every cell of more than ``limit`` vectors in two, once; returns how many. Other folders stay as they are."""
        numbers, centroids = self.cells()
        large = [r["cell"] for r in self.vectors().groupBy("cell").count().where(F.col("count") > limit).collect()]
        kept = [(int(n), c) for n, c in zip(numbers, centroids, strict=True) if n not in large]
        fresh = int(numbers.max()) + 1
        for cell in large:
            rows = self.vectors().where(F.col("cell") == cell).select("id", "embedding")
            some = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow().column("embedding").to_pylist()
            halves = [(fresh, c) for fresh, c in enumerate(centroids_of(unit_rows(some), 2, seed), fresh)]
            fresh += len(halves)
            placed = self._placed(rows, 1, halves).withColumnRenamed("place", "cell")
            placed.write.mode("append").partitionBy("cell").parquet(f"{self.root}/vectors")
            kept += halves
            remove(self.spark, f"{self.root}/vectors/cell={cell}")
        if large:
            self._write_cells(kept)
        return len(large)

    def _write_cells(self, cells: list[tuple[int, np.ndarray]]) -> None:
        rows = [(int(n), [float(x) for x in c]) for n, c in cells]
        draft = f"{self.root}/cells-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(draft)
        remove(self.spark, f"{self.root}/cells")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        path(draft).getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(path(draft), path(f"{self.root}/cells"))

    def _placed(self, vectors: DataFrame, places: int, cells: list[tuple[int, np.ndarray]] | None = None) -> DataFrame:
        """``vectors`` with place, the ``places`` nearest cells of each; a tie goes to the smaller number."""
        if cells is None:
            numbers, centroids = self.cells()
        else:
            numbers, centroids = np.array([n for n, _ in cells]), np.array([c for _, c in cells])
        shared = self.spark.sparkContext.broadcast((numbers.astype(np.int32), centroids))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            most = min(places, len(names))
            step = max(1, SCORES // len(names))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    scores = np.round(unit_matrix(pa.chunked_array([part.column("embedding")]))[0] @ matrix.T, 9)
                    near = scores.argmax(axis=1)[:, None] if most == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :most]
                    found = pa.FixedSizeListArray.from_arrays(pa.array(names[near].ravel()), most).cast(pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*part.columns, found], names=["id", "embedding", "places"])

        rows = vectors.select("id", "embedding")
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        # A vector and its places are one row in the tasks.
        return rows.mapInArrow(place, f"{fields}, places array<int>").select("id", "embedding", F.explode("places").alias("place"))
