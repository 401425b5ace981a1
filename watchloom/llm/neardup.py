"""Near-duplicate vectors: all pairs in tiles, leading principal components first, the rest bounded by norms.

Vectors are turned to their principal axes, which changes no product. The first axis cuts them into slabs; slabs
too far apart to hold a pair are not compared. Slabs are cut into blocks of bounded size, and a tile compares two blocks.
A tile returns counts and a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import components, local_components
from watchloom.session import materialize, scratch

THRESHOLD = 0.9
#: Vectors of a block, axes added at a time, and the width of a slab.
BLOCK, STEP, SLAB = 4096, 16, 0.1
#: Room for rounding in the bounds; pairs inside are settled by the product of the vectors as they came.
EASE = 1e-6
#: Rows of a block compared at a time, which bounds the memory of a tile.
STRIP = 512


def usable_vectors(df: DataFrame) -> DataFrame:
    """``id`` and ``v`` of the rows that can link: vectors of finite components, not all zero.

    They are multiplied by a power of two, which changes no digit and no cosine, so that no product leaves the range.
    """
    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            # Null rows may stand over values; they count as empty.
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten()
            bad = ~np.isfinite(pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False))
            values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            top, spoilt = np.zeros(len(sizes)), np.zeros(len(sizes), dtype=bool)
            spoilt[row[bad]] = True
            np.maximum.at(top, row[~bad], np.abs(values[~bad]))
            keep = (top > 0) & ~spoilt
            scale = np.ldexp(1.0, -np.frexp(np.where(keep, top, 1.0))[1] // 2)
            kept = keep[row]
            # In two steps, as the whole power may not be a number.
            values = values[kept] * scale[row[kept]]
            values = values * np.ldexp(1.0, -np.frexp(np.where(keep, top * scale, 1.0))[1])[row[kept]]
            offsets = np.concatenate([[0], np.cumsum(sizes[keep])])
            yield pa.RecordBatch.from_arrays([
                batch.column("id").filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
            ], names=["id", "v"])

    return df.mapInArrow(plain, "id long, v array<double>")


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x ** 2).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Axes by falling second moment, from one sum per partition."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                x = units(matrix(batch.column("v").slice(low, BLOCK), size))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size * size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "part"]
        )

    cells = vectors.mapInArrow(moments, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part"))
    total = np.zeros(size * size)
    for row in cells.collect():  # one small matrix
        total[row.cell] = row.part
    _, axes = np.linalg.eigh(total.reshape(size, size))
    return np.ascontiguousarray(axes[:, ::-1])


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)


def tile_links(x: np.ndarray, y: np.ndarray, axes: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``x`` and ``y`` with a cosine of at least ``threshold``; each pair once if they are the same.

    Products of the turned unit vectors grow axis by axis. A pair is dropped as soon as what it has, and the product of the
    norms of what is left, cannot reach the threshold. Turning rounds, so pairs within ``EASE`` of the threshold are settled
    by the vectors as they came.
    """
    a, b = units(x) @ axes, units(y) @ axes
    size = a.shape[1]
    norms_x, norms_y = np.sqrt((x ** 2).sum(axis=1)), np.sqrt((y ** 2).sum(axis=1))
    cuts = [*range(STEP, size, STEP), size]
    tails_a = [np.sqrt((a[:, c:] ** 2).sum(axis=1)) for c in cuts]
    tails_b = [np.sqrt((b[:, c:] ** 2).sum(axis=1)) for c in cuts]
    least = threshold - EASE
    left, right = [], []
    for low in range(0, len(a), STRIP):
        rows = a[low:low + STRIP]
        sums = rows[:, :cuts[0]] @ b[:, :cuts[0]].T
        alive = sums + tails_a[0][low:low + STRIP, None] * tails_b[0][None] >= least
        if same:
            alive &= np.arange(low, low + len(rows))[:, None] < np.arange(len(b))[None]
        i, j = np.nonzero(alive)
        got = sums[i, j]
        for k in range(1, len(cuts)):
            if not len(i):
                break
            step = slice(cuts[k - 1], cuts[k])
            for part in range(0, len(i), 1 << 16):  # bounds the memory of the gathered rows
                s = slice(part, part + (1 << 16))
                got[s] += np.einsum("ij,ij->i", rows[i[s], step], b[j[s], step])
            stay = got + tails_a[k][low + i] * tails_b[k][j] >= least
            i, j, got = i[stay], j[stay], got[stay]
        edge = np.flatnonzero(np.abs(got - threshold) <= EASE)
        for part in range(0, len(edge), 1 << 16):
            some = edge[part:part + (1 << 16)]
            one, two = low + i[some], j[some]
            got[some] = np.einsum("ij,ij->i", x[one], y[two]) / (norms_x[one] * norms_y[two])
        sure = got >= threshold
        left.append(i[sure] + low)
        right.append(j[sure])
    return np.concatenate([*left, np.empty(0, int)]), np.concatenate([*right, np.empty(0, int)])


def links(df: DataFrame, threshold: float, own: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """((id, n), (a, b)): numbers of links by id, and edges that join what is linked; of ``df`` (id, v).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths with each other.
    """
    vectors = own(usable_vectors(df), "vectors")
    parts = [
        _links_of_size(vectors.where(F.size("v") == r.size), r.size, threshold, own)
        for r in vectors.groupBy(F.size("v").alias("size")).count().orderBy("size").collect()
    ]
    found = parts[0] if parts else vectors.sparkSession.createDataFrame([], "id long, n long, other long")
    for p in parts[1:]:
        found = found.union(p)
    found = own(found, "tiles")
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    return counts, found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))


def _links_of_size(vectors: DataFrame, size: int, threshold: float, own: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    axes = principal_axes(vectors, size)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = units(matrix(batch.column("v"), size)) @ axes[:, 0]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("v"), pa.array(np.floor(along / SLAB).astype(np.int32)),
            ], names=["id", "v", "slab"])

    turned = own(vectors.mapInArrow(turn, "id long, v array<double>, slab int"), "slabs")
    # A slab's rows, and so its blocks: one row for each tenth between -1 and 1.
    blocks = {r.slab: -(-r["count"] // BLOCK) for r in turned.groupBy("slab").count().collect()}
    # Vectors of a pair differ by at most this on any axis.
    reach = int(np.ceil(np.sqrt(max(0.0, 2 - 2 * threshold)) / SLAB)) + 1
    near = {
        s: [(t, n) for t, n in sorted(blocks.items()) if abs(s - t) <= reach] for s in blocks
    }
    mine = F.create_map(*[F.lit(x) for s, n in sorted(blocks.items()) for x in (s, n)]) if blocks else F.lit(None)
    others = F.create_map(*[
        x for s in sorted(near)
        for x in (F.lit(s), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(n).alias("n")) for t, n in near[s]]))
    ]) if blocks else F.lit(None)
    placed = turned.withColumn("block", F.pmod(F.xxhash64("id", "v"), mine[F.col("slab")]).cast("int"))
    # Each row goes to the tiles of its block: with itself, and with every block of a near slab.
    tiles = placed.select("id", "v", "slab", "block", F.explode(others[F.col("slab")]).alias("o")).select(
        "id", "v", "slab", "block", F.col("o.t").alias("t"), F.explode(F.sequence(F.lit(0), F.col("o.n") - 1)).alias("k")
    )
    here = F.struct("slab", "block")
    there = F.struct(F.col("t").alias("slab"), F.col("k").alias("block"))
    tiles = tiles.select(
        F.least(here, there).alias("low"), F.greatest(here, there).alias("high"),
        (here > there).alias("second"), "id", "v",
    )

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        second = table.column("second").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        x = matrix(table.column("v").combine_chunks(), size)
        first = np.flatnonzero(~second)
        other = first if same else np.flatnonzero(second)
        i, j = tile_links(x[first], x[other], axes, same, threshold)
        i, j = first[i], other[j]
        counts = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        root = local_components(len(ids), i, j)
        hit = np.flatnonzero(counts)
        joined = np.where(root[hit] == hit, -1, root[hit])
        return pa.table({
            "id": pa.array(ids[hit]), "n": pa.array(counts[hit].astype(np.int64)),
            "other": pa.array(ids[np.maximum(joined, 0)], mask=joined < 0),
        })

    return tiles.groupBy("low", "high").applyInArrow(compare, "id long, n long, other long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of ``df`` (vec_id, embedding): one row per row.

    A component is what links reach; its id is the smallest vec_id. Rows without links are their own component. Rows of
    equal vec_id are vectors of their own and link with each other if their products reach the threshold; each gets the
    links of all rows with that id. A row whose vec_id is null links with nothing and has a null component.
    """
    rows = df.select("vec_id", "embedding")
    usable = rows.where("vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")
    )
    with scratch(df.sparkSession) as own:
        counts, edges = links(usable, threshold, own)
        counts, roots = materialize(counts, "vector-links"), components(edges, "vector-components")
    found = (
        rows.select("vec_id").join(counts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    )
    component = F.coalesce("root", F.col("vec_id").cast("long"))
    return found.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql() -> str:
    return """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS root FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.root, vec_id)::BIGINT AS component_id,
  coalesce(c.root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id"""
