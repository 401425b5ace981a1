"""The inverted file: recall against exact neighbours, pruned folders, inserts and splits."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from watchloom.operators.neighbours import similar
from watchloom.operators.vector_index import VectorIndex


def test_index(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    first, later = rows.where("id < 400"), rows.where("id >= 400")
    index = VectorIndex.build(first, str(tmp_path / "index"), cells=12)
    before = set(os.listdir(tmp_path / "index" / "vectors"))
    index.add(later)
    # These vectors have little structure, so near ones lie in many cells.
    # Inserts make no new cell, and every vector is stored once.
    assert set(os.listdir(tmp_path / "index" / "vectors")) == before
    assert index.vectors().select("id").distinct().count() == index.vectors().count() == rows.count()
    exact = {(r.query, r.neighbour) for r in similar(rows, rows, 5, key="id").collect()}
    found = {(r.query, r.neighbour) for r in index.search(rows, 5, probes=10).collect()}
    assert len(found & exact) >= 0.95 * len(exact), len(found & exact) / len(exact)
    assert {(r.query, r.neighbour) for r in index.search(rows, 5, probes=99).collect()} == exact

    # A search with one query reads the folders of its cells and no other.
    one = index.search(rows.where("id = 7"), 3, probes=2)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    read = one.inputFiles()
    assert 1 <= len({os.path.dirname(f) for f in read if "/vectors/" in f}) <= 2

    sizes = {r["cell"]: r["count"] for r in index.vectors().groupBy("cell").count().collect()}
    limit = int(np.median(list(sizes.values())))
    stay = {c for c, n in sizes.items() if n <= limit}
    files = {c: sorted(os.listdir(tmp_path / "index" / "vectors" / f"cell={c}")) for c in stay}
    assert index.split(limit) == len(sizes) - len(stay)
    assert files == {c: sorted(os.listdir(tmp_path / "index" / "vectors" / f"cell={c}")) for c in stay}
    assert index.vectors().select("id").distinct().count() == index.vectors().count() == rows.count()
    assert {(r.query, r.neighbour) for r in index.search(rows, 5, probes=99).collect()} == exact
