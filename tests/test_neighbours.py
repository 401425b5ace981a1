from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from watchloom.operators import density, neighbours
from watchloom.operators.vector_index import VectorIndex


def table(name, ids, vectors):
    return pa.table({name: ids, "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})


@pytest.mark.parametrize(("k", "gathered", "exclude_self"), [(1, 1 << 21, False), (5, 1 << 21, True), (5, 64, True), (400, 1 << 21, True)])
def test_best_of_block_is_exact(monkeypatch, k, gathered, exclude_self):
    """Copies, near copies beyond single precision, zero and infinite vectors, repeated and unsorted keys."""
    monkeypatch.setattr(neighbours, "GATHERED", gathered)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:160] = x[3]
    x[160:260] = x[4] * (1 + 1e-7 * rng.normal(size=(100, 16)))
    x[300], x[301, 2], x[302, 0] = 0, np.inf, np.nan
    ids = rng.permutation(2000)[:700]
    ids[650] = ids[10]
    asked = rng.permutation(700)[:650]
    got = neighbours._best_of_block(table("neighbour", ids, x), table("query", ids[asked], x[asked]), k, exclude_self).to_pylist()
    unit = neighbours.unit_rows(x)
    scores = np.round(unit[asked] @ unit.T, 9)
    want = []
    for row, q in zip(scores, ids[asked], strict=True):
        near = sorted((-s, i) for s, i in zip(row, ids, strict=True) if np.isfinite(s) and not (exclude_self and i == q))
        want += [(q, i, -s) for s, i in near[:k]]
    assert sorted((r["query"], r["neighbour"], r["cosine"] + 0.0) for r in got) == sorted((int(q), int(i), s + 0.0) for q, i, s in want)


def test_a_block_takes_little_memory():
    """Scores of a strip in single precision; before, some copies of them in double precision with an order of all."""
    x = np.random.default_rng(1).normal(size=(8192, 32)).astype(np.float32)
    items, asked = table("neighbour", np.arange(8192), x), table("query", np.arange(8192), x)
    tracemalloc.start()
    neighbours._best_of_block(items, asked, 5, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, peak


def test_a_vector_is_one_row_for_all_its_cells(spark, tmp_path):
    """Python tasks give the cells of a vector as a list; before, they repeated the vector for each."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "id long, embedding array<float>")
    index = VectorIndex.build(rows, str(tmp_path / "index"), cells=4)
    placed = index._placed(rows, 3)
    assert placed.count() == 180 and placed.distinct().count() == 180
    assert "Generate explode(places" in placed._jdf.queryExecution().toString()


def test_regions_keep_one_copy_of_their_nodes():
    nodes = [{"node": n, "size": 1, "own": None, "total": 0.0, "inside": 0.0} for n in range(3)]
    assert all(density.Regions(2, nodes).state[s["node"]] is s for s in nodes)
