"""Density clusters against a version that takes the hierarchy apart from the top, and stable assignment of new vectors."""

from __future__ import annotations

import numpy as np
import pytest

from watchloom.operators import density
from watchloom.operators.graph import components, spanning_forest


def blobs(seed, sizes=(30, 22, 14), noise=12, dim=8):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=dim) * 3 + rng.normal(size=(n, dim)) * (0.3 + 0.2 * k) for k, n in enumerate(sizes)]
    rows = np.concatenate([*parts, rng.normal(size=(noise, dim)) * 3])
    return [(int(k), [float(x) for x in v]) for k, v in enumerate(rows)]


def graph(rows, neighbours, samples):
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - np.round(x @ x.T, 9), 9)
    near = []
    for i in range(len(rows)):
        near.append([j for j in np.lexsort((np.arange(len(rows)), d[i])) if j != i][:max(neighbours, samples)])
    core = [max(d[i][j] for j in near[i][:samples]) for i in range(len(rows))]
    edges = {}
    for i in range(len(rows)):
        for j in near[i][:neighbours]:
            edges[min(i, j), max(i, j)] = float(max(d[i, j], core[i], core[j]))
    return sorted((w, int(a), int(b)) for (a, b), w in edges.items())


def kruskal(n, edges):
    up, out = list(range(n)), []

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for w, a, b in edges:
        if root(a) != root(b):
            up[root(a)] = root(b)
            out.append((w, a, b))
    return out


def parts_of(nodes, edges):
    label = {n: {n} for n in nodes}
    for _, a, b in edges:
        if label[a] is not label[b]:
            joined = label[a] | label[b]
            for n in joined:
                label[n] = joined
    return list({id(s): s for s in label.values()}.values())


def taken_apart(nodes, edges, min_size):
    """Labels by removing the longest edge again and again; clusters that last longest are kept."""

    def split(nodes, edges, birth):
        """(worth, sets of kept clusters) of a cluster that begins at ``birth``."""
        left, worth, own = set(nodes), 0.0, sorted(edges)
        while True:
            if not own:
                return worth, [], left
            w, a, b = own.pop()
            lam = 1 / max(w, density.CLOSEST)
            one, two = sorted(parts_of(left, own), key=len, reverse=True)
            if len(two) >= min_size:
                worth += (len(one) + len(two)) * (lam - birth)
                inner = [cluster(p, [e for e in own if e[1] in p], lam) for p in (one, two)]
                return worth, inner, left
            worth += len(two) * (lam - birth)
            if len(one) < min_size:
                return worth + len(one) * (lam - birth), [], left
            left, own = one, [e for e in own if e[1] in one]

    def cluster(nodes, edges, birth):
        worth, inner, _ = split(nodes, edges, birth)
        below = sum(v for v, _ in inner)
        if inner and below > worth + 1e-9:
            return below, [s for _, sets in inner for s in sets]
        return worth, [set(nodes)]

    trees = [p for p in parts_of(nodes, edges) if len(p) >= min_size]
    kept = []
    for tree in trees:
        own = [e for e in edges if e[1] in tree]
        if len(trees) > 1:
            kept += cluster(tree, own, 0.0)[1]
        else:
            kept += [s for _, sets in split(tree, own, 0.0)[1] for s in sets]
    label = dict.fromkeys(nodes, -1)
    for s in kept:
        for n in s:
            label[n] = min(s)
    return label


@pytest.mark.parametrize("seed,min_size,samples,group", [(1, 6, 4, 10**6), (2, 5, 3, 30)])
def test_against_brute_force(spark, monkeypatch, seed, min_size, samples, group):
    """In one task, and in rounds of small groups."""
    monkeypatch.setattr(density, "GROUP_EDGES", group)
    rows = blobs(seed)
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    found, topics = density.density_clusters(df, min_size, samples)
    got = {r.id: r.topic for r in found.collect()}
    forest = kruskal(len(rows), graph(rows, 2 * samples, samples))
    want = taken_apart(range(len(rows)), forest, min_size)
    assert len(set(want.values())) > 2 and -1 in want.values()
    # A vector that leaves a cluster before its densest part is in the kept cluster all the same.
    assert got == want
    sizes = {r.topic: r["size"] for r in topics.collect()}
    assert sizes == {t: list(want.values()).count(t) for t in set(want.values()) if t != -1}
    assert all(0 <= r.strength <= 1 and (r.strength > 0) == (r.topic != -1) for r in found.collect())


def test_forest(spark):
    edges = graph(blobs(4), 6, 3)
    df = spark.createDataFrame([(a, b, w) for w, a, b in edges], "a long, b long, w double")
    got = sorted((r.w, r.a, r.b) for r in spanning_forest(df).collect())
    assert got == kruskal(78, edges)
    assert spanning_forest(df.limit(0)).count() == 0
    assert components(df.limit(0).select("a", "b"), "none").count() == 0


def test_new_vectors(spark):
    """Topics don't change, a vector beside a member gets its topic, one far off gets none; runs agree."""
    rows = blobs(5, (20, 16), 0)
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    found, topics = density.density_clusters(df, 6, 4)
    strong = [r for r in found.collect() if r.topic != -1 and r.strength > 0.8][:10]
    new = [(1000 + r.id, [x * 1.0001 for x in rows[r.id][1]]) for r in strong] + [(5000, [-x for x in rows[0][1]])]
    got = {r.id: r for r in density.assign_by_density(spark.createDataFrame(new, df.schema), df, found, topics, 4).collect()}
    assert strong and all(got[1000 + r.id].topic == r.topic and got[1000 + r.id].strength > 0.5 for r in strong)
    assert got[5000].strength < 0.2
    late = topics.selectExpr("topic", "1e9 AS density", "densest")
    none = density.assign_by_density(spark.createDataFrame(new[:1], df.schema), df, found, late, 4).first()
    assert none.topic is None and none.strength == 0
