"""Density clusters: the hierarchy of dense regions of a set of vectors, and the regions that last longest.

Distances are those of mutual reachability over the graph of nearest neighbours. Its minimum spanning forest, read from
short edges to long ones, tells how regions grow and meet. A region of at least ``min_size`` vectors is a cluster; where two
clusters meet, a larger one begins. The clusters kept are those whose vectors stay together over the widest range of
densities; how many there are is not given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.operators.graph import components, spanning_forest
from watchloom.operators.neighbours import similar
from watchloom.session import materialize, scratch

#: Distances below this count as this, so that a density is a number.
CLOSEST = 1e-6
#: Edges that one task joins; the forest is cut so that no group has more.
GROUP_EDGES = 200_000


def reachability(vectors: DataFrame, neighbours: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """((a, b, w), (id, core)) of ``vectors`` (id, embedding): edges to the nearest neighbours, by mutual reachability.

    The core distance of a vector is the cosine distance to its ``samples``-th neighbour (to the last one if there are
    fewer); an edge's w is the largest of its distance and of both core distances.
    """
    near = materialize(
        similar(vectors, vectors, max(neighbours, samples), key="id").select(
            "query", "neighbour", "rank", F.round(1 - F.col("cosine"), 9).alias("d")
        ), "neighbours"
    )
    cores = near.where(F.col("rank") <= samples).groupBy(F.col("query").alias("id")).agg(F.max("d").alias("core"))
    pairs = near.where(F.col("rank") <= neighbours).select(
        F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b"), "d"
    ).where("a <> b").groupBy("a", "b").agg(F.min("d").alias("d"))
    edges = (
        pairs.join(cores.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a")
        .join(cores.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
        .select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))
    )
    return edges, cores


class Regions:
    """Regions of one group of nodes that grow edge by edge, shortest first.

    A region is known by its smallest node. ``size`` vectors are in it; once they are ``min_size``, it is the cluster ``own``,
    named by the edge it began with. The densities at which its vectors came to it add up to ``total``, and ``inside`` is
    what the best clusters within it are worth.
    """

    def __init__(self, min_size: int, nodes: list[dict]) -> None:
        self.min_size = min_size
        self.up = {s["node"]: s["node"] for s in nodes}
        self.state = {s["node"]: s for s in nodes}
        #: Nodes whose vectors are in no cluster yet, by region.
        self.waiting = {s["node"]: [s["node"]] for s in nodes if s["own"] is None}
        self.joins: list[dict] = []
        self.clusters: list[dict] = []

    def root(self, node):
        path = []
        while self.up[node] != node:
            path.append(node)
            node = self.up[node]
        for p in path:
            self.up[p] = node
        return node

    def close(self, s: dict, parent: str | None, density: float) -> float:
        """Ends a cluster, read from dense to thin, where it meets another; gives what it or those inside it are worth."""
        worth = s["total"] - s["size"] * density
        self.clusters.append({
            "own": s["own"], "parent": parent, "size": s["size"], "density": density, "worth": worth, "chosen": worth >= s["inside"],
        })
        return max(worth, s["inside"])

    def join(self, a, b, w: float, name: str) -> None:
        density = 1 / max(w, CLOSEST)
        x, y = sorted((self.root(a), self.root(b)))
        s, t = self.state[x], self.state.pop(y)
        size, own, total, inside = s["size"] + t["size"], None, 0.0, 0.0
        if s["own"] is not None and t["own"] is not None:
            own, total = name, size * density
            inside = self.close(s, own, density) + self.close(t, own, density)
        elif s["own"] is not None or t["own"] is not None:
            big, small = (s, t) if s["own"] is not None else (t, s)
            own, total, inside = big["own"], big["total"] + small["size"] * density, big["inside"]
            self.settle(small["node"], own, density)
        elif size >= self.min_size:
            own, total = name, size * density
            self.settle(x, own, density)
            self.settle(y, own, density)
        else:
            self.waiting[x] += self.waiting.pop(y)
        self.up[y] = x
        self.state[x] = {"node": x, "size": size, "own": own, "total": total, "inside": inside}

    def settle(self, region, own: str, density: float) -> None:
        self.joins += [{"node": node, "own": own, "density": density} for node in self.waiting.pop(region)]


def _grown(edges: DataFrame, states: DataFrame, min_size: int) -> DataFrame:
    """States, clusters and joins of each group, from its edges (grp, a, b, w, ea, eb) and its nodes (grp and state)."""
    node = states.schema["node"].dataType.simpleString()
    fields = ["kind", "node", "size", "own", "total", "inside", "parent", "density", "worth", "chosen"]
    schema = (
        f"kind string, node {node}, size long, own string, total double, inside double, parent string, density double, "
        "worth double, chosen boolean"
    )

    def grow(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        regions = Regions(min_size, right.select(["node", "size", "own", "total", "inside"]).to_pylist())
        left = left.select(["a", "b", "w", "ea", "eb"]).sort_by([("w", "ascending"), ("ea", "ascending"), ("eb", "ascending")])
        # A portion of the edges at a time becomes Python's numbers.
        for batch in left.to_batches(max_chunksize=10_000):
            for x, y, w, ea, eb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                regions.join(x, y, w, f"{ea} {eb}")
        found = {"state": regions.state.values(), "cluster": regions.clusters, "join": regions.joins}
        types = [right.schema.field("node").type if f == "node" else {"size": pa.int64(), "chosen": pa.bool_()}.get(
            f, pa.string() if f in ("kind", "own", "parent") else pa.float64()) for f in fields]
        return pa.concat_tables(
            pa.table({f: pa.array([kind if f == "kind" else r.get(f) for r in rows], t) for f, t in zip(fields, types, strict=True)})
            for kind, rows in found.items()
        )

    return edges.groupBy("grp").cogroup(states.groupBy("grp")).applyInArrow(grow, schema)


def _cut(edges: DataFrame, own) -> tuple[DataFrame, DataFrame]:
    """(edges of this round, node and root of what they join): the shortest edges, so that no group has many.

    Edges of one length are never parted, so a group of nothing but those may have more.
    """
    share = 1.0
    while True:
        limit = edges.agg(F.percentile_approx("w", share, 10_000).alias("w")).first().w
        short = edges.where(F.col("w") <= limit)
        roots = components(short.select("a", "b"), "density-groups", own)
        sizes = short.join(roots, F.col("a") == F.col("node")).groupBy("root").count()
        if share < 1e-4 or sizes.agg(F.max("count").alias("n")).first().n <= GROUP_EDGES:
            return short, roots
        share /= 4


def hierarchy(forest: DataFrame, ids: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """((own, parent, size, density, worth, chosen), (id, own, density)) of a ``forest`` (a, b, w) over ``ids`` (id).

    The first are the clusters with the density they begin at, what they are worth (over its vectors, the sum of the
    density at which each came less that at which the cluster begins) and whether that is no less than what is inside.
    The second are the vectors in a cluster, with the innermost one and the density at which they came to it. A forest's
    trees meet at density 0; a single tree is all there is, and no cluster to choose.

    Short edges come first: what they join is worked out group by group in parallel, and becomes one node of the next
    round. A task holds a group of at most ``GROUP_EDGES`` edges, ties aside.
    """
    with scratch(forest.sparkSession) as own:
        edges = own(forest.select("a", "b", "w", F.col("a").alias("ea"), F.col("b").alias("eb")), "density-edges")
        none = F.lit(None).cast("string")
        states = ids.select(
            F.col("id").alias("node"), F.lit(1).cast("long").alias("size"), none.alias("own"), F.lit(0.0).alias("total"), F.lit(0.0).alias("inside")
        )
        members = ids.select("id", F.col("id").alias("node"))
        clusters, points = [], []
        while not edges.isEmpty():
            short, roots = _cut(edges, own)
            grouped = short.join(roots.select(F.col("node").alias("a"), F.col("root").alias("grp")), "a")
            inner = states.join(roots.withColumnRenamed("root", "grp"), "node")
            out = own(_grown(grouped, inner, min_size), "density-regions")
            clusters.append(out.where("kind = 'cluster'").select("own", "parent", "size", "density", "worth", "chosen"))
            joins = out.where("kind = 'join'").select("node", F.col("own").alias("cluster"), "density")
            found = own(members.join(joins, "node", "left").join(roots, "node", "left"), "density-members")
            points.append(found.where("cluster IS NOT NULL").select("id", F.col("cluster").alias("own"), "density"))
            members = found.where("cluster IS NULL").select("id", F.coalesce("root", "node").alias("node"))
            rest = states.join(roots, "node", "left_anti")
            states = own(out.where("kind = 'state'").select(*rest.columns).unionByName(rest), "density-states")
            long = edges.join(short, ["ea", "eb"], "left_anti")
            for c in ("a", "b"):
                long = long.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
            edges = own(long.select("a", "b", "w", "ea", "eb"), "density-edges")
        last = states.where("own IS NOT NULL")
        several = last.count() > 1
        clusters.append(last.select(
            "own", none.alias("parent"), "size", F.lit(0.0).alias("density"), F.col("total").alias("worth"),
            (F.lit(several) & (F.col("total") >= F.col("inside"))).alias("chosen"),
        ))
        tree, found = clusters[0], points[0] if points else None
        for part in clusters[1:]:
            tree = tree.unionByName(part)
        for part in points[1:]:
            found = found.unionByName(part)
        if found is None:
            found = ids.select("id", none.alias("own"), F.lit(0.0).alias("density")).limit(0)
        return materialize(tree, "density-tree"), materialize(found, "density-points")


def topmost(tree: DataFrame) -> DataFrame:
    """(own, top) for the clusters of ``hierarchy``: the outermost chosen cluster that each is or lies in, or null.

    Each round doubles the stretch of ancestors that a cluster knows about.
    """
    with scratch(tree.sparkSession) as own:
        known = own(tree.select("own", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("own")).alias("top")), "density-top")
        while not known.where("up IS NOT NULL").isEmpty():
            higher = known.select(F.col("own").alias("up"), F.col("up").alias("next"), F.col("top").alias("above"))
            known = own(known.join(higher, "up", "left").select(
                "own", F.col("next").alias("up"), F.coalesce("above", "top").alias("top")
            ), "density-top")
        return materialize(known.select("own", "top"), "density-top")


def density_clusters(
    vectors: DataFrame, min_size: int, samples: int, neighbours: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """((id, topic, density, strength, core), (topic, size, density, densest)) of ``vectors`` (id, embedding).

    A topic is named by its smallest id; vectors in none have -1 (null where ids are no numbers) and strength 0. strength
    is the density at which a vector came in, as a share of the densest in its topic. Of the topics: the number of
    vectors, the density where the topic begins and that of its densest vector.
    """
    edges, cores = reachability(vectors, neighbours or 2 * samples, samples)
    forest = spanning_forest(edges, "density-forest")
    tree, points = hierarchy(forest, vectors.select("id"), min_size)
    tops = topmost(tree)
    placed = points.join(tops, "own").where("top IS NOT NULL")
    topics = placed.groupBy("top").agg(
        F.min("id").alias("topic"), F.count("*").alias("size"), F.max("density").alias("densest")
    ).join(tree.select(F.col("own").alias("top"), F.col("density").alias("begins")), "top")
    topics = materialize(topics, "density-topics")
    found = placed.select("id", "top", "density").join(topics.select("top", "topic", "densest"), "top")
    kind = vectors.schema["id"].dataType
    none = F.lit(-1).cast(kind) if kind.typeName() in ("long", "integer") else F.lit(None).cast(kind)
    labelled = vectors.select("id").join(found, "id", "left").join(cores, "id", "left").select(
        "id", F.coalesce("topic", none).alias("topic"), F.coalesce("density", F.lit(0.0)).alias("density"),
        F.coalesce(F.col("density") / F.col("densest"), F.lit(0.0)).alias("strength"), "core",
    )
    return labelled, topics.select("topic", "size", F.col("begins").alias("density"), "densest")


def assign_by_density(
    new: DataFrame, vectors: DataFrame, labelled: DataFrame, topics: DataFrame, samples: int
) -> DataFrame:
    """(id, topic, density, strength) of ``new`` (id, embedding): the topic that each vector falls into; topics stay as they are.

    ``vectors`` (id, embedding), ``labelled`` and ``topics`` are those of ``density_clusters``. A vector meets the stored ones at
    the density of its nearest one by mutual reachability. It is in that one's topic if the topic has begun at this
    density; otherwise topic is null and strength 0.
    """
    near = similar(vectors, new, samples, key="id", query_key="id", exclude_self=False).select(
        "query", F.col("neighbour").alias("id"), F.round(1 - F.col("cosine"), 9).alias("d")
    )
    known = labelled.select("id", "topic", "core")
    reached = near.join(known, "id").select("query", F.struct(F.greatest("d", "core").alias("w"), "id", "topic").alias("e"), "d")
    # Its own core distance is that to the last of its neighbours.
    best = reached.groupBy("query").agg(F.min("e").alias("e"), F.max("d").alias("own"))
    placed = best.select(
        F.col("query").alias("id"), F.col("e.topic").alias("topic"),
        (1 / F.greatest(F.col("e.w"), F.col("own"), F.lit(CLOSEST))).alias("at"),
    ).join(topics.select("topic", F.col("density").alias("begins"), "densest"), "topic", "left")
    within = F.col("at") >= F.col("begins")
    return placed.select(
        "id", F.when(within, F.col("topic")).alias("topic"), F.col("at").alias("density"),
        F.coalesce(F.when(within, F.least(F.col("at") / F.col("densest"), F.lit(1.0))), F.lit(0.0)).alias("strength"),
    )
