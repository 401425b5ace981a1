"""Graphs as tables of edges: connected components and minimum spanning forests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.session import materialize, remove, scratch, scratch_path

#: Nodes that have more than one in so many of all links travel to the tasks; there are no more than twice as many.
HUBS = 1 << 12


def lowered(sides: DataFrame, lows: DataFrame, total: int) -> DataFrame:
    """``sides`` (a, b) with low, from ``lows`` (a, low, n), n being the number of rows that a has.

    Nodes with more than one in ``HUBS`` of all rows, of which there are at most twice as many as ``HUBS``, get theirs by
    broadcast, so that the rows of a hub stay where they are.
    """
    hubs = lows.where(F.col("n") * F.lit(HUBS) > F.lit(total)).select("a", F.col("low").alias("hub"))
    marked = sides.join(F.broadcast(hubs), "a", "left")
    plain = marked.where("hub IS NULL").select("a", "b").join(lows.select("a", "low"), "a")
    return plain.union(marked.where("hub IS NOT NULL").select("a", "b", F.col("hub").alias("low")))


def components(edges: DataFrame, name: str, save: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node reachable over them.

    Large-star and small-star rounds: each joins or groups by node with partial aggregation, keeps at most as many edges
    as it got, and is written to the shared folder, so that a lost executor costs one round. A round's table goes when the
    next one is there; the result is kept by ``save``. The number of rounds grows with the logarithm of the longest path.
    Nothing but counters reaches the driver.
    """
    spark = edges.sparkSession

    def write(df: DataFrame) -> tuple[str, DataFrame]:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    path, links = write(both.distinct())
    total, seen = links.count(), None
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest neighbour of that node.
        sides = links.union(links.select("b", "a"))
        lows = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n"))
        large = lowered(sides.where("b > a"), lows, total).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: every smaller neighbour, and the node itself, is linked to the smallest of them.
        lows = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = (
            lowered(large, lows, total).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .union(lows.select("a", F.col("low").alias("b"))).distinct()
        )
        former, (path, links) = path, write(small)
        remove(spark, former)
        state = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("a") <= F.col("b"))
        ).first()
        if state == seen:
            break
        seen, total = state, state[0]
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = save(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), name)
    remove(spark, path)
    return found


def spanning_forest(edges: DataFrame, name: str = "forest") -> DataFrame:
    """The minimum spanning forest of ``edges`` (a, b, w), a < b, as a table of such rows.

    Edges are ordered by (w, a, b), so that it is the only one. Borůvka rounds: each component takes its least edge out, by
    an aggregation with partial results, and what these edges join becomes one; edges inside are dropped, and of several
    between the same two components the least stays. Each round at least halves the components.
    """
    with scratch(edges.sparkSession) as own:
        least = F.struct("w", "a", "b")
        open_edges = own(edges.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), name)
        chosen = []
        while not open_edges.isEmpty():
            sides = open_edges.select(F.col("ca").alias("c"), "ca", "cb", least.alias("e")).union(
                open_edges.select(F.col("cb").alias("c"), "ca", "cb", least.alias("e"))
            )
            best = sides.groupBy("c").agg(F.min(F.struct("e", "ca", "cb")).alias("m")).select("m.*").distinct()
            best = own(best.select("e.w", "e.a", "e.b", "ca", "cb"), name)
            chosen.append(best.select("a", "b", "w"))
            roots = components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b")), name, own)
            # Every component had an edge, so every one has a root.
            joined = open_edges.join(roots.withColumnRenamed("node", "ca"), "ca").drop("ca").withColumnRenamed("root", "ra")
            joined = joined.join(roots.withColumnRenamed("node", "cb"), "cb").drop("cb").withColumnRenamed("root", "rb")
            joined = joined.where("ra <> rb").select(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb"), least.alias("e"))
            open_edges = own(joined.groupBy("ca", "cb").agg(F.min("e").alias("e")).select("e.a", "e.b", "e.w", "ca", "cb"), name)
        found = chosen[0] if chosen else open_edges.select("a", "b", "w")
        for part in chosen[1:]:
            found = found.union(part)
        return materialize(found, name)
