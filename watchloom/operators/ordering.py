"""Orderings over a whole table without moving it into one task.

Rows are put into *leaves*, small stretches of the ordering that their values determine
(a second of time, a run of file positions). A leaf is one window partition. What a leaf has
to know about the rows before it comes from a table with one row per leaf, summed in two
levels: leaves within their outer stretch (an hour, a file), and outer stretches among
themselves. Because values alone decide the leaf, a task that is run again puts every row
where it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Integers in one run of a tie-break.
_TIES_PER_RUN = 65_536
# Stands for a missing time, before all times.
_NO_TIME = -(1 << 62)


def second_leaf(ts: Column) -> list[Column]:
    """Outer hour and inner second of a UTC time."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return [F.floor(seconds / 3600).alias("_hour"), seconds.alias("_leaf")]


def time_leaf(ts: Column, grain_seconds: int) -> list[Column]:
    """Outer stretch of 3600 leaves and inner leaf of ``grain_seconds`` of a UTC time."""
    leaf = F.floor(F.unix_seconds(ts.cast("timestamp")) / grain_seconds)
    return [F.floor(leaf / 3600).alias("_hour"), leaf.alias("_leaf")]


def tie_runs(ts: str, tie: str) -> dict[str, Column]:
    """Parts of a leaf: its single times, and runs of an integer tie-break."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return {
        "_at": F.coalesce(at, F.lit(_NO_TIME)),
        "_run": F.floor(F.col(tie) / _TIES_PER_RUN),
    }


def rows_before(
    leaves: DataFrame, keys: Sequence[str], levels: Sequence[Sequence[str]], value: str
) -> DataFrame:
    """Adds ``_before``: the sum of ``value`` over all earlier leaves of the same keys.

    ``levels`` are the columns of the ordering from coarse to fine; sums run within one
    stretch of the level above, so no window is larger than the stretches it spans.
    """
    keys = list(keys)
    every = keys + [c for level in levels for c in level]
    # Said on all branches, so that they share one shuffle of the leaves.
    out = leaves = leaves.dropna(subset=every)
    parent, sums = keys, []
    for depth, level in enumerate(levels):
        here = parent + list(level)
        name = f"_sum{depth}"
        earlier = Window.partitionBy(*parent).orderBy(*level).rowsBetween(
            Window.unboundedPreceding, -1
        )
        if depth == len(levels) - 1:
            out = out.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
        else:
            totals = leaves.groupBy(*here).agg(F.sum(value).alias("_total"))
            offsets = totals.select(*here, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias(name))
            out = out.join(offsets, here)
        sums.append(name)
        parent = here
    return out.withColumn("_before", sum((F.col(n) for n in sums[1:]), F.col(sums[0]))).drop(*sums)


def number_rows(
    df: DataFrame,
    outer: Sequence[str],
    inner: Sequence[str],
    order: Sequence[str],
    name: str,
    start: int | Column = 0,
) -> DataFrame:
    """Consecutive numbers ``start + 1, start + 2, …`` along (outer, inner, order).

    ``outer`` and ``inner`` are non-NULL columns that coarsely follow the order.
    """
    leaf = [*outer, *inner]
    counts = df.groupBy(*leaf).agg(F.count(F.lit(1)).alias("_n"))
    before = rows_before(counts, [], [outer, inner], "_n").select(*leaf, "_before")
    inside = F.row_number().over(Window.partitionBy(*leaf).orderBy(*order))
    first = start if isinstance(start, Column) else F.lit(start)
    return (
        df.withColumn("_inside", inside)
        .join(before, leaf)
        .withColumn(name, (first + F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_before", "_inside")
    )


def rank_by_time(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    name: str,
    source: DataFrame | None = None,
) -> DataFrame:
    """Row number per ``key`` along (ts, tie); NULL keys form one group, NULL times come first.

    Every group is cut into seconds, and seconds into single times and runs of the integer
    ``tie``: a row's number is the number of rows in earlier parts and its place in its own.
    Neither a key nor a time with a large share of all rows is one task.

    ``source`` holds the same rows as ``df`` without its derived columns, if counting them
    there is cheaper.
    """
    group = ["_key", "_no_key"]
    fine = ["_at", "_run"]
    hour, leaf = second_leaf(F.col(ts))

    def place(frame: DataFrame) -> DataFrame:
        return _with_group(frame, key).withColumns({
            "_hour": F.coalesce(hour, F.lit(_NO_TIME)),
            "_leaf": F.coalesce(leaf, F.lit(_NO_TIME)),
            **tie_runs(ts, tie),
        })

    counts = (
        place((df if source is None else source).select(key, ts, tie))
        .groupBy(*group, "_hour", "_leaf", *fine)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    before = rows_before(counts, group, [["_hour"], ["_leaf"], fine], "_n").select(
        *group, "_leaf", *fine, "_before"
    )
    inside = F.row_number().over(Window.partitionBy(*group, "_leaf", *fine).orderBy(tie))
    return (
        place(df)
        .withColumn("_inside", inside)
        .join(before, [*group, "_leaf", *fine])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop(*group, "_hour", "_leaf", *fine, "_before", "_inside")
    )


def _with_group(df: DataFrame, key: str) -> DataFrame:
    """Adds non-NULL columns that stand for the key, so that joins and windows agree on it."""
    return df.withColumns(
        {
            "_key": F.coalesce(F.col(key).cast("string"), F.lit("")),
            "_no_key": F.col(key).isNull(),
        }
    )


def top_n(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "_rank"
) -> DataFrame:
    """First ``n`` rows per group. Spark trims each task's rows before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    out = df.withColumn(rank, position).where(F.col(rank) <= n)
    return out.drop(rank) if rank == "_rank" else out


def majority(
    df: DataFrame, group: Sequence[str], value: str, first_seen: str, out: str | None = None
) -> DataFrame:
    """Most frequent non-NULL value per group; a tie goes to the one seen first."""
    out = out or value
    votes = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_votes"), F.min(first_seen).alias("_first"))
    )
    winners = top_n(votes, group, [F.desc("_votes"), F.asc("_first")], 1)
    return winners.select(*group, F.col(value).alias(out))


def quota_head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows along ``order``."""
    return df.orderBy(*order).limit(n)


def batch_number(head: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Numbers the rows of a quota head along ``order``, and its batches of ``size`` from 0.

    Ranges of the first column are numbered apart: its first characters name a range, and sums
    over the ranges say where each begins.
    """
    stretch = F.substring(F.coalesce(F.col(order[0]).cast("string"), F.lit("")), 1, 2)
    numbered = number_rows(
        head.withColumns({"_part": F.substring(stretch, 1, 1), "_two": stretch}),
        ["_part"], ["_two"], order, "position",
    ).drop("_part", "_two")
    return numbered.withColumn("batch", F.floor((F.col("position") - 1) / size))
