"""Session settings the package relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "watchloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package expects; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone and make sure a checkpoint folder is set."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    A machine-local folder is used only in local mode where none is named, as in tests. On a
    cluster it would hold parts of a table only, so a session without shared folder is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "watchloom-checkpoints")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, for results that are read several times.

    It cuts the lineage: a lost executor costs a read of the table, not the work behind it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, compression: str = "snappy") -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``materialize`` whose tables go when the block ends; what leaves the block must not read them any more."""
    names: list[str] = []

    def own(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        names.append(path)
        df.write.parquet(path, compression=compression)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield own
    finally:
        for path in names:
            remove(spark, path)


#: Whether the shuffle files of a query go when it ends; otherwise they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within the block a query's shuffle files are deleted as soon as the query ends, on all executors.

    For jobs that write each step as a table: what a step has shuffled is not read again.
    """
    former = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if former is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, former)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder wherever Spark can reach it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def together(*jobs: Callable[[], Any]) -> list[Any]:
    """Runs independent Spark actions side by side, so that small jobs share the executors."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]
