"""Readers for tables stored as parquet under one directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Where tables are written between steps when a local session names no spark.checkpoint.dir.
LOCAL_SHARED = "file:///tmp/checkpoints/heronry"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a session whose tasks all run in
    the driver's process may go without the setting; a cluster must name a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.conf.get("spark.master", "")
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


#: Names and paths of the tables that were cut inside of ``released``.
_HELD: ContextVar[list[tuple[str, str]] | None] = ContextVar("held", default=None)


def cut(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """rows written to the shared folder and read again, for tables that several later steps read: each of them would
    plan and run the whole way to it once more. by: columns whose values have folders of their own, so that readers of one
    value open its files only."""
    path = f"{shared_dir(rows.sparkSession)}/heronry-{name}-{uuid.uuid4().hex}"
    if (held := _HELD.get()) is not None:
        held.append((name, path))
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """A folder and all that is in it; one that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables that are cut inside are deleted at the end, for steps that write what they give: nothing that reads such a
    table may be left then. Gives a function that deletes those of some names earlier."""
    held: list[tuple[str, str]] = []
    token = _HELD.set(held)

    def release(*names: str) -> None:
        for each in [h for h in held if h[0] in names]:
            delete(spark, each[1])
            held.remove(each)

    try:
        yield release
    finally:
        _HELD.reset(token)
        release(*{name for name, _ in held})


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to as many tasks as the session's shuffles have, for rows that take long each: a small file of
    many rows is one or two tasks, and adaptive execution joins small partitions that no number was asked for."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt_by_size(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """rows dealt by keys to tasks of about ``most`` rows, however many rows there are: what a task sorts or collects then
    stays as large as it is. Counts the rows, which costs next to nothing for a table as it is stored."""
    return rows.repartition(max(1, -(-rows.count() // most)), *keys)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` under ``root``; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{root}/{name}.parquet")
