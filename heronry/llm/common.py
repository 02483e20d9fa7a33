"""Folders, tables and Arrow batches shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.sources.tables import shared_dir

#: Bytes of text that a vectorised step takes at once; a longer text is taken alone.
SLICE_BYTES = 1 << 19
#: Rows and bytes that Spark sends to a Python worker at once; long texts make batches of few rows.
BATCH_ROWS, BATCH_BYTES = 50_000, 2 << 20


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/heronry-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later steps survive a lost executor and don't redo it."""
    return materialise_at(df, name)[0]


def materialise_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As materialise, with the folder, so that the caller can drop a table that later tables have replaced."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles that nothing refers to any more, before the next ones need the disk."""
    gc.collect()
    if (jvm := getattr(spark, "_jvm", None)) is not None:  # a remote session has none, and its server cleans by itself
        jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this process wrote under the shared folder; a remote session leaves it to its server."""
    if not path.startswith(f"{shared_dir(spark)}/heronry-"):
        raise ValueError("not a folder of this process")
    if (jvm := getattr(spark, "_jvm", None)) is not None:
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as it takes to be none of df's columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def require_free(df: DataFrame, *names: str) -> None:
    """Raise if df has a column of one of the names: nothing that a caller brings along is overwritten."""
    if clash := sorted({n.lower() for n in names} & {c.lower() for c in df.columns}):
        raise ValueError(f"columns named {clash} are there already: rename them, or pass another name")


def bound_batches(spark: SparkSession) -> None:
    """Keep the memory of Python workers small: executors share theirs with the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def same_row(docs: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Join on doc_id, which may be null, and th."""
    right = other.withColumnRenamed("doc_id", "r_id").withColumnRenamed("th", "r_th")
    at = (F.coalesce(docs["doc_id"], F.lit(0)) == F.coalesce(F.col("r_id"), F.lit(0))) & (docs["th"] == F.col("r_th")) & docs["doc_id"].isNull().eqNullSafe(F.col("r_id").isNull() & F.col("r_th").isNotNull())
    return docs.join(right, at, how).drop("r_id", "r_th")


def at_most(rows: DataFrame, times: int) -> DataFrame:
    """rows (doc_id, th and others) with those that agree in doc_id and th cut to ``times`` of them: what is the same for
    two copies and for a million is worked out on ``times`` copies."""
    many = rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > times).select("doc_id", "th")
    many = materialise(many, "copied")
    if not many.take(1):
        return rows
    one = same_row(rows, many, "left_semi").dropDuplicates(["doc_id", "th"])
    if times > 1:
        one = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("copy")
    return same_row(rows, many, "left_anti").unionByName(one)


def trim() -> None:
    """Give memory that this process has freed back to the machine: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slice_ends(column: pa.Array, most: int = SLICE_BYTES) -> list[int]:
    """Ends of parts of ``column`` that hold about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return [*(np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1).tolist(), len(column)]


def in_slices(column: pa.Array, f: Callable[[pa.Array], pa.Array], most: int = SLICE_BYTES) -> pa.Array:
    """f over parts of a column of text, put together again."""
    out, begin = [], 0
    for end in slice_ends(column, most):
        if end > begin or len(column) == 0:
            out.append(f(column.slice(begin, end - begin)))
        begin = end
    trim()
    return pa.concat_arrays(out)


def batch_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``most`` bytes in each."""
    for batch in batches:
        begin = 0
        for end in slice_ends(batch.column(column), most):
            if end > begin:
                yield batch.slice(begin, end - begin)
            begin = end
    trim()
