"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="meshfold-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (given or _own_dir()).rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: A table of known size has a file for so many rows.
FILE_ROWS = 25_000


def materialize(df: DataFrame, tag: str, *, plain: bool = False, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    plain: without a codec, whose buffers outlive the many short tasks of an iterative step. rows: about how many rows
    the step works on; a small one gets few tasks and files, whatever the number of shuffle partitions.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df = df if rows is None else df.coalesce(rows // FILE_ROWS + 1)
    df.write.parquet(path, compression="none" if plain else None)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that materialize() wrote; nothing that is still to run may read it."""
    drop_path(df.sparkSession, df.written_to)


def drop_path(spark: SparkSession, uri: str) -> None:
    """Delete a table or folder that materialize() or fresh_path() named."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of df: no row is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def slices(batches, rows: int = 512):
    """Cut Arrow batches into short ones, so that Python objects exist for few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_CACHES: list = []


def worker_cache(make):
    """A cache of what make(key) gives in a Python worker, for one operator's tasks: other operators' tasks empty it."""
    cached = lru_cache(maxsize=2)(make)
    _CACHES.append(cached)
    return cached


def give_back() -> None:
    """Return what this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def giving_back(run, uses=None):
    """A mapInArrow function after which the Python worker, which lives on, returns freed memory to the system.

    Before it, what other operators have left in the worker goes; `uses` is the worker_cache that stays.
    """

    @wraps(run)
    def task(batches):
        left = [cached for cached in _CACHES if cached is not uses and cached.cache_info().currsize]
        for cached in left:
            cached.cache_clear()
        if left:
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
