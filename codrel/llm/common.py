"""Helpers shared by the operators: the folder that driver and executors share, written tables, text input."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="codrel-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the session sets none."""
    return (spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_folder()).rstrip("/")


#: The folder, below that of all tables, of the ``scratch`` that is open.
_scratch: ContextVar[str] = ContextVar("_scratch", default="")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codrel/{_scratch.get()}{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of plans that nothing refers to any more, which otherwise wait for the driver's next full collection."""
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """In a worker of Python: returns to the system what a task has freed. Workers live from task to task, and what the allocators keep counts against the executor."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted when the block ends, however it ends; what it gives writes a table that stays."""
    outer = _scratch.get()
    mine = f"{outer}{name}-{uuid.uuid4().hex}/"

    def keep(df: DataFrame, table_name: str) -> DataFrame:
        inside = _scratch.set(outer)
        try:
            return written(df, table_name)
        finally:
            _scratch.reset(inside)

    opened = _scratch.set(mine)
    try:
        yield keep
    finally:
        _scratch.reset(opened)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/codrel/{mine}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        release(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and lineage ends there.

    Losing an executor later costs a reread, not a recomputation. The files stay until the
    ``scratch`` around ends, or without one until the owner of the folder clears it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_in_buckets(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """The same, dealt into as many buckets as the session has shuffle partitions by the hash of ``keys``: joins on all of them do not shuffle it again.

    The catalogue forgets the table as soon as it is read; the files stay as those of ``written`` do.
    """
    spark = df.sparkSession
    known = f"codrel_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(shuffle_partitions(spark), *keys).option("path", new_path(spark, name)).saveAsTable(known)
    out = spark.table(known)
    spark.sql(f"DROP TABLE {known}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Stands for a null id where ids are ordered or leave the JVM.
NO_ID = -(2**63)


def id_or_least(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def shown_id(column: Column) -> Column:
    return F.when(column != NO_ID, column)
