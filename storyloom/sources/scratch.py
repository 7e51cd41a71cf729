"""Tables and folders that the driver and all executors share, for what a job needs to keep between its steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_written: list[str] = []
_block: ContextVar[list[str]] = ContextVar("block", default=_written)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, as in tests, a session that runs in one process gets
    a temporary one; on a cluster that is an error, as executors would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="shared-"))
    return _own[0]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _block.get().append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> int:
    """Deletes the folders in ``paths``, takes them from the list, and gives their number."""
    n = len(paths)
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def remove_written(spark: SparkSession) -> int:
    """Deletes all that this process wrote to the shared folder so far, and gives the number of tables. To be called once
    the results that read them are stored."""
    return remove(spark, _written)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What this thread writes to the shared folder in the block is deleted when the block ends, also by an error; results
    that read it have to be stored within. Blocks may be nested."""
    mine: list[str] = []
    outer = _block.set(mine)
    try:
        yield
    finally:
        _block.reset(outer)
        remove(spark, mine)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later reads don't depend on executors that held parts of it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
