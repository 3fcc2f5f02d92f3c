"""Shared scratch folder, and tables cut off from their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables of the innermost scope that is open in this thread or task.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder that ``spark.checkpoint.dir`` names.

    Only where the setting is absent and Spark runs in one process, as in tests, a
    temporary folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{_home(spark, root)}/{uuid.uuid4().hex}"


def _home(spark: SparkSession, root: str) -> str:
    """The folder of this application's tables."""
    return f"{root.rstrip('/')}/glossmill-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at the end, and no others; results that read them have to be computed by then."""
    token = _SCOPE.set([])
    try:
        yield
    finally:
        drop(spark, *_SCOPE.get())
        _SCOPE.reset(token)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written, without the tables that were written on the way."""
    path = scratch_dir(spark)
    with scope(spark):
        df = make()
        df.write.parquet(path)
    if (outer := _SCOPE.get()) is not None:
        outer.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_all(spark: SparkSession) -> None:
    """Removes all tables that this application has left in the shared folder; call it when no result is still to be computed."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        drop(spark, _home(spark, root))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
