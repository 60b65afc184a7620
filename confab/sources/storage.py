"""Where tables for later reading go: the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where each written table is.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths written on the way to the innermost ``settled`` table.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Without it a local session gets a temporary folder; a cluster has none that all share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="confab-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, in a folder of the application's own."""
    return f"{shared_folder(spark)}/confab/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    if (made := _MADE.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def deleted(df: DataFrame) -> None:
    """Deletes the table behind ``df``, a result of ``written`` that nothing reads any more."""
    _delete(df.sparkSession, [_PATHS.pop(df)])


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """``make()``, written; the tables written on the way to it are deleted once it is complete, or if it fails.

    ``make`` must not hand out a table by another way. Nothing is computed again from what is deleted: the
    result stands in the shared folder as a whole.
    """
    made: list[str] = []
    mark = _MADE.set(made)
    out = None
    try:
        out = written(make(), label)
    finally:
        _MADE.reset(mark)
        _delete(SparkSession.active(), made if out is None else made[:-1])
    if (outer := _MADE.get()) is not None:
        outer.append(made[-1])
    return out


def settling(label: str) -> Callable:
    """A decorator: the function's table is ``settled``."""

    def wrap(function):
        @functools.wraps(function)
        def run(*args, **kw):
            return settled(lambda: function(*args, **kw), label)

        return run

    return wrap


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def cleared(spark: SparkSession) -> None:
    """Deletes what this application has written there. Results are lazy and may still read it: call it after the last."""
    _delete(spark, [f"{shared_folder(spark)}/confab/{spark.sparkContext.applicationId}"])
