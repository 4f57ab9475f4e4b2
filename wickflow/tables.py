"""Tables between steps, in the folder that driver and executors share.

A table cuts the lineage and survives the loss of executors. It belongs to the scratch() scope that it was written in, and is removed at its
end. What a scope keeps, because its result is read later, belongs to the scope around it, and without one stays until release().
Scopes are those of a context: queries that run on other threads have their own.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
_kept: set[str] = set()
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or a new one in local mode where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        with _lock:
            if not context._jsc.sc().getCheckpointDir().isDefined():
                if not context.master.startswith("local"):
                    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
                context.setCheckpointDir(tempfile.mkdtemp(prefix="wickflow-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found


def belongs(path: str) -> None:
    """path is removed with the scope at hand, or else by release()."""
    scopes = _scopes.get()
    if scopes:
        scopes[-1].append(path)
    else:
        with _lock:
            _kept.add(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/wickflow/{name}-{uuid.uuid4().hex}"
    belongs(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table, read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def removed(spark: SparkSession, paths: list[str]) -> None:
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are removed at the end, but for those handed to the function that this yields."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch_path)
        return df

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for x in own:
            if x in kept:
                belongs(x)
        removed(spark, [x for x in own if x not in kept])


def release(spark: SparkSession) -> None:
    """Removes the tables that results of this process still use outside any scope: for a caller that has read them."""
    with _lock:
        paths = sorted(_kept)
        _kept.clear()
    removed(spark, paths)
