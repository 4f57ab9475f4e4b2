"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import scratch, shared_dir, shared_path, written  # noqa: F401  for the operators

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


_clear: list[Callable[[], None]] = []


def sole_cache(clear: Callable[[], None]) -> None:
    """Called by an operator's code in a Python worker before it fills a cache: what others have cached there goes first."""
    if _clear == [clear]:
        return
    for other in _clear:
        other()
    if _clear:
        gc.collect()
        with suppress(OSError, AttributeError):  # the C library keeps what was freed, unless it is told to give it back
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    _clear[:] = [clear]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null and for text without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def n_words(text: Column) -> Column:
    """Number of words: the separators inside the trimmed text, and one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_hot(left: DataFrame, right: DataFrame, on: str, hot: list, how: str) -> DataFrame:
    """Equi-join with a right side of unique keys, the few hot ones by broadcast and all others by shuffle."""
    if not hot:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), on, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), on, how))


def join_by_count(left: DataFrame, right: DataFrame, on: str, count: str, how: str = "left", share: int = 256) -> DataFrame:
    """Equi-join with a right side of unique keys, whose column count says how many left rows each key has.

    A key with over 1/share of all counted rows would fill a task by itself. There are fewer than share such keys,
    whatever the input's size, so they go by broadcast; all others go by shuffle.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in right.where(F.col(count) > max(1000, total // share)).select(on).collect()]
    return split_hot(left, right.drop(count), on, hot, how)


#: Rows that one task may well take of a single key.
FEW_ROWS = 100_000


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "inner", share: int = 256) -> DataFrame:
    """join_by_count for a right side that doesn't know the counts: one aggregate of left's keys finds the hot ones."""
    total = left.count()
    bound = max(FEW_ROWS, total // share)
    if total <= bound:
        return left.join(right, on, how)
    hot = [r[0] for r in left.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > bound).select(on).collect()]
    return split_hot(left, right, on, hot, how)
