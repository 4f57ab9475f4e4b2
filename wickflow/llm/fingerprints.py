"""Document fingerprints by winnowing.

Every k code points have a rolling hash; of each window of w neighbouring hashes the least is chosen, the rightmost of
equal ones, with its position. Two texts that share a passage of at least w + k - 1 code points share a chosen hash.

Cases: an empty (or null) text has an empty fingerprint, a text shorter than k one hash of all of it, one with fewer
than w hashes the least of them; equal texts have equal fingerprints; two empty ones are alike (1), an empty and
another one are not (0); rows that tie in doc_id are ordered by text; null ids come first; an empty table gives no rows;
very long texts are hashed whole, in batches of few bytes or one text; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read
from .token_counts import text_batches

K, W = 16, 24
BASE = 0x9E3779B97F4A7C15 | 1
NO_ID = -(2**63)


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """64-bit hashes of every k code points (of all of a shorter text), k a power of two: each doubling joins two halves."""
    h = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    if 0 < len(h) < k:
        h, k = np.concatenate([h, np.zeros(k - len(h), np.uint64)]), k
    base, length = BASE, 1
    while length < k and len(h) > length:
        h = h[:-length] * np.uint64(base) + h[length:]
        base, length = base * base % 2**64, 2 * length
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits) and their positions, in order of position."""
    h = gram_hashes(text, k)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    # The hash above, the position from the end below: the least is the least hash, rightmost of equal ones.
    least = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    w, length = min(w, n), 1
    while 2 * length <= w:
        least, length = np.minimum(least[:-length], least[length:]), 2 * length
    if length < w:
        least = np.minimum(least[: n - w + 1], least[w - length :])
    chosen = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of chosen hashes."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    """Eight hex digits of each hash, and eight of its position."""
    return np.stack([hashes.astype(np.uint32), positions.astype(np.uint32)], 1).astype(">u4").tobytes().hex()


def covered(hashes: np.ndarray, positions: np.ndarray, other: np.ndarray, n: int, k: int = K) -> int:
    """How many of a text's n code points lie in chosen k-grams that the other fingerprint has too."""
    at = positions[np.isin(hashes, other)]
    if not len(at):
        return 0
    ends = np.minimum(at + k, n)
    return int((ends - np.maximum(at, np.concatenate([[0], ends[:-1]]))).sum())


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: id, and the chosen hashes with their positions."""

    def run(batches):
        for whole in batches:
            for b in text_batches(whole, 1):
                found = [[{"hash": int(h), "position": int(p)} for h, p in zip(*fingerprint(x or ""), strict=True)] for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())])))], names=["id", "hashes"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, hashes array<struct<hash:long,position:long>>").withColumnRenamed("id", id)


def range_of(key: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at most key, by binary search."""
    steps = max(1, math.ceil(math.log2(len(splits) + 1)))
    at = F.lit(splits) if splits else F.array().cast("array<bigint>")
    return F.aggregate(F.lit([1 << i for i in range(steps - 1, -1, -1)]), F.lit(0), lambda lo, step: F.when(F.get(at, lo + step - 1) <= key, lo + step).otherwise(lo))


def with_next(docs: DataFrame, function, schema: str) -> DataFrame:
    """function over batches of (flag, doc_id, text) that are sorted by doc_id in each range of ids.

    A range ends with a row of flag 1: a copy of the row that follows it, which is the first of the next range, or of all.
    Ranges come from quantiles, so that no task has many more rows than others; there is one row of flag 1 for each.
    """
    spark, key = docs.sparkSession, F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    n = partitions(spark)
    splits = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    splits = sorted(set(splits or []))
    rows = docs.select(F.lit(0).alias("_flag"), "doc_id", "text", key.alias("_key")).withColumn("_range", range_of(F.col("_key"), splits))
    firsts = sorted(map(tuple, rows.groupBy("_range").agg(F.min("_key")).collect()))  # a row for each range
    if not firsts:
        return spark.createDataFrame([], schema)
    before = {own: firsts[i - 1][0] for i, (own, _) in enumerate(firsts)}
    heads = rows.where(F.col("_key").isin([k for _, k in firsts]) if firsts[0][1] != NO_ID else F.col("doc_id").isNull() | F.col("_key").isin([k for _, k in firsts]))
    heads = heads.groupBy("_range").agg(F.min(F.struct("_key", "text", "doc_id")).alias("_"))
    heads = heads.join(F.broadcast(spark.createDataFrame(list(before.items()), "_range int, _before int")), "_range")
    heads = heads.select(F.lit(1).alias("_flag"), "_.doc_id", "_.text", "_._key", F.col("_before").alias("_range"))
    dealt = rows.unionByName(heads).repartitionById(n, F.col("_range")).sortWithinPartitions("_range", "_flag", "_key", "text")
    return dealt.select("_flag", "doc_id", "text").mapInArrow(function, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, matched_chars long"


def edited(text: str, after: str) -> str:
    """text, its last half replaced by as much of the beginning of after."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_edited(batches):
    """A row of EDITED for each row of flag 0, from the row after it. matched_chars: code points in grams that the edited text shares."""
    names = [x.split()[0] for x in EDITED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    last = None
    for whole in batches:
        for b in text_batches(whole, 2):
            out = []
            for flag, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                own = fingerprint(text)
                if last is not None:
                    other = edited(last[1], text)
                    changed = fingerprint(other)
                    out.append((last[0], len(last[1]), hashlib.sha256(other.encode()).hexdigest(), as_text(*last[2]), as_text(*changed), likeness(last[2][0], changed[0]), likeness(last[2][0], own[0]), covered(*last[2], changed[0], len(last[1]))))
                last = None if flag else (doc_id, text, own)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), compare_edited, EDITED)
