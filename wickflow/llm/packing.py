"""Packing token sequences in order, with cuts chosen by dynamic programming.

The tokens of a partition's documents form one stream, which is cut into sequences of at most `window` tokens. Cuts may
fall at ends of documents (free), ends of sentences, and, where neither comes for a while, between pieces of text (at a
price each). The least sum of padding and prices is found in one pass: the padding of a sequence from i to j is
window - (j - i), so the best start for j is the least cost(i) + position(i) among the positions within the window, kept
in a monotone queue. A stream's last tokens are split at powers of two, which need no padding.

Partitions are packed apart from each other, block after block, so memory is bounded and nothing is shuffled; a task that
runs again packs the same rows alike.

Cases: null and empty texts have the end id alone; a document longer than the window spans sequences; rows that repeat a
doc_id are packed one by one, as are null ids; columns besides the id and the text are never read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .encoding import encoder
from .token_counts import text_batches

WINDOW, END_ID = 4096, 2
#: In tokens of padding: a cut at a sentence's end, a cut elsewhere, a sequence shorter than the window.
SENTENCE, INSIDE, SHORT = 2, 24, 64
#: Without a document's or sentence's end for so many tokens, cuts inside are offered at each so many.
STRIDE = 256
#: Windows whose tokens are held at once.
BLOCK = 64


@dataclass
class Item:
    """A document, or what is left of it from start on. ends: ends of its sentences, in tokens of the document."""

    doc_id: int | None
    ids: np.ndarray
    ends: np.ndarray
    start: int = 0


def places(items: list[Item], window: int) -> tuple[list[int], list[int]]:
    """Where the stream of items may be cut, and each place's price; the first is its start."""
    at, prices, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
    for x in items:
        n = len(x.ids)
        ends = x.ends[(x.ends > x.start) & (x.ends < n)]
        price = np.full(len(ends), SENTENCE)
        marks = np.concatenate([[x.start], ends, [n]])
        gaps = np.flatnonzero(np.diff(marks) > min(STRIDE, window))
        if len(gaps):
            more = np.concatenate([np.arange(marks[g] + min(STRIDE, window), marks[g + 1], min(STRIDE, window)) for g in gaps])
            ends, price = np.concatenate([ends, more]), np.concatenate([price, np.full(len(more), INSIDE)])
            order = np.argsort(ends)
            ends, price = ends[order], price[order]
        at += [ends - x.start + base, np.array([n - x.start + base])]
        prices += [price, np.zeros(1, np.int64)]
        base += n - x.start
    return np.concatenate(at).tolist(), np.concatenate(prices).tolist()


def cuts(at: list[int], prices: list[int], window: int = WINDOW) -> list[int]:
    """The cheapest places to cut, the last place included. No two neighbouring places are over a window apart."""
    cost, key, back = [0] * len(at), [0] * len(at), [0] * len(at)
    number = {p: i for i, p in enumerate(at)}
    queue = deque([0])
    key[0] = at[0]
    whole = [(window, 0)]  # lengths without padding, and their prices
    if window & (window - 1) == 0 and window >= 8:
        whole += [(window >> 1, SHORT), (window >> 2, SHORT)]
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        best = key[i] + window - p + SHORT
        for length, price in whole:
            k = number.get(p - length)
            if k is not None and cost[k] + price < best:
                best, i = cost[k] + price, k
        cost[j], back[j] = best + prices[j], i
        key[j] = k = cost[j] + p
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def powers(begin: int, end: int) -> list[int]:
    """Cuts of a stream's last tokens into sequences whose lengths are powers of two, largest first."""
    out = []
    while begin < end:
        begin += 1 << ((end - begin).bit_length() - 1)
        out.append(begin)
    return out


def pieces(items: list[Item], ends: list[int], first: int) -> tuple[list[tuple], list[Item], int]:
    """The pieces of the sequences that end at ends, the items left over, and the next sequence's number."""
    out, left, at, sequence, offset, k = [], [], 0, first, 0, 0
    for n, x in enumerate(items):
        start = x.start
        while start < len(x.ids) and k < len(ends):
            length = min(len(x.ids) - start, ends[k] - at)
            out.append((x, start, length, sequence, offset))
            start, at, offset = start + length, at + length, offset + length
            if at == ends[k]:
                k, sequence, offset = k + 1, sequence + 1, 0
        if start < len(x.ids):
            left = [Item(x.doc_id, x.ids, x.ends, start), *items[n + 1 :]]
            break
    return out, left, sequence


def packed(items: Iterator[Item], first: int = 0, window: int = WINDOW, block: int = BLOCK) -> Iterator[list[tuple]]:
    """Lists of pieces (item, start, length, sequence, offset) for a stream of items."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x.ids)
        if size >= block * window:
            ends = cuts(*places(held, window), window)[:-1]  # the last sequence may still grow
            out, held, first = pieces(held, ends, first)
            size = sum(len(x.ids) - x.start for x in held)
            yield out
    if held:
        ends = cuts(*places(held, window), window)
        begin = ends[-2] if len(ends) > 1 else 0
        if window & (window - 1) == 0:
            ends[-1:] = powers(begin, ends[-1])
        yield pieces(held, ends, first)[0]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row for each piece; with keep_ids also its ids. Sequences are numbered apart in each partition."""

    def stream(batches) -> Iterator[Item]:
        own = encoder(tokenizer)
        for whole in batches:
            for b in text_batches(whole, 1):
                texts = b.column(1).to_pylist()
                for doc_id, ids, ends in zip(b.column(0).to_pylist(), *encoded(own, texts, end_id), strict=True):
                    yield Item(doc_id, ids, ends)

    def run(batches):
        names = [x.split()[0] for x in PIECE.split(", ")]
        for found in packed(stream(batches), TaskContext.get().partitionId() << 40, window):
            columns = list(zip(*((x.doc_id, start, length, zlib.crc32(x.ids[start : start + length].astype("<u4").tobytes()), len(x.ids), sequence, offset) for x, start, length, sequence, offset in found), strict=True)) or [()] * len(names)
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if keep_ids:
                arrays.append(pa.array([x.ids[start : start + length].tolist() for x, start, length, *_ in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * keep_ids)

    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInArrow(run, PIECE + ", ids array<long>" * keep_ids).withColumnRenamed("doc_id", id)


def encoded(own, texts: list[str], end_id: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids with the end id of each text, and the ends of its sentences."""
    ids, ends = [], []
    if not own.kind:
        for x in own.encode(texts):
            ids.append(np.append(x, np.uint32(end_id)))
            ends.append(np.zeros(0, np.int64))
        return ids, ends
    for numbers in own.batch(texts):
        where = np.cumsum(own.starts[numbers + 1] - own.starts[numbers])
        ids.append(np.append(own.expand(numbers), np.uint32(end_id)))
        ends.append(np.unique(where[own.closes[numbers]]))
    return ids, ends


def op3_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
