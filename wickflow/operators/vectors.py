"""Similarities of vectors of equal length, and exact search among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zscored(v: Column) -> Column:
    """v less its mean, by its population deviation plus 1e-9."""
    n = F.size(v)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    centred = F.transform(F.array(total(v) / n), lambda m: F.transform(v, lambda x: x - m))[0]
    return F.transform(F.array(centred), lambda c: F.transform(F.array(F.sqrt(total(F.transform(c, lambda x: x * x)) / n) + 1e-9), lambda s: F.transform(c, lambda x: x / s))[0])[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarities(a: Column, b: Column) -> dict[str, Column]:
    """euclidean, cosine and correlation of two z-scored columns, each in 0..1."""
    n = F.size(a)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    distance = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return {"euclidean": 1 / (1 + distance / F.sqrt(n)), "cosine": clip((F.coalesce(cosine, F.lit(0.0)) + 1) / 2), "correlation": clip((F.coalesce(cosine, F.lit(0.0)) + 1) / 2)}


#: Diagonals after which pairs that are out of reach are left.
LOOKS = 8


def dtw_many(a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Dynamic time warping of rows of a with the same rows of b: points (pairs, length, dimensions), or numbers without the last axis.

    The table's antidiagonals depend on the two before them alone, so each is one step for all pairs. A pair's last axis is that of memory.
    Distances beyond a pair's most may be infinite: a path has a cell in one of any two neighbouring diagonals, so a pair is left when all cells of both are beyond it.
    """
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    if not n or not m:
        return np.full(pairs, 0.0 if n == m else np.inf)
    a, b = (np.ascontiguousarray(np.moveaxis(x.reshape(*x.shape[:2], -1), 0, -1)) for x in (a, b[:, ::-1]))  # (length, dimensions, pairs), b backwards
    out, at = np.full(pairs, np.inf), np.arange(pairs)
    before, last, now = (np.full((n + 1, pairs), np.inf, a.dtype) for _ in "123")  # by place in a, from 1; the two diagonals before, and the next
    before[0] = 0.0
    for k in range(n + m - 1):
        low, high = max(0, k - m + 1), min(n, k + 1)
        apart = a[low:high] - b[m - 1 - k + low : m - 1 - k + high]
        cost = np.abs(apart[:, 0]) if apart.shape[1] == 1 else np.sqrt((apart**2).sum(1))
        cells = now[low + 1 : high + 1]
        np.minimum(last[low:high], last[low + 1 : high + 1], out=cells)
        np.minimum(cells, before[low:high], out=cells)
        np.add(cells, cost, out=cells)
        now[low], now[high + 1 : high + 2] = np.inf, np.inf
        if most is not None and k % LOOKS == LOOKS - 1:
            near = np.minimum(cells.min(0), last[max(0, k - m) + 1 : min(n, k) + 1].min(0)) <= most
            if np.count_nonzero(near) < 0.8 * len(near):
                at, most = at[near], most[near]
                if not len(at):
                    return out
                a, b, last, now = (x[..., near] for x in (a, b, last, now))
                before = np.full_like(now, np.inf)
        before, last, now = last, now, before
    out[at] = last[n]
    return out


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """The same of one pair of vectors, of numbers or of points (rows)."""
    return float(dtw_many(*(np.asarray(x, float)[None] for x in (a, b)))[0])


@F.pandas_udf(T.DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """dtw_many of all pairs of a batch that have the same two lengths; null if either vector is."""
    out = np.full(len(a), np.nan)
    sizes = pd.DataFrame({"a": [-1 if x is None else len(x) for x in a], "b": [-1 if x is None else len(x) for x in b]})
    for (n, m), at in sizes.groupby(["a", "b"]).indices.items():
        if min(n, m) >= 0:
            out[at] = dtw_many(*(np.array([v[i] for i in at], float).reshape(len(at), -1) for v in (a.to_numpy(), b.to_numpy())))
    return pd.Series(out).where(~np.isnan(out), None)


# ------------------------------------------------------------------ search

#: Weights of the four similarities.
EUCLIDEAN, COSINE, CORRELATION, WARPED = 0.30, 0.25, 0.20, 0.25
#: Vectors of a piece and queries of a block, which are compared at once; pairs that are warped at once.
PIECE, BLOCK, WARPS = 2000, 500, 512
#: Scores are ranked to nine places.
SLACK = 2e-9
FOUND = "query_id long, id long, lookback long, euclidean double, cosine double, correlation double, ensemble double, compared long, warped long"


def standard(v: np.ndarray) -> np.ndarray:
    return (v - v.mean(1, keepdims=True)) / (v.std(1, keepdims=True) + 1e-9)


def warp_least(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """No more than the warping distance of q and each row of v.

    A path has a cell in each row and each column. A value is no nearer to what it is warped to than to the other's least and greatest
    value, and the first and last values are warped to each other.
    """
    outside = lambda x, low, high: np.maximum(0.0, np.maximum(x - high, low - x))
    rows, columns = outside(q[None], v.min(1, keepdims=True), v.max(1, keepdims=True)), outside(v, q.min(), q.max())
    ends = np.abs(q[[0, -1]] - v[:, [0, -1]])
    for x in (rows, columns):
        x[:, [0, -1]] = np.maximum(x[:, [0, -1]], ends)
    return np.maximum(rows.sum(1), columns.sum(1))


def in_reach(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """False for rows of a and b whose warping distance is beyond most; true for all others, and for few besides.

    Warps in single precision. Values are by the pair's largest, so that with L cells at most a path's sum, at most 2 L, is off by L (L + 1) / 2^23 at most.
    """
    scale = np.maximum(np.abs(a).max(1), np.abs(b).max(1))
    scale = np.where(scale > 0, scale, 1.0)
    cells = a.shape[1] + b.shape[1] - 1
    most = most / scale + cells * (cells + 1) / 2**23
    return dtw_many(*((x / scale[:, None]).astype(np.float32) for x in (a, b)), most) <= most


def compared(v: np.ndarray, q: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int, least: float, by: str) -> Iterator[tuple]:
    """For each query the k best rows of v: (query, row, euclidean, cosine, correlation, score, rows warped).

    A product of matrices gives a bound on each pair's score. The exact scores of the 2 k rows of the best bounds set a floor, and of the others
    only rows whose bound is above it are warped, in single precision and as far as they stay in reach of it; what is left has its exact score.
    """
    n, warps = v.shape[1], by == "ensemble"
    root = np.sqrt(n)
    zv, zq = standard(v), standard(q)
    sizes, asked = ((z * z).sum(1) for z in (zv, zq))
    dots = zq @ zv.T

    def alike(j: int) -> np.ndarray:
        norms = np.sqrt(asked[j] * sizes)
        return np.clip((np.divide(dots[j], norms, out=np.zeros_like(norms), where=norms > 0) + 1) / 2, 0, 1)

    def bounds(j: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row no less than its score without warping, and than its score; -inf for those that are no answer."""
        far = asked[j] + sizes - 2 * dots[j] - 4e-15 * n * (asked[j] + sizes)  # less what rounding can add
        base = 1 / (1 + np.sqrt(np.maximum(far, 0.0)) / root)
        reach = base
        if warps:
            base = EUCLIDEAN * base + (COSINE + CORRELATION) * alike(j)
            ends = np.abs(q[j, 0] - v[:, 0])
            if n > 1:
                ends += np.abs(q[j, -1] - v[:, -1])
            reach = base + WARPED / (1 + ends / root)
        return base, np.where((ids == query_ids[j]) | np.isnan(reach), -np.inf, reach)

    def scored(j: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Euclidean similarity and score of pairs."""
        near, score = np.empty(len(j)), np.empty(len(j))
        for s in (slice(x, x + WARPS) for x in range(0, len(j), WARPS)):
            near[s] = 1 / (1 + np.sqrt(((zv[i[s]] - zq[j[s]]) ** 2).sum(1)) / root)
            if warps:
                same = np.array([likeness[x][y] for x, y in zip(j[s], i[s], strict=True)])
                base = EUCLIDEAN * near[s] + (COSINE + CORRELATION) * same
                score[s] = np.clip(base + WARPED / (1 + dtw_many(q[j[s]], v[i[s]]) / root), 0, 1)
            else:
                score[s] = near[s]
        return near, score

    likeness = [alike(j) for j in range(len(q))]
    best: list[list[tuple]] = [[] for _ in q]
    warped = np.zeros(len(q), int)

    def add(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        j, i = (np.concatenate(x) for x in zip(*pairs, strict=True))
        for row in zip(j.tolist(), i.tolist(), *(x.tolist() for x in scored(j, i)), strict=True):
            if row[3] >= least:
                best[row[0]].append(row[1:])
        for x in np.unique(j):
            best[x] = sorted(best[x], key=lambda r: (-round(r[2], 9), ids[r[0]]))[:k]

    first = []
    for j in range(len(q)):
        _, reach = bounds(j)
        at = np.argpartition(-reach, min(2 * k, len(reach)) - 1)[: 2 * k]
        at = at[(reach[at] >= least - SLACK) & (reach[at] > -np.inf)]
        first.append((np.full(len(at), j), at))
        warped[j] += len(at) * warps
    add(first)
    rest, within = [], []
    for j in range(len(q)):
        base, reach = bounds(j)
        reach[first[j][1]] = -np.inf
        floor = max(least, best[j][-1][2] if len(best[j]) == k else -np.inf) - SLACK
        at = np.flatnonzero((reach >= floor) & (reach > -np.inf))
        if warps and len(at):
            at = at[base[at] + WARPED / (1 + warp_least(q[j], v[at]) / root) >= floor]
            need = floor - base[at]
            within.append(np.where(need > 0, root * (WARPED / np.maximum(need, 1e-300) - 1), np.inf))
            warped[j] += len(at)
        rest.append((np.full(len(at), j), at))
    if warps and within:
        j, i = (np.concatenate(x) for x in zip(*rest, strict=True))
        most = np.concatenate(within)
        order = np.argsort(most)  # those that are left early are left together
        kept = [x[in_reach(q[j[x]], v[i[x]], most[x])] for x in (order[s : s + WARPS] for s in range(0, len(order), WARPS))]
        kept = np.concatenate([*kept, order[:0]])
        rest = [(j[kept], i[kept])]
    add(rest)
    for j in range(len(q)):
        yield from ((j, i, near, likeness[j][i], likeness[j][i], score, 0) for i, near, score in best[j])
        yield j, -1, None, None, None, None, int(warped[j])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0, by: str = "ensemble", effort: bool = False) -> DataFrame:
    """The k most similar vectors (id, lookback, vector) of each query (query_id, lookback, vector): of its length, and its lookback unless that is null.

    by: ensemble, of four similarities of which warping is of the values as they are and the others of z-scores, or euclidean. Vectors of
    constant values have cosine 0 to all. A query's own id is no answer. Null and empty vectors are left out, and so are pairs whose score isn't a number.
    Vectors of a length and lookback are dealt by hash to pieces, and queries to blocks; each piece and block are compared in a task by
    matrix products. Warping is last, and only of pairs whose bound on the score isn't under the piece's k-th score so far, so the k are exact.
    With effort, the numbers of pairs compared and warped for each query instead.
    """
    own = lambda d, x: d.where(F.size("vector") > 0).select(x, F.col("lookback").cast("long").alias("lookback"), F.size("vector").alias("length"), F.col("vector").cast("array<double>").alias("vector"))
    v, q = own(vectors, "id").withColumn("_group", F.concat_ws(":", "length", "lookback")), own(queries, "query_id")
    groups = v.groupBy("_group", F.col("lookback").alias("_lookback"), F.col("length").alias("_length")).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("_pieces"))
    fits = (F.col("length") == F.col("_length")) & (F.col("lookback").isNull() | (F.col("lookback") == F.col("_lookback")))
    asked = q.join(groups, fits).select("query_id", "vector", "_group")  # groups are as many as lookbacks and lengths
    blocks = asked.groupBy("_group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).join(groups, "_group")
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n.cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    unit = ["_group", "_lookback", "_piece", "_block"]
    left = v.join(blocks, "_group").withColumn("_piece", dealt("id", F.col("_pieces"))).withColumn("_block", each(F.col("_blocks"))).select("id", "vector", *unit)
    right = asked.join(blocks, "_group").withColumn("_block", dealt("query_id", F.col("_blocks"))).withColumn("_piece", each(F.col("_pieces"))).select("query_id", "vector", *(F.col(x).alias(f"_q{x}") for x in unit))

    def run(key: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(asked):
            ids, query_ids = own["id"].to_numpy(), asked["query_id"].to_numpy()
            for j, i, *scores, warped in compared(np.array(own["vector"].tolist(), float), np.array(asked["vector"].tolist(), float), ids, query_ids, k, least, by):
                rows.append((query_ids[j], None if i < 0 else ids[i], key[1], *scores, len(own) if i < 0 else 0, warped))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")]).astype({"id": "Int64", "lookback": "Int64"})

    found = left.groupBy(*unit).cogroup(right.groupBy(*(f"_q{x}" for x in unit))).applyInPandas(run, FOUND)
    if effort:
        return found.where("id IS NULL").groupBy("query_id").agg(F.sum("compared").alias("compared"), F.sum("warped").alias("warped"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(by, 9)), "id"))
    out = found.where("id IS NOT NULL").drop("compared", "warped").withColumn("rank", rank).where(F.col("rank") <= k)
    return out if by == "ensemble" else out.drop("ensemble")


class VectorIndex:
    """Vectors with a lookback and metadata in a Parquet table, in a folder for each lookback and length, that is only added to."""

    SCHEMA = "id long, vector array<double>, metadata map<string,string>, lookback long, length int"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def add(self, items: DataFrame) -> None:
        """items: id, lookback, vector, and metadata (a map of strings) if there is any."""
        metadata = F.col("metadata") if "metadata" in items.columns else F.lit(None).cast("map<string,string>")
        rows = items.select(F.col("id").cast("long"), F.col("vector").cast("array<double>"), metadata.alias("metadata"), F.col("lookback").cast("long"), F.size("vector").alias("length"))
        rows.where("length > 0").write.mode("append").partitionBy("lookback", "length").parquet(self.path)

    def items(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)  # nothing was added yet

    def search(self, queries: DataFrame, k: int = 10, minimum_similarity: float = 0.85, metadata: tuple[str, ...] = ()) -> DataFrame:
        """search() among all items; the named metadata of each one found as columns."""
        items = self.items()
        found = search(items, queries, k, minimum_similarity)
        if not metadata:
            return found
        told = items.select("id", F.col("lookback").alias("_lookback"), *(F.col("metadata")[x].alias(x) for x in metadata)).dropDuplicates(["id", "_lookback"])
        return found.join(told, (found.id == told.id) & found.lookback.eqNullSafe(told._lookback), "left").drop(told.id, told._lookback)
