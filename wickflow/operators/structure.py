"""Turning points and the structure of swings.

The zigzag is a state machine over a series' closes. It runs as a stream over sorted partitions with a state of a few
numbers, so a series of any length needs no more memory than a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import SERIES

TURNS = "symbol string, timeframe string, index long, confirmation_index long, direction string, price double"


class Zigzag:
    """Finds a turn once the close has moved back by the threshold from the extreme; the first price is the first reference."""

    def __init__(self, threshold: float) -> None:
        self.up, self.down, self.trend = 1 + threshold, 1 - threshold, 0
        self.at, self.price = -1, 0.0

    def push(self, idx: int, close: float) -> tuple | None:
        """The turn that this close confirms: (index, confirmation index, direction, price)."""
        if self.at < 0:
            self.at, self.price = idx, close
            return None
        ratio = close / self.price
        if not self.trend:
            self.trend = (ratio >= self.up) - (ratio <= self.down)
            if self.trend:
                self.at, self.price = idx, close
            return None
        if (close - self.price) * self.trend > 0:
            self.at, self.price = idx, close
            return None
        if ratio <= self.down if self.trend > 0 else ratio >= self.up:
            out = (self.at, idx, "DOWN" if self.trend > 0 else "UP", self.price)
            self.at, self.price, self.trend = idx, close, -self.trend
            return out
        return None


def zigzag_turns(candles: DataFrame, threshold_pct: float) -> DataFrame:
    """Turns of indexed candles, as (index, confirmation_index, direction, price): DOWN ends a rise, UP ends a fall."""
    return turns_of_each(candles, [threshold_pct]).drop("threshold")


def turns_of_each(candles: DataFrame, thresholds_pct: list[float]) -> DataFrame:
    """zigzag_turns with threshold, for several thresholds in one pass."""
    names = [x.split()[0] for x in TURNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machines = None, []
        for batch in batches:
            out = []
            for symbol, timeframe, idx, close in batch.itertuples(index=False, name=None):
                if (symbol, timeframe) != key:
                    key, machines = (symbol, timeframe), [(x, Zigzag(x / 100)) for x in thresholds_pct]
                for threshold, machine in machines:
                    if turn := machine.push(idx, close):
                        out.append((*key, *turn, threshold))
            yield pd.DataFrame(out, columns=[*names, "threshold"])

    rows = candles.select(*SERIES, F.col("idx").cast("long").alias("idx"), "close").where("close IS NOT NULL AND close <> 0")
    return rows.repartition(*SERIES).sortWithinPartitions(*SERIES, "idx").mapInPandas(run, f"{TURNS}, threshold double")


def structure(turns: DataFrame) -> DataFrame:
    """turns with position, kind against the turn before of the same direction, and sizes of swing and leg."""
    w = Window.partitionBy(*SERIES).orderBy("index")
    same = Window.partitionBy(*SERIES, "direction").orderBy("index")
    before, p = F.lag("price").over(same), F.col("price")
    top = F.col("direction") == "DOWN"
    kind = F.when(before.isNull(), None).when(top, F.when(p > before, "HH").otherwise("LH")).otherwise(F.when(p > before, "HL").otherwise("LL"))
    return turns.withColumns({
        "position": F.row_number().over(w) - 1, "pivot_type": kind, "previous_same_type_price": before, "swing_pct": (F.try_divide(p, before) - 1) * 100,
        "bars_since_prev": F.col("index") - F.lag("index").over(w), "leg_pct": (F.try_divide(p, F.lag("price").over(w)) - 1) * 100, "normalized_price": F.try_divide(p, F.first("price").over(w)),
    })


#: Weights of the parts of structure similarity, and scales of their differences.
PARTS = {"type": 0.40, "swing": 0.20, "leg": 0.20, "duration": 0.15, "shape": 0.05}
SCALES = {"swing": 2.0, "leg": 4.0, "duration": 1.0, "shape": 0.05}


def checked(parts: dict[str, float]) -> dict[str, float]:
    """parts, if they are weights: none negative, and 1 in all."""
    if min(parts.values()) < 0 or abs(sum(parts.values()) - 1) > 1e-9:
        raise ValueError("weights must not be negative and must add up to 1")
    return parts


def runs(pivots: DataFrame, n: int) -> DataFrame:
    """A row for each run of n pivots: position, index and confirmation of its last pivot, the first's index, and all n as arrays."""
    w = Window.partitionBy(*SERIES).orderBy("position").rowsBetween(1 - n, 0)
    some = lambda c, d: F.collect_list(F.coalesce(c, F.lit(d))).over(w)
    price = F.collect_list("normalized_price").over(w)
    out = pivots.select(
        *SERIES, F.col("position").alias("end_position"), F.first("index").over(w).alias("start_index"), F.col("index").alias("end_index"), F.col("confirmation_index").alias("confirmation"),
        some("pivot_type", "?").alias("types"), some("swing_pct", 0.0).alias("swing"), some("leg_pct", 0.0).alias("leg"), some(F.col("bars_since_prev").cast("double"), 1.0).alias("bars"), price.alias("shape"),
    )
    return out.where(F.col("end_position") >= n - 1).withColumn("shape", F.transform("shape", lambda x: F.try_divide(x, F.element_at("shape", -1))))


def match_structures(pivots: DataFrame, targets: DataFrame, n: int = 8, top_k: int = 10, least: float = 0.0, scales: dict[str, float] = SCALES, parts: dict[str, float] = PARTS) -> DataFrame:
    """The earlier runs of n pivots most like the run that ends at each target (symbol, timeframe, end_position).

    A candidate ends n positions before the target at least, and is confirmed before it. A run is one row with its pivots in
    arrays, so a pair of runs is one row too, and its similarity an expression. Targets are a bounded sample of each series
    (outcomes.sampled_endpoints) or its last pivot.
    """
    every, parts = runs(pivots, n), checked(parts)
    a = every.join(targets.select(*SERIES, "end_position").distinct(), [*SERIES, "end_position"]).where(F.col("end_position") + 1 >= 2 * n)
    a = a.select(*SERIES, F.col("end_position").alias("target"), *(F.col(c).alias(f"a_{c}") for c in ("confirmation", "types", "swing", "leg", "bars", "shape")))
    pairs = a.join(every, SERIES).where((F.col("end_position") <= F.col("target") - n) & (F.col("confirmation") < F.col("a_confirmation")))
    mean = lambda c, f: F.aggregate(F.zip_with(f"a_{c}", c, f), F.lit(0.0), lambda t, x: t + x) / n
    unlike = lambda c, part, f=lambda x, y: F.abs(x - y): F.exp(-mean(c, f) / scales[part])
    ratio = lambda x, y: F.abs(F.ln(F.greatest(x, F.lit(1e-9)) / F.greatest(y, F.lit(1e-9))))
    same = mean("types", lambda x, y: (x == y).cast("double"))
    score = parts["type"] * same + parts["swing"] * unlike("swing", "swing") + parts["leg"] * unlike("leg", "leg") + parts["duration"] * unlike("bars", "duration", ratio) + parts["shape"] * unlike("shape", "shape")
    scored = pairs.select(
        *SERIES, "target", F.col("end_position").alias("candidate_end_position"), F.col("start_index").alias("candidate_start_index"), F.col("end_index").alias("candidate_end_index"),
        F.col("confirmation").alias("candidate_confirmation_index"), F.array_join("types", " ").alias("pivot_type_sequence"), score.alias("similarity"),
    )
    rank = Window.partitionBy(*SERIES, "target").orderBy(F.desc(F.round("similarity", 9)), "candidate_end_index")
    return scored.where(F.col("similarity") >= least).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top_k)


def signatures(pivots: DataFrame, n: int = 8) -> DataFrame:
    """The last n pivots of each series as JSON, oldest first."""
    last = Window.partitionBy(*SERIES).orderBy(F.desc("position"))
    kept = pivots.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n)
    rows = F.array_sort(F.collect_list(F.struct("position", "index", "pivot_type", "price")))
    return kept.groupBy(*SERIES).agg(F.to_json(rows).alias("signature"))
