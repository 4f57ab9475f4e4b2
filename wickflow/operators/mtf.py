"""Timeframes side by side: windows that close together, the last one closed before, and comparisons of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import STEPS
from . import windows as wd

HALVES = ["direction_first", "direction_second", "scaled_range_first", "scaled_range_second", "alternation_first", "alternation_second"]


def step_of(timeframe: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv)), timeframe)


def closes() -> Column:
    """The exclusive end of a candle."""
    return F.col("open_time") + step_of(F.col("timeframe"))


def current(described: DataFrame) -> DataFrame:
    """The last window of each series with its transition type."""
    return described.where("end = last").select("symbol", "timeframe", *HALVES, wd.transition_type().alias("transition_type"))


def pairs(now: DataFrame) -> DataFrame:
    """Every lower with every higher timeframe of a symbol (there are eight timeframes at most)."""
    order = step_of(F.col("timeframe"))
    side = lambda p: now.withColumn("_step", order).select("symbol", *(F.col(c).alias(f"{p}_{c}") for c in ["timeframe", "direction_second", "scaled_range_first", "scaled_range_second", "transition_type", "_step"]))
    out = side("low").join(side("high"), "symbol").where("low__step < high__step")
    return out.select(
        "symbol", "low_timeframe", "high_timeframe", (F.col("low_direction_second") - F.col("high_direction_second")).alias("direction_difference"),
        (F.col("low_scaled_range_second") - F.col("high_scaled_range_second")).alias("range_difference"), ((F.col("low_scaled_range_second") - F.col("low_scaled_range_first")) - (F.col("high_scaled_range_second") - F.col("high_scaled_range_first"))).alias("range_shift_difference"), "low_transition_type", "high_transition_type",
    )


def relationship(now: DataFrame) -> DataFrame:
    """How far apart a symbol's timeframes are in direction and range, and which transitions are among them."""
    spread = lambda c: F.max(c) - F.min(c)
    has = lambda *t: F.bool_or(F.col("transition_type").isin(*t))
    d, r = spread("direction_second"), spread("scaled_range_second")
    return now.groupBy("symbol").agg(
        F.concat_ws(
            " | ", F.when(d <= 0.20, "DIRECTION_ALIGNED").when(d >= 0.50, "DIRECTION_DIVERGENT").otherwise("DIRECTION_MIXED"), F.when(r <= 0.25, "RANGE_ALIGNED").when(r >= 0.75, "RANGE_DIVERGENT").otherwise("RANGE_MIXED"),
            F.when(has("SIDEWAYS_TO_DIRECTIONAL", "COMPRESSION_TO_EXPANSION"), "EXPANSION_CONTEXT_PRESENT").when(has("DIRECTIONAL_TO_SIDEWAYS", "EXPANSION_TO_COMPRESSION"), "COOLING_CONTEXT_PRESENT")
            .when(has("OPPOSITE_DIRECTION_SHIFT"), "DIRECTION_SHIFT_PRESENT").otherwise("NO_MAJOR_CROSS_TF_SHIFT"),
        ).alias("relationship")
    )


def exact(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Rows of all frames that close at the same time; each frame has distinct columns besides."""
    return reduce(lambda a, b: a.join(b, on), frames)


def asof(left: DataFrame, right: DataFrame, at: str, by: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row at or before it. Both go through one sorted pass, so nothing is paired off."""
    names = left.columns
    both = left.withColumns({f"_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values} | {"_side": F.lit(1)})
    r = right.select(by, at, *(F.col(v).alias(f"_{v}") for v in values), F.lit(0).alias("_side"))
    both = both.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct(*(F.col(f"_{v}").alias(v) for v in values))), ignorenulls=True).over(w)
    return both.withColumn("_seen", seen).where("_side = 1 AND _seen IS NOT NULL").select(*names, *(F.col(f"_seen.{v}").alias(f"asof_{v}") for v in values))


ALL = list(STEPS)
#: Timeframes whose windows must close together, and those that give context, by the timeframe of reference.
MODES = {"1d": (ALL, []), "1h": (ALL[:-1], ["1d"])}


def overlap(windows: DataFrame, timeframes: list[str] = ALL) -> DataFrame:
    """By symbol: the latest first and the earliest last close of windows (symbol, timeframe, close_ts) of the timeframes."""
    own = windows.where(F.col("timeframe").isin(timeframes)).groupBy("symbol", "timeframe").agg(F.min("close_ts").alias("first"), F.max("close_ts").alias("last"))
    return own.groupBy("symbol").agg(F.max("first").alias("common_start"), F.min("last").alias("common_end"), F.count("*").alias("timeframes"))


def references(windows: DataFrame, mode: str, step: int = 1) -> DataFrame:
    """(symbol, reference_timestamp): closes of the reference timeframe in the common overlap but its current one, each step-th."""
    exact_tfs, _ = MODES[mode]
    own = windows.where(F.col("timeframe") == mode)
    last = own.groupBy("symbol").agg(F.max("close_ts").alias("_last"))
    inside = own.select("symbol", "close_ts").join(overlap(windows, exact_tfs).where(F.col("timeframes") == len(exact_tfs)), "symbol").join(last, "symbol")
    inside = inside.where("close_ts BETWEEN common_start AND common_end AND close_ts <> _last")
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("close_ts")) - 1
    return inside.select("symbol", F.col("close_ts").alias("reference_timestamp"), n.alias("_n")).where(F.col("_n") % step == 0).drop("_n")


def synchronized(windows: DataFrame, mode: str, step: int = 1, with_context: bool = True) -> DataFrame:
    """Windows (symbol, timeframe, close_ts, similarity, end) at each reference time at which all exact timeframes have one that closes then.

    One aggregate by time finds the times: no chain of joins over timeframes. Context windows are the last ones closed by then.
    """
    exact_tfs, context = MODES[mode]
    at = windows.where(F.col("timeframe").isin(exact_tfs)).withColumnRenamed("close_ts", "reference_timestamp").join(references(windows, mode, step), ["symbol", "reference_timestamp"])
    whole = at.groupBy("symbol", "reference_timestamp").agg(F.count("*").alias("_n")).where(F.col("_n") == len(exact_tfs)).drop("_n")
    out = at.join(whole, ["symbol", "reference_timestamp"]).withColumn("synchronization", F.lit("EXACT"))
    for tf in context if with_context else []:
        own = windows.where(F.col("timeframe") == tf).select("symbol", F.col("close_ts").alias("reference_timestamp"), "end", "similarity")
        found = asof(whole, own, "reference_timestamp", "symbol", ["end", "similarity"])
        found = found.select("symbol", "reference_timestamp", F.lit(tf).alias("timeframe"), F.col("asof_end").alias("end"), F.col("asof_similarity").alias("similarity"), F.lit("ASOF_CONTEXT").alias("synchronization"))
        out = out.join(found.select("symbol", "reference_timestamp"), ["symbol", "reference_timestamp"], "left_semi").select(*found.columns).unionByName(found)
    return out


def history(windows: DataFrame, mode: str = "1d", step: int = 1, top_k: int = 25) -> DataFrame:
    """The reference times at which the exact timeframes' windows were most like the current ones, by the mean of their similarities."""
    exact_tfs, _ = MODES[mode]
    at = synchronized(windows, mode, step, with_context=False)
    out = at.groupBy("symbol", "reference_timestamp").pivot("timeframe", exact_tfs).agg(F.first("similarity"))
    named = {tf: f"similarity_{tf}" for tf in exact_tfs}
    out = out.select("symbol", "reference_timestamp", *(F.col(tf).alias(x) for tf, x in named.items()))
    out = out.withColumn("combined_similarity", sum((F.col(x) for x in named.values()), F.lit(0.0)) / len(named))
    return wd.top(out, top_k, ["symbol"], "combined_similarity", "reference_timestamp")
