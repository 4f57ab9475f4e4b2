"""Windows of n candles, their similarity, and descriptions of them.

A window is a frame of rows that ends at a candle of its series, so all windows are described in one sorted pass over blocks of a series:
one shuffle, whatever the number of measures. What pairs windows (with the current one of the series) is an
equi-join with one row for each series.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import WEIGHTS
from ..sources.candles import SERIES, block_of, haloed
from ..tables import scratch, written
from .quantiles import quantiles

FEATURES = list(WEIGHTS)
KEYS = [*SERIES, "end"]


def frame(n: int, a: int = 0, b: int | None = None) -> Window:
    """The places a to b (not included, the end if None) of the window of n candles that ends at a row of ended()."""
    return Window.partitionBy(*SERIES, "_block").orderBy("idx").rowsBetween(a - n + 1, (n if b is None else b) - n)


def mean(c: str | Column, n: int, a: int = 0, b: int | None = None) -> Column:
    return F.avg(c).over(frame(n, a, b))


def ended(candles: DataFrame, n: int, columns: dict[str, Column], least: int | None = None) -> DataFrame:
    """A row for each full window of indexed candles (of least candles at the series' start): series, end (its last idx), last (the series' last idx) and columns over its frame.

    A series is dealt to tasks by blocks of candles, each with the n - 1 before it.
    """
    last = candles.groupBy(*SERIES).agg(F.max("idx").alias("last"))
    last = last.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), block_of(F.col("last")))))  # joined by block, as the frames are dealt
    rows = haloed(candles, n - 1).select(*SERIES, "_block", F.col("idx").alias("end"), "_home", *(c.alias(k) for k, c in columns.items()))
    return rows.where(F.col("_home") & (F.col("end") >= (least or n) - 1)).join(last, [*SERIES, "_block"]).select(*SERIES, "end", "last", *columns)


def seen_from(candles: DataFrame, keys: DataFrame, before: int) -> DataFrame:
    """The candles of few ends (series, end): each end's own and so many before it."""
    places = keys.select(*SERIES, F.explode(F.sequence(F.greatest(F.col("end") - before, F.lit(0)), "end")).alias("idx")).distinct()
    return candles.join(places, [*SERIES, "idx"], "left_semi")


def last_candles(candles: DataFrame, n: int) -> DataFrame:
    """The candles of each series' last full window: end is the window's last idx, off counts from 0."""
    last = F.max("idx").over(Window.partitionBy(*SERIES))
    out = candles.withColumn("end", last).where((F.col("end") >= n - 1) & (F.col("idx") > F.col("end") - n))
    return out.withColumn("off", F.col("idx") - F.col("end") + n - 1)


# ------------------------------------------------------------------ arrays


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x computed once."""
    return F.transform(F.array(x), then)[0]


def array_median(v: Column) -> Column:
    middle = lambda s, k: F.get(s, F.floor((F.size(s) - k) / 2).cast("int"))
    return let(F.array_sort(v), lambda s: (middle(s, 1) + middle(s, 0)) / 2)


def array_mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda t, x: t + x) / F.size(v)


def scaled(v: Column) -> Column:
    """v less its median, by 1.4826 times the median absolute deviation (1 where that vanishes)."""
    by = lambda d: let(array_median(F.transform(d, F.abs)) * 1.4826, lambda m: F.when(m < 1e-6, 1.0).otherwise(m))
    centred = let(array_median(v), lambda m: F.transform(v, lambda x: x - m))
    return let(centred, lambda d: let(by(d), lambda m: F.transform(d, lambda x: x / m)))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x) / F.size(a))


def standardized(featured: DataFrame, n: int, columns: list[str] = FEATURES) -> DataFrame:
    """A row for each window with each of columns as an array, scaled within the window."""
    rows = ended(featured, n, {c: F.collect_list(c).over(frame(n)) for c in columns})
    return rows.withColumns({c: scaled(F.col(c)) for c in columns})


def differences(featured: DataFrame, n: int) -> DataFrame:
    """RMSE by feature of each earlier window, that doesn't overlap the last one, against the last window of its series."""
    z = standardized(featured, n)
    now = z.where("end = last").select(*SERIES, *(F.col(c).alias(f"_c_{c}") for c in FEATURES))
    both = z.where(F.col("end") < F.col("last") - n + 1).join(now, SERIES)
    return both.select(*KEYS, *(rmse(F.col(c), F.col(f"_c_{c}")).alias(c) for c in FEATURES))


def similarities(featured: DataFrame, n: int = 20) -> DataFrame:
    total = sum(WEIGHTS.values())
    distance = sum((F.col(c) * (w / total) for c, w in WEIGHTS.items()), F.lit(0.0))
    return differences(featured, n).withColumn("similarity", F.exp(-distance))


def likeness(a: str = "{}", b: str = "_c_{}") -> Column:
    """The similarity of two windows' scaled features, in columns named by their patterns; null if the windows differ in length."""
    total = sum(WEIGHTS.values())
    of = lambda c: (F.col(a.format(c)), F.col(b.format(c)))
    distance = sum((rmse(*of(c)) * (w / total) for c, w in WEIGHTS.items()), F.lit(0.0))
    return F.when(F.size(of(FEATURES[0])[0]) == F.size(of(FEATURES[0])[1]), F.exp(-distance))


def centred(featured: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """For each centre (series, centre) the window of radius candles on either side, fewer at the series' ends, with each feature as a scaled array; first and candles."""
    at = centres.select(*SERIES, "centre").distinct().withColumn("idx", F.explode(F.sequence(F.col("centre") - radius, F.col("centre") + radius)))
    rows = at.join(featured.select(*SERIES, F.col("idx").cast(at.schema["idx"].dataType).alias("idx"), *FEATURES), [*SERIES, "idx"])
    out = rows.groupBy(*SERIES, "centre").agg(F.array_sort(F.collect_list(F.struct("idx", *FEATURES))).alias("_w"))
    return out.select(*SERIES, "centre", F.col("_w")[0]["idx"].alias("first"), F.size("_w").alias("candles"), *(scaled(F.col("_w")[c]).alias(c) for c in FEATURES))


def compared_to_centre(featured: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """Windows that end between radius and 2 radius before each series' centre (one each), and before the window around it, with their similarity to that: end, start."""
    n = 2 * radius + 1
    now = centred(featured, centres, radius).select(*SERIES, "centre", F.col("first").alias("_first"), F.col("candles").alias("_n"), *(F.col(c).alias(f"_c_{c}") for c in FEATURES))
    rows = ended(featured, n, {c: F.collect_list(c).over(frame(n)) for c in FEATURES}, least=1).join(now, SERIES)
    start = F.col("end") - F.col("_n") + 1
    rows = rows.where((F.col("end") >= radius) & (F.col("end") <= F.greatest(F.lit(radius), F.col("centre") - 2 * radius)) & (start >= 0) & (F.col("end") < F.col("_first")))
    rows = rows.withColumns({c: scaled(F.slice(c, F.size(c) - F.col("_n") + 1, F.col("_n"))) for c in FEATURES})
    return rows.select(*KEYS, start.alias("start"), likeness().alias("similarity"))


def top(scored: DataFrame, k: int, by: list[str] = SERIES, score: str = "similarity", tie: str = "end") -> DataFrame:
    """The k rows of greatest score in each group, equal scores (to nine places) by the tie column."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(featured: DataFrame, n: int = 20, k: int = 10) -> DataFrame:
    found = top(similarities(featured, n), k)
    return found.select(*SERIES, "rank", (F.col("end") - n + 1).alias("candidate_start"), F.col("end").alias("candidate_end"), "similarity")


def contributions(featured: DataFrame, n: int = 20) -> DataFrame:
    """Of the best match of each series: each feature's RMSE, weight and product."""
    total, best = sum(WEIGHTS.values()), top(similarities(featured, n), 1)
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("rmse"), F.lit(w / total).alias("weight"), (F.col(c) * (w / total)).alias("weighted_difference")) for c, w in WEIGHTS.items()))
    return best.select(*SERIES, F.col("end").alias("candidate_end"), F.inline(rows))


def distribution(featured: DataFrame, n: int = 20) -> DataFrame:
    """Number, best and quantiles of each series' similarities, and the share of them that are no greater than the best."""
    q = F.percentile("similarity", F.lit([0.5, 0.9, 0.95, 0.99]))
    best = F.max("similarity")
    out = similarities(featured, n).groupBy(*SERIES).agg(F.count("*").alias("windows"), best.alias("best"), (F.count_if(F.col("similarity").isNotNull()) * 100.0 / F.count("*")).alias("percentile_of_best"), q.alias("_q"))
    return out.select(*SERIES, "windows", "best", "percentile_of_best", *(F.col("_q")[i].alias(x) for i, x in enumerate(["median", "p90", "p95", "p99"])))


def histogram(scored: DataFrame, column: str = "similarity", bins: int = 60, by: list[str] = SERIES) -> DataFrame:
    """Counts and density in bins of equal width from each group's least to its greatest value, which the last bin includes."""
    ends = scored.groupBy(*by).agg(F.min(column).alias("_low"), F.max(column).alias("_high"), F.count("*").alias("_all"))
    width = (F.col("_high") - F.col("_low")) / bins
    out = scored.join(ends, by).withColumns({"bin": F.least(F.floor(F.try_divide(F.col(column) - F.col("_low"), width)), F.lit(bins - 1)), "_width": width})
    return out.where("_width > 0").groupBy(*by, "bin").agg(F.count("*").alias("windows"), F.min(F.col("_low") + F.col("bin") * F.col("_width")).alias("low"), (F.count("*") / F.first("_all") / F.first("_width")).alias("density"))


# ------------------------------------------------------------------ vectors of means


def measures(n: int, totals: tuple = (), halves: tuple = (), shifts: tuple = ()) -> dict[str, Column]:
    """Means of whole windows, of their halves, and the second half's less the first's."""
    first, second = (lambda c: mean(c, n, 0, n // 2)), (lambda c: mean(c, n, n // 2))
    out = {c: mean(c, n) for c in totals}
    for c in halves:
        out |= {f"{c}_first": first(c), f"{c}_second": second(c)}
    return out | {f"{c}_shift": second(c) - first(c) for c in shifts}


BASIC = ("direction", "body_pct", "range_ratio", "upper_wick_pct", "lower_wick_pct", "close_location", "alternation")
#: The measures of a regime, of a window among timeframes, and of the coarse screen of stories.
REGIME = {"totals": BASIC, "halves": ("direction", "body_pct", "range_ratio", "close_location", "alternation"), "shifts": ("range_ratio", "body_pct", "direction", "close_location", "upper_wick_pct", "lower_wick_pct")}
HISTORY = {"totals": BASIC, "halves": ("direction", "range_ratio", "body_pct", "close_location", "alternation"), "shifts": ("range_ratio", "direction")}
RAW = ("direction", "raw_range", "raw_body", "raw_close")
SCREEN = {"halves": (*RAW, "changed", "small_body", "large_body", "upper_rejection", "lower_rejection"), "shifts": RAW}


def vectors(candles: DataFrame, n: int, of: dict[str, tuple], more: dict[str, Column] | None = None) -> tuple[DataFrame, list[str]]:
    """A row for each window with the measures of (totals, halves, shifts), and their names."""
    columns = measures(n, **of)
    return ended(candles, n, columns | (more or {})), list(columns)


def fingerprint_measures(n: int) -> dict[str, Column]:
    """70 means: of the window, of its four quarters and of its five fifths."""
    d, b, r, c = (F.col(x) for x in ("direction", "body_pct", "range_ratio", "close_location"))
    out = {x: mean(x, n) for x in ("direction", "alternation", "body_pct", "range_ratio", "upper_wick_pct", "lower_wick_pct", "close_location")}
    shares = {"small": b <= 0.25, "large": b >= 0.60, "tight": r <= 0.85, "wide": r >= 1.15, "high": c >= 0.65, "low": c <= 0.35, "bull": d > 0, "bear": d < 0}
    out |= {k: mean(v.cast("double"), n) for k, v in shares.items()}
    for parts, names in ((4, ("direction", "body_pct", "range_ratio", "close_location", "alternation")), (5, BASIC)):
        if n % parts:
            raise ValueError(f"windows must be divisible by {parts}")
        size = n // parts
        out |= {f"{x}_{parts}_{i}": mean(x, n, i * size, (i + 1) * size) for i in range(parts) for x in names}
    return out


def spreads(rows: DataFrame, columns: list[str], by: list[str] = SERIES) -> DataFrame:
    """Of each group the median of each column (_m_) and 1.4826 times its median absolute deviation (_s_; 1 where that vanishes)."""
    with scratch(rows.sparkSession) as keep:
        if not hasattr(rows, "_scratch_path"):  # else it is a table
            rows = written(rows.select(*by, *columns), "columns")
        middle = quantiles(rows, by, columns, [0.5]).select(*by, *(F.col(c)[0].alias(f"_m_{c}") for c in columns))
        away = rows.join(middle, by).select(*by, *(F.abs(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns))
        mad = quantiles(away, by, columns, [0.5]).select(*by, *((F.col(c)[0] * 1.4826).alias(f"_s_{c}") for c in columns))
        out = middle.join(mad, by).withColumns({f"_s_{c}": F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns})
        return keep(written(out, "spreads"))


def by_medians(rows: DataFrame, now: DataFrame, columns: list[str], by: list[str] = SERIES, factor: float = 1.0) -> DataFrame:
    """rows with similarity exp(-factor * root mean square difference) to their group's row of now, each column by its spread over rows."""
    own = now.select(*by, *(F.col(c).alias(f"_c_{c}") for c in columns)).join(spreads(rows, columns, by), by)
    far = F.sqrt(sum((F.pow((F.col(c) - F.col(f"_c_{c}")) / F.col(f"_s_{c}"), 2) for c in columns), F.lit(0.0)) / len(columns))
    return rows.join(own, by).withColumn("similarity", F.exp(-far * factor)).drop(*(f"_{k}_{c}" for k in "cms" for c in columns))


def by_quartiles(rows: DataFrame, columns: list[str], is_query: Column, by: list[str] = SERIES) -> DataFrame:
    """rows other than the group's query with similarity 1 / (1 + root mean square difference), each column by its group's quartile range."""
    q = quantiles(rows, by, columns, [0.25, 0.75]).select(*by, *(F.col(c).alias(f"_q_{c}") for c in columns))
    now = rows.where(is_query).select(*by, *(F.col(c).alias(f"_c_{c}") for c in columns))
    both = rows.where(~is_query).join(q.join(now, by), by)
    scale = lambda c: F.greatest(F.col(f"_q_{c}")[1] - F.col(f"_q_{c}")[0], F.lit(1e-9))
    far = F.sqrt(sum((F.pow((F.col(c) - F.col(f"_c_{c}")) / scale(c), 2) for c in columns), F.lit(0.0)) / len(columns))
    return both.withColumn("similarity", 1 / (1 + far)).drop(*(f"_{k}_{c}" for k in "qc" for c in columns))


# ------------------------------------------------------------------ descriptions


def described(featured: DataFrame, n: int = 20) -> DataFrame:
    """A row for each window: shares and means of the window, its halves and thirds; ranges are scaled back by 5.

    Alternation is of the pairs of neighbours inside the window or third, but that of halves is of all their candles.
    """
    half, third = max(1, n // 2), max(1, n // 3)
    rr, bull, bear = F.col("range_ratio") * 5, F.col("direction") > 0, F.col("direction") < 0
    up, low = F.col("upper_wick_pct") >= 0.35, F.col("lower_wick_pct") >= 0.35
    share = lambda c: mean(c.cast("double"), n)
    both = lambda name, c: {f"{name}_first": mean(c, n, 0, half), f"{name}_second": mean(c, n, n - half)}
    pairs = lambda a, b: F.coalesce(mean("alternation", n, a, b), F.lit(0.0))
    return ended(featured, n, {
        "bullish": share(bull), "bearish": share(bear), "body": mean("body_pct", n), "range_level": mean(rr, n), "close_location": mean("close_location", n),
        "alternation": pairs(1, n), "compression_75": share(rr < 0.75), "expansion_125": share(rr > 1.25), "compression": share(rr < 0.85),
        "expansion": share(rr > 1.15), "upper_rejection": share(up), "lower_rejection": share(low), "either_rejection": share(up | low), "small_body": share(F.col("body_pct") <= 0.25),
        "large_body": share(F.col("body_pct") >= 0.6), **both("bull", bull.cast("double")), **both("range", rr), **both("direction", F.col("direction")), **both("scaled_range", F.col("range_ratio")),
        **both("alternation", F.col("alternation")), **both("body", F.col("body_pct")), **both("close", F.col("close_location")), "range_first_third": mean(rr, n, 0, third), "range_middle_third": mean(rr, n, third, 2 * third),
        "range_last_third": mean(rr, n, n - third), "alternation_first_third": pairs(1, third), "alternation_last_third": pairs(n - third + 1, n),
    })


def profile() -> Column:
    """How the window's second half differs from its first."""
    a, b = F.col("bull_first"), F.col("bull_second")
    shift, near = F.col("range_second") - F.col("range_first"), lambda x: F.abs(x - 0.5) <= 0.20
    return (
        F.when((a <= 0.35) & (b >= 0.65), "BEARISH_TO_BULLISH_SHIFT").when((a >= 0.65) & (b <= 0.35), "BULLISH_TO_BEARISH_SHIFT").when(near(a) & near(b) & (F.col("compression_75") >= 0.30), "SIDEWAYS_LIKE")
        .when(near(a) & (F.greatest(b, 1 - b) >= 0.65) & (shift >= 0.15), "SIDEWAYS_TO_DIRECTIONAL_LIKE").when(shift >= 0.20, "RANGE_EXPANSION_LIKE").when(shift <= -0.20, "RANGE_COMPRESSION_LIKE").otherwise("MIXED_SEQUENCE")
    )


def micro_behaviour() -> Column:
    c, e, b, m, a = (F.col(x) for x in ("compression", "expansion", "bullish", "body", "alternation"))
    r, s, rs = F.greatest("upper_rejection", "lower_rejection"), F.col("bull_second") - F.col("bull_first"), F.col("range_second") - F.col("range_first")
    even = F.abs(b - 0.5)
    return (
        F.when((c >= 0.55) & (even <= 0.15) & (r >= 0.35), "WICK_REJECTION_COMPRESSION").when((c >= 0.55) & (even <= 0.15), "BALANCED_COMPRESSION").when((c >= 0.45) & (F.abs(s) >= 0.25), "DIRECTIONAL_COMPRESSION")
        .when((e >= 0.35) & (rs >= 0.10), "RANGE_EXPANSION").when((r >= 0.45) & (even <= 0.25), "REJECTION_BALANCE").when((s >= 0.25) & (rs >= 0), "BULLISH_SHIFT").when((s <= -0.25) & (rs >= 0), "BEARISH_SHIFT")
        .when((b >= 0.70) & (a <= 0.35) & (m >= 0.60), "PERSISTENT_BULLISH_BODY").when((b <= 0.30) & (a <= 0.35) & (m >= 0.60), "PERSISTENT_BEARISH_BODY").when(a >= 0.55, "HIGH_ALTERNATION").when(m <= 0.25, "SMALL_BODY_MIX")
        .otherwise("MIXED_MICRO_BEHAVIOUR")
    )


def archetype() -> Column:
    c, e, b, r, a = (F.col(x) for x in ("compression", "expansion", "bullish", "either_rejection", "alternation"))
    s, rs, even = F.col("bull_second") - F.col("bull_first"), F.col("range_second") - F.col("range_first"), F.abs(F.col("bullish") - 0.5)
    return (
        F.when((s >= 0.30) & (rs >= 0.10), "BEARISH_TO_BULLISH_SHIFT").when((s <= -0.30) & (rs >= 0.10), "BULLISH_TO_BEARISH_SHIFT").when((c >= 0.55) & (even <= 0.15), "SIDEWAYS_COMPRESSION")
        .when((even <= 0.20) & (F.greatest(b, 1 - b) >= 0.65) & (rs >= 0.10), "SIDEWAYS_TO_DIRECTIONAL").when((e >= 0.35) & (rs >= 0.10), "EXPANSION_SEQUENCE").when((c >= 0.55) & (rs <= -0.10), "COMPRESSION_SEQUENCE")
        .when((r >= 0.45) & (even <= 0.25), "REJECTION_MIX").when((b >= 0.70) & (a <= 0.35), "PERSISTENT_BULLISH_BODY").when((b <= 0.30) & (a <= 0.35), "PERSISTENT_BEARISH_BODY").when(a >= 0.55, "HIGH_ALTERNATION")
        .otherwise("MIXED_BEHAVIOUR")
    )


def pattern_code() -> Column:
    """The eight parts of a window's fingerprint, joined."""
    b, d = F.col("bullish"), lambda a, c: F.col(a) - F.col(c)
    three = lambda x, cut, high, low, mid: F.when(x >= cut, high).when(x <= -cut, low).otherwise(mid)
    rs, wick, ds, tr = d("range_second", "range_first"), d("lower_rejection", "upper_rejection"), d("bull_second", "bull_first"), d("range_last_third", "range_first_third")
    a, cl = F.col("alternation"), F.col("close_location")
    return F.concat_ws(
        " | ", F.when(1 - 2 * F.abs(b - 0.5) >= 0.70, "BALANCED").when(b > 0.5, "BULL_BIASED").otherwise("BEAR_BIASED"), three(rs, 0.20, "EXPANDING", "COMPRESSING", "STABLE"), three(wick, 0.12, "LOWER_WICK", "UPPER_WICK", "WICK_BALANCED"),
        three(ds, 0.20, "BULL_SHIFT", "BEAR_SHIFT", "DIRECTION_BALANCED"), F.when(a >= 0.55, "HIGH_ALT").when(a <= 0.30, "LOW_ALT").otherwise("MID_ALT"), F.when(F.col("body") >= 0.60, "LARGE_BODY").when(F.col("body") <= 0.25, "SMALL_BODY").otherwise("MID_BODY"),
        three(tr, 0.35, "COMP_TO_EXPAND", "EXP_TO_COMPRESS", "RANGE_STABLE"), F.when(cl >= 0.65, "CLOSE_HIGH").when(cl <= 0.35, "CLOSE_LOW").otherwise("CLOSE_MID"),
    )


def regime() -> Column:
    """How direction, range (scaled to 0..1) and alternation move between the halves."""
    d1, d2, r1, r2, a1, a2 = (F.col(x) for x in ("direction_first", "direction_second", "scaled_range_first", "scaled_range_second", "alternation_first", "alternation_second"))
    ds, rs, u1, u2 = d2 - d1, r2 - r1, F.abs(d1), F.abs(d2)
    return (
        F.when((u1 >= 0.20) & (u2 >= 0.15) & (d1 * d2 < 0) & (ds * d1 < 0), "TREND_TO_OPPOSITE_DIRECTION").when((u1 <= 0.15) & (u2 >= 0.20) & (rs >= 0.15), "SIDEWAYS_TO_DIRECTIONAL_EXPANSION")
        .when((u1 >= 0.20) & (u2 <= 0.15) & (rs < 0.10), "DIRECTIONAL_TO_SIDEWAYS").when((rs >= 0.25) & (u2 >= u1 + 0.10), "COMPRESSION_TO_EXPANSION").when((rs <= -0.25) & (u2 <= u1 + 0.05), "EXPANSION_TO_COMPRESSION")
        .when((u1 <= 0.15) & (u2 <= 0.15) & (a2 >= a1 + 0.10), "SIDEWAYS_ALTERNATION_INCREASE").when((F.abs(d1 - d2) < 0.15) & (F.abs(rs) < 0.15), "STABLE_REGIME").otherwise("MIXED_TRANSITION")
    )


def transition_type() -> Column:
    """The label by which timeframes are compared."""
    d1, d2 = F.col("direction_first"), F.col("direction_second")
    rs, u1, u2 = F.col("scaled_range_second") - F.col("scaled_range_first"), F.abs("direction_first"), F.abs("direction_second")
    return (
        F.when((u1 >= 0.20) & (u2 >= 0.15) & (d1 * d2 < 0), "OPPOSITE_DIRECTION_SHIFT").when((u1 <= 0.15) & (u2 >= 0.20) & (rs >= 0.15), "SIDEWAYS_TO_DIRECTIONAL").when((u1 >= 0.20) & (u2 <= 0.15), "DIRECTIONAL_TO_SIDEWAYS")
        .when(rs >= 0.25, "COMPRESSION_TO_EXPANSION").when(rs <= -0.25, "EXPANSION_TO_COMPRESSION").when((F.abs(d1 - d2) < 0.15) & (F.abs(rs) < 0.15), "STABLE").otherwise("MIXED")
    )


def blocks(featured: DataFrame, n: int = 20, count: int = 5) -> DataFrame:
    """The last window of each series in count blocks, sizes as even as can be: measures and a label of six parts."""
    w = last_candles(featured, n).withColumn("rr", F.col("range_ratio") * 5)
    w = w.withColumn("block", F.ntile(count).over(Window.partitionBy(*KEYS).orderBy("off")))
    w = w.withColumn("_first", F.row_number().over(Window.partitionBy(*KEYS, "block").orderBy("off")) == 1)  # has no neighbour before it in the block
    share = lambda c: F.avg(c.cast("double"))
    out = w.groupBy(*KEYS, "block").agg(
        F.count("*").alias("candles"), share(F.col("direction") > 0).alias("bullish"), F.avg("rr").alias("range_level"), share(F.col("upper_wick_pct") >= 0.35).alias("upper_rejection"),
        share(F.col("lower_wick_pct") >= 0.35).alias("lower_rejection"), F.coalesce(F.avg(F.when(~F.col("_first"), F.col("alternation"))), F.lit(0.0)).alias("alternation"), F.avg("body_pct").alias("body"), F.avg("close_location").alias("close_location"),
    )
    b, r, a, m, c, wick = F.col("bullish"), F.col("range_level"), F.col("alternation"), F.col("body"), F.col("close_location"), F.col("lower_rejection") - F.col("upper_rejection")
    label = F.concat_ws(
        "/", F.when(b >= 0.6, "BULL").when(b <= 0.4, "BEAR").otherwise("BAL"), F.when(r >= 1.15, "EXP").when(r <= 0.85, "COMP").otherwise("NORM"), F.when(wick >= 0.15, "LOWER_WICK").when(wick <= -0.15, "UPPER_WICK").otherwise("WICK_BAL"),
        F.when(a >= 0.55, "ALT_HI").when(a <= 0.3, "ALT_LO").otherwise("ALT_MID"), F.when(m >= 0.6, "BODY_LARGE").when(m <= 0.25, "BODY_SMALL").otherwise("BODY_MID"), F.when(c >= 0.65, "CLOSE_HIGH").when(c <= 0.35, "CLOSE_LOW").otherwise("CLOSE_MID"),
    )
    return out.withColumn("label", label)


def block_paths(blocked: DataFrame) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("block", "label")))
    path = lambda i: F.array_join(F.transform(rows, lambda x: F.split_part(x["label"], F.lit("/"), F.lit(i))), " -> ")
    names = ["direction_path", "range_path", "wick_path", "alternation_path", "body_path", "close_path"]
    return blocked.groupBy(*KEYS).agg(*(path(i).alias(x) for i, x in enumerate(names, 1)))


def around(candles: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """The candles within radius of each centre (series, centre), with offset and the close's way from the centre's in percent.

    A centre is laid into the 2 radius + 1 places around it, so the join is an equi-join.
    """
    at = centres.withColumn("offset", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("idx", F.col("centre") + F.col("offset"))
    base = candles.select(*SERIES, F.col("idx").alias("centre"), F.col("close").alias("_base"))
    return at.join(candles, [*SERIES, "idx"]).join(base, [*SERIES, "centre"]).withColumn("close_path_pct", (F.try_divide(F.col("close"), F.col("_base")) - 1) * 100).drop("_base")


def contexts(featured: DataFrame, spans: DataFrame, context: int = 10) -> DataFrame:
    """For each span (series, start, end) its own candles, and up to context before and after it, described: part, candles and measures.

    The sides are clipped at the series' ends. A side without candles has null measures and the labels NONE; one with a single candle has
    no alternation and the labels INSUFFICIENT_DATA. Each span is laid into the places of its parts, so the join is an equi-join.
    """
    last = featured.groupBy(*SERIES).agg(F.max("idx").alias("_last"))
    first, after = F.greatest(F.col("start") - context, F.lit(0)), F.least(F.col("end") + context, F.col("_last"))
    part = lambda name, a, b: F.struct(F.lit(name).alias("part"), a.cast("long").alias("_a"), b.cast("long").alias("_b"))
    keys = [*SERIES, "start", "end", "part"]
    parts = spans.select(*SERIES, "start", "end").distinct().join(last, SERIES).withColumn("_", F.explode(F.array(part("before", first, F.col("start") - 1), part("matched", F.col("start"), F.col("end")), part("after", F.col("end") + 1, after))))
    parts = parts.select(*SERIES, "start", "end", "_.*").withColumn("candles", F.greatest(F.col("_b") - F.col("_a") + 1, F.lit(0)))
    at = parts.where("candles > 0").withColumn("idx", F.explode(F.sequence("_a", "_b")))
    rows = at.join(featured.withColumn("idx", F.col("idx").cast("long")), [*SERIES, "idx"])
    half, place = F.greatest(F.floor(F.col("candles") / 2), F.lit(1)), F.col("idx") - F.col("_a")
    rr, up, low = F.col("range_ratio") * 5, F.col("upper_wick_pct") >= 0.35, F.col("lower_wick_pct") >= 0.35
    share, bull = (lambda c: F.avg(c.cast("double"))), (F.col("direction") > 0).cast("double")
    both = lambda name, c: [F.avg(F.when(place < half, c)).alias(f"{name}_first"), F.avg(F.when(place >= F.col("candles") - half, c)).alias(f"{name}_second")]
    found = rows.groupBy(*keys).agg(
        F.avg(bull).alias("bullish"), F.avg(rr).alias("range_level"), F.avg(F.when(place > 0, F.col("alternation"))).alias("alternation"), F.avg("body_pct").alias("body"), share(rr < 0.85).alias("compression"),
        share(rr > 1.15).alias("expansion"), share(up).alias("upper_rejection"), share(low).alias("lower_rejection"), share(up | low).alias("either_rejection"), *both("bull", bull), *both("range", rr),
    )
    out = parts.drop("_last", "_a", "_b").join(found, keys, "left")
    told = lambda label: F.when(F.col("candles") == 0, "NONE").when(F.col("candles") == 1, "INSUFFICIENT_DATA").otherwise(label)
    return out.withColumns({"archetype": told(archetype()), "micro_behaviour": told(micro_behaviour())})


def context_row(parts: DataFrame, columns: list[str]) -> DataFrame:
    """contexts() with a row for each span: columns of its parts as before_, matched_ and after_."""
    each = [F.max(F.when(F.col("part") == x, F.col(c))).alias(f"{x}_{c}") for c in columns for x in ("before", "matched", "after")]
    return parts.groupBy(*SERIES, "start", "end").agg(*each)


def tag_matrix(tagged: DataFrame, tags: list[str], n: int = 20) -> DataFrame:
    """One column for each tag: whether the candles of each series' last window have it."""
    w = last_candles(tagged, n)
    return w.select(*KEYS, "off", *(F.array_contains(F.split("tags", r"\|"), t).cast("int").alias(t.lower()) for t in tags))


#: The components of a window's fingerprint.
COMPONENTS = [
    "direction_balance", "alternation", "body_level", "body_shift", "small_body_fraction", "large_body_fraction", "upper_rejection", "lower_rejection", "rejection_balance", "wick_bias", "range_level", "range_shift",
    "compression_fraction", "expansion_fraction", "expansion_transition", "close_location", "close_shift", "direction_shift", "first_third_alternation", "last_third_alternation", "bullish_fraction", "bearish_fraction",
    "middle_third_range",
]


@F.pandas_udf(T.StringType())
def fingerprint_id(v: pd.Series) -> pd.Series:
    """Of components in order of their names: SHA-1 of the bytes of their values, rounded to two places."""
    return pd.Series(["FP-" + hashlib.sha1(np.round(np.asarray(x, "<f8"), 2).tobytes()).hexdigest()[:10].upper() for x in v])


def fingerprints(described_: DataFrame) -> DataFrame:
    """Described windows as fingerprints: components, pattern_code and fingerprint_id."""
    c = F.col
    shift = lambda name: c(f"{name}_second") - c(f"{name}_first")
    own = {
        "direction_balance": c("bullish") - c("bearish"), "alternation": c("alternation"), "body_level": c("body"), "body_shift": shift("body"), "small_body_fraction": c("small_body"), "large_body_fraction": c("large_body"),
        "upper_rejection": c("upper_rejection"), "lower_rejection": c("lower_rejection"), "rejection_balance": 1 - F.abs(c("upper_rejection") - c("lower_rejection")), "wick_bias": c("lower_rejection") - c("upper_rejection"),
        "range_level": c("range_level"), "range_shift": shift("range"), "compression_fraction": c("compression"), "expansion_fraction": c("expansion"), "expansion_transition": c("range_last_third") - c("range_first_third"),
        "close_location": c("close_location"), "close_shift": shift("close"), "direction_shift": shift("bull"), "first_third_alternation": c("alternation_first_third"), "last_third_alternation": c("alternation_last_third"),
        "bullish_fraction": c("bullish"), "bearish_fraction": c("bearish"), "middle_third_range": c("range_middle_third"),
    }
    out = described_.select(*KEYS, "last", pattern_code().alias("pattern_code"), *(own[x].alias(x) for x in COMPONENTS))
    return out.withColumn("fingerprint_id", fingerprint_id(F.array(*sorted(COMPONENTS))))
