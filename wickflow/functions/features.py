"""Columns of each candle, from windows over its series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import SERIES, by_time

EPS = 2.220446049250313e-16
#: The features of a candle and their weights in window similarity.
WEIGHTS = {
    "body_pct": 0.18, "upper_wick_pct": 0.12, "lower_wick_pct": 0.12, "range_ratio": 0.16, "close_location": 0.12,
    "direction": 0.10, "body_change": 0.08, "range_change": 0.08, "alternation": 0.04,
}
#: The features of a pattern vector.
PATTERN = ["return", "body_range_ratio", "upper_wick_ratio", "lower_wick_ratio", "close_position", "range_vs_mean", "volume_z", "atr_pct", "momentum_10", "roc_20"]


#: No feature of a candle depends on more candles before it: rolling medians of rolling ranges, and a step of these.
REACH = 64


def trailing(n: int) -> Window:
    return by_time().rowsBetween(1 - n, 0)


def rolled(function, column: Column | str, n: int, least: int) -> Column:
    """function over the last n rows, null until least of them have a value."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.count(column).over(trailing(n)) >= least, function(column).over(trailing(n)))


def median(column: Column) -> Column:
    return F.percentile(column, F.lit(0.5))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def change(x: str, k: int) -> Column:
    before = F.lag(x, k).over(by_time())
    return F.try_divide(F.col(x), before) - 1


def add_features(candles: DataFrame) -> DataFrame:
    """candles with returns, anatomy, volatility and momentum columns; what is undefined is null."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    before = F.lag("close").over(by_time())
    out = candles.withColumns({
        "return": change("close", 1), "log_return": F.ln(F.try_divide(c, before)), "body": c - o, "body_abs": F.abs(c - o),
        "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - lo, "range": h - lo,
        "true_range": F.greatest(h - lo, F.abs(h - before), F.abs(lo - before)),
        "volume_change": change("volume", 1), "momentum_10": change("close", 10), "roc_20": change("close", 20),
    })
    r = F.col("range") + EPS
    out = out.withColumns({
        "body_range_ratio": F.col("body_abs") / r, "upper_wick_ratio": F.col("upper_wick") / r, "lower_wick_ratio": F.col("lower_wick") / r, "close_position": (c - lo) / r,
        "range_vs_mean": F.col("range") / (rolled(F.avg, "range", 20, 5) + EPS), "volume_z": F.when(rolled(F.stddev_samp, "volume", 20, 5) < 1e-9, 0.0).otherwise((v - rolled(F.avg, "volume", 20, 5)) / (rolled(F.stddev_samp, "volume", 20, 5) + EPS)),
        "atr_14": rolled(F.avg, "true_range", 14, 5), "volatility_20": rolled(F.stddev_samp, "log_return", 20, 5), "slope_20": rolled(F.avg, "log_return", 20, 5),
        "acceleration": F.col("return") - F.lag("return").over(by_time()),
    })
    return out.withColumn("atr_pct", F.col("atr_14") / (F.abs(c) + EPS))


def pattern_vectors(featured: DataFrame, lookback: int) -> DataFrame:
    """For each series' last lookback candles the standardised features, row after row, in one array."""
    back = Window.partitionBy(*SERIES).orderBy(F.desc("open_time"))
    part = featured.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= lookback)
    filled = by_time().rowsBetween(Window.unboundedPreceding, 0)
    part = part.select(*SERIES, "open_time", *(F.coalesce(F.last(x, ignorenulls=True).over(filled), F.lit(0.0)).alias(x) for x in PATTERN))
    whole = Window.partitionBy(*SERIES)
    part = part.withColumns({x: (F.col(x) - F.avg(x).over(whole)) / (F.stddev_pop(x).over(whole) + 1e-9) for x in PATTERN})
    rows = F.array_sort(F.collect_list(F.struct("open_time", F.array(*PATTERN).alias("v"))))
    return part.groupBy(*SERIES).agg(F.flatten(F.transform(rows, lambda x: x["v"])).alias("vector"))


def candle_features(candles: DataFrame, window: int = 20) -> DataFrame:
    """candles with the nine features of WEIGHTS; range_ratio is scaled to 0..1."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    out = candles.withColumn("_rng", F.greatest(h - lo, F.lit(1e-12)))
    rng = F.col("_rng")
    out = out.withColumns({
        "body_pct": clip(F.abs(c - o) / rng, 0.0, 1.0), "upper_wick_pct": clip((h - F.greatest(o, c)) / rng, 0.0, 1.0), "lower_wick_pct": clip((F.least(o, c) - lo) / rng, 0.0, 1.0),
        "range_ratio": clip(rng / F.greatest(median(rng).over(trailing(window)), F.lit(1e-12)), 0.0, 5.0) / 5, "close_location": clip((c - lo) / rng, 0.0, 1.0),
        "direction": F.signum(c - o),
    })
    step = lambda x: clip(F.coalesce(F.col(x) - F.lag(x).over(by_time()), F.lit(0.0)), -1.0, 1.0)
    turned = F.col("direction") * F.lag("direction").over(by_time()) < 0
    return out.withColumns({"body_change": step("body_pct"), "range_change": step("range_ratio"), "alternation": F.when(turned, 1.0).otherwise(0.0)}).drop("_rng")


def raw_anatomy(featured: DataFrame) -> DataFrame:
    """featured (with candle_features) with range, body and close in units of price, and marks of each candle as 0 or 1."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng, d = F.greatest(h - lo, F.lit(1e-12)), F.col("direction")
    up, low = F.col("upper_wick_pct"), F.col("lower_wick_pct")
    mark = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return featured.withColumns({
        "raw_range": rng, "raw_body": F.abs(c - o), "raw_close": (c - lo) / rng, "changed": mark(d != F.lag(d).over(by_time())), "small_body": mark(F.col("body_pct") <= 0.25), "large_body": mark(F.col("body_pct") >= 0.60),
        "upper_rejection": mark((up >= 0.35) & (low < 0.25)), "lower_rejection": mark((low >= 0.35) & (up < 0.25)),
    })


def heat_scaled(behaved: DataFrame) -> DataFrame:
    """behaved (with behaviour) with its anatomy in percent, as for a heat map: range up to three medians, efficiency up to 1, nothing null."""
    pct = {"body_pct": F.col("body_pct"), "upper_wick_pct": F.col("upper_wick_pct"), "lower_wick_pct": F.col("lower_wick_pct"), "range_vs_median": clip(F.col("range_vs_median"), 0.0, 3.0) / 3.0 * 100.0, "efficiency": clip(F.col("efficiency"), 0.0, 1.0) * 100.0}
    null = {k: F.col(k).isNull() for k in pct}
    return behaved.withColumns({k: F.when(null[k], 0.0).otherwise(v) for k, v in pct.items()})


def behaviour(candles: DataFrame, window: int = 12) -> DataFrame:
    """candles with anatomy in percent, efficiency, compression, their change from the candle before, and a state."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = F.nullif(h - lo, F.lit(0.0))
    moves = F.abs(c - F.lag("close").over(by_time()))
    out = candles.withColumns({
        "body_pct": F.abs(c - o) / rng * 100, "signed_body": (c - o) / rng, "upper_wick_pct": (h - F.greatest(o, c)) / rng * 100, "lower_wick_pct": (F.least(o, c) - lo) / rng * 100,
        "range_pct": (h - lo) / F.nullif(c, F.lit(0.0)) * 100, "candle_direction": F.when(c >= o, "UP").otherwise("DOWN"), "_move": moves,
        "rolling_range_pct": F.when(F.count("*").over(trailing(window)) >= window // 2, (F.max("high").over(trailing(window)) - F.min("low").over(trailing(window))) / F.nullif(c, F.lit(0.0)) * 100),
    })
    least = max(3, window // 2)
    out = out.withColumns({
        "range_vs_median": F.try_divide(F.col("range_pct"), rolled(median, "range_pct", 20, 5)),
        "efficiency": F.try_divide(F.abs(c - F.lag("close", window).over(by_time())), rolled(F.sum, "_move", window, least)),
        "compression_ratio": F.try_divide(F.col("rolling_range_pct"), rolled(median, "rolling_range_pct", 2 * window, max(6, window))),
    })
    step = lambda x: F.coalesce(F.abs(F.col(x) - F.lag(x).over(by_time())), F.lit(0.0))
    wide = F.coalesce(F.col("range_vs_median") > 1.5, F.lit(False))
    state = (
        F.when((F.greatest("upper_wick_pct", "lower_wick_pct") > 50) & (F.col("body_pct") < 40) & (F.col("range_vs_median") > 1.15), "rejection")
        .when(wide & (F.col("efficiency") > 0.55), "directional").when(wide, "expansion")
        .when((F.col("compression_ratio") < 0.75) & (F.col("efficiency") < 0.35), "compression").otherwise("balanced")
    )
    return out.withColumns({"behaviour_state": state, "transition": step("range_vs_median") + step("efficiency") + step("compression_ratio")}).drop("_move")


def tags(featured: DataFrame) -> DataFrame:
    """featured (with candle_features) with its tags, joined by |."""
    b, rr, up, low, loc, d = F.col("body_pct"), F.col("range_ratio") * 5, F.col("upper_wick_pct"), F.col("lower_wick_pct"), F.col("close_location"), F.col("direction")
    return featured.withColumn("tags", F.concat_ws(
        "|", F.when(d > 0, "BULLISH").when(d < 0, "BEARISH").otherwise("DOJI"), F.when(b < 0.25, "SMALL_BODY").when(b >= 0.6, "LARGE_BODY").otherwise("MEDIUM_BODY"),
        F.when(rr < 0.75, "COMPRESSION").when(rr > 1.25, "EXPANSION").otherwise("NORMAL_RANGE"), F.when(up >= 0.35, "UPPER_REJECTION"), F.when(low >= 0.35, "LOWER_REJECTION"),
        F.when(loc >= 0.75, "CLOSE_HIGH"), F.when(loc <= 0.25, "CLOSE_LOW"), F.when((d > 0) & (b >= 0.6) & (loc >= 0.7), "STRONG_BULL"), F.when((d < 0) & (b >= 0.6) & (loc <= 0.3), "STRONG_BEAR"),
    ))


def behaviour_labels(featured: DataFrame) -> DataFrame:
    """featured (with candle_features) with a label that depends on the quartiles of its series' range_ratio."""
    q = featured.groupBy(*SERIES).agg(F.percentile("range_ratio", F.lit([0.25, 0.75])).alias("_q"))
    b, rr, up, low, d = F.col("body_pct"), F.col("range_ratio"), F.col("upper_wick_pct"), F.col("lower_wick_pct"), F.col("direction")
    wide = rr >= F.col("_q")[1]
    label = (
        F.when(rr <= F.col("_q")[0], "compression").when(wide & (low > 1.35 * up) & (low > 0.8 * b), "expansion_lower_rejection").when(wide & (up > 1.35 * low) & (up > 0.8 * b), "expansion_upper_rejection")
        .when(wide & (b >= 0.6) & (d != 0), "directional_expansion").when(wide, "expansion").when((low > 1.5 * up) & (low > b), "lower_rejection").when((up > 1.5 * low) & (up > b), "upper_rejection")
        .when(b < 0.3, "small_body").when(d > 0, "bullish_body").when(d < 0, "bearish_body").otherwise("neutral_body")
    )
    return featured.join(q, SERIES).withColumn("label", label).drop("_q")
