"""What followed an endpoint: returns, excursions, which level came first; counts and intervals over many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import SERIES, in_blocks

#: Horizons in candles, target and stop in percent, and the normal quantile of 95 %.
HORIZONS, TARGET_PCT, STOP_PCT = (5, 10, 20, 50), 2.0, 1.0
Z95 = 1.959963984540054


def forward_outcomes(candles: DataFrame, horizon: int) -> DataFrame:
    """Indexed candles with return, most and least of the next horizon candles (fewer at the end), as fractions of the close."""
    w = Window.partitionBy(*SERIES).orderBy("idx").rowsBetween(1, horizon)
    p = F.col("close")
    measures = {
        "bars_available": F.count("*").over(w), "forward_return": F.try_divide(F.last("close").over(w), p) - 1,
        "mfe": F.try_divide(F.max("high").over(w), p) - 1, "mae": F.try_divide(F.min("low").over(w), p) - 1,
    }
    return in_blocks(candles, lambda c: c.withColumns(measures), 0, horizon)


def measure(endpoints: DataFrame, candles: DataFrame, horizons=HORIZONS, target_pct: float = TARGET_PCT, stop_pct: float = STOP_PCT) -> DataFrame:
    """endpoints (series, endpoint_index) with a row for each horizon; the entry is the close at the endpoint.

    One window pass over the candles measures every possible endpoint, so endpoints only look up their row: no range join.
    """
    if not horizons or min(horizons) <= 0 or target_pct <= 0 or stop_pct <= 0:
        raise ValueError("horizons, target and stop must be positive")
    w = lambda h: Window.partitionBy(*SERIES).orderBy("idx").rowsBetween(1, h)
    up, down, p = 1 + target_pct / 100, 1 - stop_pct / 100, F.col("close")
    bars = lambda h: F.collect_list(F.struct("high", "low")).over(w(h))
    looked = lambda c: c.select(*SERIES, F.col("idx").alias("endpoint_index"), "close", bars(max(horizons)).alias("_bars"), *(F.last("close").over(w(h)).alias(f"_last_{h}") for h in horizons))
    out = in_blocks(candles, looked, 0, max(horizons), at="endpoint_index")
    out = endpoints.join(out, [*SERIES, "endpoint_index"])

    def row(h: int) -> Column:
        own = F.slice("_bars", 1, h)
        first = lambda hit: F.array_min(F.filter(F.transform(own, lambda x, i: F.when(hit(x), i)), lambda i: i.isNotNull()))
        target, stop = first(lambda x: x["high"] >= p * up), first(lambda x: x["low"] <= p * down)
        label = F.when((F.size(own) == 0) | F.col(f"_last_{h}").isNull(), "no_data").when(target.isNull() & stop.isNull(), "neither").when(target == stop, "ambiguous").when(stop.isNull() | (target < stop), "target").otherwise("stop")
        return F.struct(
            F.lit(h).alias("horizon"), F.size(own).alias("bars_available"), ((F.col(f"_last_{h}") / p - 1) * 100).alias("return_pct"), ((F.array_max(F.transform(own, lambda x: x["high"])) / p - 1) * 100).alias("mfe_pct"),
            ((F.array_min(F.transform(own, lambda x: x["low"])) / p - 1) * 100).alias("mae_pct"), label.alias("target_first"),
        )

    return out.select(*endpoints.columns, F.col("close").alias("entry_price"), F.explode(F.array(*(row(h) for h in horizons))).alias("_")).select(*endpoints.columns, "entry_price", "_.*")


#: Normal quantiles of confidence levels; any other level is read as 95 %.
Z = {0.90: 1.6448536269514722, 0.95: Z95, 0.99: 2.5758293035489004}


def wilson_at(s: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """wilson at a tabulated confidence level."""
    return wilson(s, n, Z.get(round(confidence, 2), Z95))


def wilson(s: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of Wilson's score interval; null without samples."""
    p, n = F.try_divide(s.cast("double"), n.cast("double")), n.cast("double")
    scale = 1 + F.try_divide(F.lit(z * z), n)
    middle = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    half = F.lit(z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / scale
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def summarize(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts of labels for each horizon, target rates of all and of those decided, and their intervals."""
    labels = ["target", "stop", "neither", "ambiguous"]
    counts = outcomes.groupBy(*by, "horizon").agg(F.count("*").alias("samples"), *(F.count_if(F.col("target_first") == x).alias(x) for x in labels))
    t, n, d = F.col("target"), F.col("samples"), F.col("target") + F.col("stop")
    a, b = wilson(t, n), wilson(t, d)
    return counts.withColumns({
        "target_rate_all": F.try_divide(t, n), "target_rate_decisive": F.try_divide(t, d), "all_low": a[0], "all_high": a[1], "decisive_low": b[0], "decisive_high": b[1],
    })


#: Lower bounds of similarity buckets, and their labels.
BUCKETS = [(0.85, "0.85–1.00"), (0.80, "0.80–0.85"), (0.75, "0.75–0.80"), (0.70, "0.70–0.75")]


def bucketed(outcomes: DataFrame) -> DataFrame:
    """outcomes with a similarity of 0.70 or more, with similarity_bucket."""
    label = reduce(lambda c, x: c.when(F.col("similarity") >= x[0], x[1]), BUCKETS[1:], F.when(F.col("similarity") >= BUCKETS[0][0], BUCKETS[0][1]))
    return outcomes.withColumn("similarity_bucket", label).where("similarity_bucket IS NOT NULL")


def summarize_returns(values: DataFrame, column: str, *by: str) -> DataFrame:
    x = F.col(column)
    return values.where(x.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("sample_size"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.max(x).alias("maximum"), F.min(x).alias("minimum"),
        F.count_if(x > 0).alias("up"), F.count_if(x < 0).alias("down"), F.count_if(x == 0).alias("neutral"),
    )


def spaced(rows: DataFrame, at: str, spacing: int, order: list, by: list[str] = SERIES) -> DataFrame:
    """rows, in order, that lie at least spacing after the last one kept; a stream over sorted partitions with one number of state."""
    names, schema = rows.columns, rows.schema
    keys, place = [names.index(k) for k in by], names.index(at)

    def run(batches):
        key, last = None, None
        for batch in batches:
            keep = []
            for row in batch.itertuples(index=False, name=None):
                own = tuple(row[i] for i in keys)
                if own != key:
                    key, last = own, None
                keep.append(last is None or row[place] - last >= spacing)
                if keep[-1]:
                    last = row[place]
            yield batch[keep]

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def sampled_endpoints(pivots: DataFrame, candles: DataFrame, n: int = 8, most: int = 250, spacing: int = 50, horizon: int = 50) -> DataFrame:
    """Of each series' pivots with n runs before and horizon candles after, every so many, at most `most`; of those the ones spaced apart."""
    lengths = candles.groupBy(*SERIES).agg(F.count("*").alias("_length"))
    fit = pivots.join(lengths, SERIES).where((F.col("position") >= 2 * n - 1) & (F.col("confirmation_index") + horizon < F.col("_length")))
    w, whole = Window.partitionBy(*SERIES).orderBy("position"), Window.partitionBy(*SERIES)
    fit = fit.withColumns({"_k": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    fit = fit.where((F.col("_k") % stride == 0) & (F.col("_k") / stride < most))
    return spaced(fit.select(*SERIES, "position", "index", "confirmation_index"), "confirmation_index", spacing, ["position"])


def deoverlapped(outcomes: DataFrame, horizon: int) -> DataFrame:
    """outcomes (series, endpoint_index, target, similarity) by entry, then target, then falling similarity: those horizon candles after the last one kept."""
    ordered = outcomes.withColumn("_unlike", -F.col("similarity"))
    return spaced(ordered, "endpoint_index", horizon, ["endpoint_index", "target", "_unlike"]).drop("_unlike")


def on_prefixes(candles: DataFrame, function, schema: str, start: int = 0) -> DataFrame:
    """function (a frame of all candles up to a row, the row's idx) -> value, for each row from start on: series, idx, open_time, signal.

    schema: the value's type. A task streams through a series and hands each prefix on as a view, so a row adds no copy.
    """
    import pandas as pd

    columns = candles.columns
    out = f"symbol string, timeframe string, idx long, open_time long, signal {schema}"

    def run(batches):
        key, held = None, None
        for batch in batches:
            for own, part in batch.groupby(SERIES, sort=False):
                held = pd.concat([held, part], ignore_index=True) if own == key else part.reset_index(drop=True)
                key, first = own, len(held) - len(part)
                rows = [(*own, i, held.open_time.iloc[i], function(held.iloc[: i + 1], i)) for i in range(max(start, first), len(held))]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in out.split(", ")])

    return candles.select(*columns).repartition(*SERIES).sortWithinPartitions(*SERIES, "open_time").mapInPandas(run, out)


def folded(candles: DataFrame, start, update, result, schema: str, first: int = 0) -> DataFrame:
    """A signal of each row from first on, as on_prefixes, from a state that doesn't grow: series, idx, open_time, signal.

    start() is a series' state before its first candle, update(state, candle) that after a candle, result(state) the signal then. A task streams
    through its series and holds one state, so the work is one step for each candle.
    """
    import pandas as pd

    out = f"symbol string, timeframe string, idx long, open_time long, signal {schema}"

    def run(batches):
        key, state, idx = None, None, -1
        for batch in batches:
            rows = []
            for candle in batch.itertuples(index=False):
                if (candle.symbol, candle.timeframe) != key:
                    key, state, idx = (candle.symbol, candle.timeframe), start(), -1
                state, idx = update(state, candle), idx + 1
                if idx >= first:
                    rows.append((*key, idx, candle.open_time, result(state)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in out.split(", ")])

    return candles.repartition(*SERIES).sortWithinPartitions(*SERIES, "open_time").mapInPandas(run, out)


#: Candles that a reversal's episode has up to its confirmation; least distance of confirmations of matches.
EPISODE, MIN_GAP = 20, 5


def reversal_events(pivots: DataFrame, candles: DataFrame) -> DataFrame:
    """Reversals with 20 candles up to their confirmation and one after: ids by position, times, prices, delay and the episode's bounds."""
    last = candles.groupBy(*SERIES).agg(F.max("idx").alias("_last"))
    at = lambda name, columns: candles.select(*SERIES, F.col("idx").alias(name), *(F.col(c).alias(k) for c, k in columns.items()))
    out = pivots.join(last, SERIES).where((F.col("confirmation_index") >= EPISODE - 1) & (F.col("confirmation_index") < F.col("_last")))
    out = out.join(at("index", {"open_time": "pivot_time"}), [*SERIES, "index"]).join(at("confirmation_index", {"open_time": "confirmation_time", "close": "confirmation_close"}), [*SERIES, "confirmation_index"])
    number = (F.col("position") + 1).cast("string")
    return out.select(
        *SERIES, F.concat(F.lit("R"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)).alias("event_id"), "position", F.col("index").alias("pivot_index"), "confirmation_index", "direction", F.col("price").alias("pivot_price"), "pivot_time",
        "confirmation_time", "confirmation_close", (F.col("confirmation_index") - F.col("index")).alias("confirmation_delay_candles"), (F.col("confirmation_index") - EPISODE + 1).alias("pre_window_start"), F.col("confirmation_index").alias("pre_window_end"),
    )


def reversal_matches(events: DataFrame, windows: DataFrame, top_k: int = 10) -> DataFrame:
    """For every event the earlier ones of its direction, MIN_GAP candles apart at least, whose episodes are most like its own.

    windows: (series, end, v) with all features of a window's candles scaled within it, in one array.
    """
    p = events.join(windows.withColumnRenamed("end", "confirmation_index"), [*SERIES, "confirmation_index"])
    a = p.select(*SERIES, "direction", "event_id", F.col("position").alias("_p"), F.col("confirmation_index").alias("_c"), F.col("v").alias("_v"))
    b = p.select(*SERIES, "direction", F.col("event_id").alias("match_event_id"), "position", "confirmation_index", F.col("pivot_price").alias("match_pivot_price"), F.col("confirmation_close").alias("match_confirmation_close"), "v")
    both = a.join(b, [*SERIES, "direction"]).where((F.col("position") < F.col("_p")) & (F.abs(F.col("confirmation_index") - F.col("_c")) >= MIN_GAP))
    squares = F.aggregate(F.zip_with("v", "_v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    scored = both.withColumn("similarity", F.exp(-F.sqrt(squares / F.size("v"))))
    rank = Window.partitionBy(*SERIES, "event_id").orderBy(F.desc(F.round("similarity", 9)), "position")
    return scored.withColumn("match_rank", F.row_number().over(rank)).where(F.col("match_rank") <= top_k).drop("v", "_v", "_p", "_c", "position", "confirmation_index")


def signed_forward(events: DataFrame, candles: DataFrame, horizons=HORIZONS) -> DataFrame:
    """events (series, direction, confirmation_index) with a row for each horizon: returns and excursions in their direction, in percent."""
    w = lambda h: Window.partitionBy(*SERIES).orderBy("idx").rowsBetween(1, h)
    p = F.col("close")
    per = [F.struct(F.lit(h).alias("horizon"), F.last("close").over(w(h)).alias("c"), F.max("high").over(w(h)).alias("h"), F.min("low").over(w(h)).alias("l")).alias(f"_{h}") for h in horizons]
    out = in_blocks(candles, lambda c: c.select(*SERIES, F.col("idx").alias("confirmation_index"), "close", *per), 0, max(horizons), at="confirmation_index")
    out = events.join(out, [*SERIES, "confirmation_index"]).withColumn("_", F.explode(F.array(*(f"_{h}" for h in horizons)))).where("_.c IS NOT NULL")
    rise = F.col("direction") == "UP"
    return out.select(
        *events.columns, "_.horizon", ((F.col("_.c") / p - 1) * F.when(rise, 100).otherwise(-100)).alias("signed_return"),
        ((F.when(rise, F.col("_.h") / p).otherwise(F.try_divide(p, F.col("_.l"))) - 1) * 100).alias("max_favorable"), ((F.when(rise, F.col("_.l") / p).otherwise(F.try_divide(p, F.col("_.h"))) - 1) * 100).alias("max_adverse"),
    )
