"""Price levels of a window's first half, and how its second half reacts to them.

A window is one row with its candles in an array, so everything here is an expression over small arrays: levels are a fold over
sorted candidates, touches a transform of the second half, and episodes a fold over touches. Nothing is shuffled but the
candles, once by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import SERIES
from .windows import KEYS, array_mean, array_median, ended, frame, let, mean

#: Reach of a level and distance at which levels merge, in true ranges; least body of a zone and least growth, in medians.
TOUCH, MERGE, BODY, GROWN = 0.20, 0.50, 1.25, 1.25
#: Candles between, and share of the price from the first to any, of touches in one episode; wick of a rejection.
EPISODE_GAP, EPISODE_NEAR, WICK = 3, 0.0015, 0.35
#: What is counted of a window's touches.
COUNTS = ["interaction_count", "break_count", "hold_count", "rejection_count", "pullback_count", "repeated_level_tests", "reaction_expansion_count", "swing_high_tests", "swing_low_tests", "body_zone_tests"]
#: Means of both halves and their difference.
SHIFTED = {"direction": "direction", "range": "raw_range", "body": "raw_body", "close_location": "raw_close"}
#: What is told of a touch.
EVENT = ["local_index", "open_time", "level_price", "level_type", "interaction", "repeated_test", "post_interaction_expansion", "open", "high", "low", "close", "volume"]
PLACES = ["first_interaction_position", "last_interaction_position"]
FEATURES = [*COUNTS, *(x for k in SHIFTED for x in (f"first_{k}", f"second_{k}", f"{k}_shift")), *PLACES]
STORY_FEATURES = [*FEATURES, "level_count"]


#: What an earlier candle offers as levels, in order, and what is said of a window's interactions with them.
PRIOR = ["PRIOR_HIGH", "PRIOR_LOW", "PRIOR_BODY"]
PRIOR_SAID = {
    "interaction_count": "PRIOR_LEVEL_INTERACTION", "pullback_count": "PULLBACK_PRESENT", "rejection_count": "REJECTION_PRESENT", "break_count": "LEVEL_BREAK_PRESENT", "hold_count": "LEVEL_HOLD_PRESENT",
    "repeated_level_hits": "REPEATED_LEVEL_TEST", "reaction_expansion_count": "POST_INTERACTION_EXPANSION",
}
PRIOR_FIELDS = [
    "interaction_count", "first_interaction_index", "last_interaction_index", "break_count", "hold_count", "rejection_count", "pullback_count", "repeated_level_hits", "reaction_expansion_count", "interaction_level_types",
    "direction_first_third", "direction_last_third", "direction_shift", "range_first_third", "range_last_third", "range_shift", "story",
]
PRIOR_EVENT = ["off", "source", "level_type", "level", "event"]


def prior_touches(bars: Column, n: int) -> Column:
    """For each candle of a window the nearest high, low or body middle of an earlier one, if it is touched, and what happens there.

    Distances are by a fifth of the earlier candle's range; of equal ones the earliest candle, then high, low, body.
    """

    def offered(i: Column, b: Column) -> Column:
        def of(j: Column) -> Column:
            p = F.get(bars, j)
            reach = F.greatest(p["range"] * TOUCH, F.lit(1e-12))
            prices = [p["high"], p["low"], (F.greatest(p["open"], p["close"]) + F.least(p["open"], p["close"])) / 2]
            far = lambda x: F.least(*(F.abs(b[k] - x) for k in ("high", "low", "close"))) / reach
            return F.array(*(F.struct(far(x).alias("far"), j.alias("source"), F.lit(k).alias("kind"), x.alias("level"), reach.alias("reach")) for k, x in enumerate(prices)))

        return F.flatten(F.transform(F.sequence(F.lit(0), i - 1), of))

    def nearest(i: Column) -> Column:
        b = F.get(bars, i)
        touched = lambda x: ((b["low"] <= x["level"]) & (x["level"] <= b["high"])) | (F.abs(b["close"] - x["level"]) <= x["reach"])
        best = F.array_min(F.filter(offered(i, b), lambda x: x["far"] <= 1.0))
        return let(best, lambda x: F.when(touched(x), F.struct(i.alias("off"), x["source"].alias("source"), x["kind"].alias("kind"), x["level"].alias("level"), x["reach"].alias("reach"))))

    def told(hits: Column, x: Column, k: Column) -> Column:
        i, b, p = x["off"], F.get(bars, x["off"]), x["level"]
        c, high, low = b["close"], x["kind"] == 0, x["kind"] == 1
        above, below = high & (c > p), low & (c < p)
        held = (high & (c <= p)) | (low & (c >= p))
        upper, lower = (b["high"] - F.greatest(b["open"], c)) / b["range"], (F.least(b["open"], c) - b["low"]) / b["range"]
        rejected = (high & (upper >= WICK) & (c < p)) | (low & (lower >= WICK) & (c > p))
        recent = F.signum(array_mean(F.transform(F.slice(bars, F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3))), lambda y: y["direction"])))
        turned = (recent != 0) & (b["direction"] != 0) & (b["direction"] != recent)
        since = F.greatest(i - 4, F.lit(0))
        usual = array_median(F.transform(F.slice(bars, since + 1, i - since + 1), lambda y: y["range"]))
        grew = F.coalesce((i + 1 < n) & (F.get(bars, i + 1)["range"] > usual * GROWN), F.lit(False))
        again = F.exists(F.slice(hits, 1, k), lambda y: F.abs(p - y["level"]) <= x["reach"])
        label = F.when(turned, "PULLBACK_TO_PRIOR_LEVEL").when(rejected, "REJECTION_AT_PRIOR_LEVEL").when(above, "BREAK_ABOVE_PRIOR_HIGH").when(below, "BREAK_BELOW_PRIOR_LOW").otherwise("LEVEL_REVISIT")
        flags = {"break": above | below, "hold": held, "rejection": rejected, "pullback": turned, "again": again, "grew": grew}
        return F.struct(i.alias("off"), x["source"].alias("source"), F.get(F.lit(PRIOR), x["kind"]).alias("level_type"), p.alias("level"), label.alias("event"), *(v.cast("int").alias(name) for name, v in flags.items()))

    return let(F.array_compact(F.transform(places(1, n), nearest)), lambda hits: F.transform(hits, lambda x, k: told(hits, x, k)))


def prior_interactions(candles: DataFrame, n: int = 20) -> DataFrame:
    """For each window of candles (with raw_anatomy) PRIOR_FIELDS and its events as an array of PRIOR_EVENT.

    A window of fewer than three candles has no interactions and says so.
    """
    third = max(1, n // 3)
    thirds = {f"{k}_{side}_third": mean(c, n, a, b) for k, c in (("direction", "direction"), ("range", "raw_range")) for side, a, b in (("first", 0, third), ("last", n - third, n))}
    bars = F.collect_list(F.struct("open", "high", "low", "close", F.col("raw_range").alias("range"), "direction"))
    w = ended(candles, n, {"bars": bars.over(frame(n)), **thirds}).withColumn("events", prior_touches(F.col("bars"), n) if n > 2 else F.array()).drop("bars")
    if n < 3:
        return w.select(*KEYS, "last", F.lit(0).alias("interaction_count"), F.lit("INSUFFICIENT_WINDOW").alias("story"))
    e, some = F.col("events"), F.size("events") > 0
    total = lambda name: F.aggregate(e, F.lit(0), lambda t, x: t + x[name])
    counts = {"break_count": "break", "hold_count": "hold", "rejection_count": "rejection", "pullback_count": "pullback", "repeated_level_hits": "again", "reaction_expansion_count": "grew"}
    at = lambda i: F.when(some, F.col("end") - n + 1 + F.element_at(e, i)["off"]).otherwise(-1)
    w = w.withColumns({"interaction_count": F.size(e), **{k: total(v) for k, v in counts.items()}, "first_interaction_index": at(1), "last_interaction_index": at(-1)})
    w = w.withColumn("interaction_level_types", F.when(some, F.array_join(F.transform(e, lambda x: x["level_type"]), " -> ")).otherwise("NONE"))
    w = w.withColumns({f"{k}_shift": F.col(f"{k}_last_third") - F.col(f"{k}_first_third") for k in ("direction", "range")})
    story = F.array_join(F.array_compact(F.array(*(F.when(F.col(k) > 0, v) for k, v in PRIOR_SAID.items()))), " -> ")
    w = w.withColumn("story", F.when(some, story).otherwise("NO_PRIOR_LEVEL_INTERACTION"))
    return w.select(*KEYS, "last", *PRIOR_FIELDS, F.transform(e, lambda x: F.struct(*(x[k].alias(k) for k in PRIOR_EVENT))).alias("events"))


def level_table(candles: DataFrame, windows: DataFrame, n: int = 20) -> DataFrame:
    """For each candle of windows (series, end) but the first: the high, low and body bounds of the candle before, and its own prices."""
    at = windows.withColumn("off", F.explode(F.sequence(F.lit(1), F.lit(n - 1)))).withColumn("idx", F.col("end") - n + 1 + F.col("off"))
    before = lambda c: F.lag(c).over(Window.partitionBy(*SERIES).orderBy("idx"))
    rows = candles.select(
        *SERIES, "idx", "open_time", before("high").alias("prior_high"), before("low").alias("prior_low"), F.greatest(before("open"), before("close")).alias("prior_body_high"),
        F.least(before("open"), before("close")).alias("prior_body_low"), F.col("high").alias("current_high"), F.col("low").alias("current_low"), F.col("close").alias("current_close"),
    )
    return at.join(rows, [*SERIES, "idx"])


def zone_bounds(price: Column, rng: Column, tolerance: float = TOUCH) -> Column:
    """The zone around a price, of a candle's range."""
    reach = F.greatest(rng * tolerance, F.lit(1e-12))
    return F.struct((price - reach).alias("low"), (price + reach).alias("high"))


def windows_of(candles: DataFrame, n: int = 20) -> DataFrame:
    """A row for each window of candles (with raw_anatomy): its candles as an array, and the means that stories start from."""
    half, third = n // 2, n // 3
    means = {f"{side}_{k}": mean(c, n, *at) for k, c in SHIFTED.items() for side, at in (("first", (0, half)), ("second", (half, n)))}
    thirds = {f"direction_{i}": mean("direction", n, a, b) for i, (a, b) in enumerate([(0, third), (third, 2 * third), (2 * third, n)])}
    bars = F.collect_list(F.struct("open_time", "open", "high", "low", "close", "volume", F.col("raw_range").alias("range"), "direction"))
    return ended(candles, n, {"bars": bars.over(frame(n)), **means, **thirds})


def places(a: int, b: int) -> Column:
    return F.sequence(F.lit(a), F.lit(b - 1)) if b > a else F.array().cast("array<int>")


def true_ranges(bars: Column, n: int) -> Column:
    """Median of the last 14 true ranges within the window at each candle; the first two have that of the third."""
    def at(i: Column) -> Column:
        own, before = F.get(bars, i), F.get(bars, F.greatest(i - 1, F.lit(0)))["close"]
        return F.greatest(own["high"] - own["low"], F.abs(own["high"] - before), F.abs(own["low"] - before))

    def rolled(ranges: Column) -> Column:
        return F.transform(places(0, n), lambda i: let(F.greatest(i, F.lit(2)), lambda k: F.greatest(array_median(F.slice(ranges, F.greatest(k - 13, F.lit(0)) + 1, F.least(k + 1, F.lit(14)))), F.lit(1e-12))))

    return let(F.transform(places(0, n), at), rolled)


def candidates(bars: Column, half: int) -> Column:
    """Swing highs and lows and wide bodies of the first half as (price, order, place, kind), by price."""
    body = lambda b: F.abs(b["close"] - b["open"])
    one = lambda yes, price, order, i, kind: F.when(yes, F.struct(price.alias("price"), order.alias("order"), i.alias("place"), F.lit(kind).alias("kind")))

    def swings(i: Column) -> Column:
        b, before, after = F.get(bars, i), F.get(bars, i - 1), F.get(bars, i + 1)
        return F.array(one(b["high"] >= F.greatest(before["high"], after["high"]), b["high"], 2 * i, i, "SWING_HIGH"), one(b["low"] <= F.least(before["low"], after["low"]), b["low"], 2 * i + 1, i, "SWING_LOW"))

    def zones(wide: Column) -> Column:
        at = lambda i: let(F.get(bars, i), lambda b: one((body(b) > 0) & (body(b) >= wide), (b["open"] + b["close"]) / 2, 2 * half + i, i, "BODY_ZONE"))
        return F.transform(places(0, half), at)

    wide = array_median(F.transform(F.slice(bars, 1, half), body)) * BODY
    return F.array_sort(F.array_compact(F.concat(F.flatten(F.transform(places(1, half - 1), swings)), let(wide, zones))))


LEVELS = "array<struct<price:double,kinds:array<string>>>"


def merged(found: Column, atr: Column) -> Column:
    """Candidates in order, each joined to the first level in reach (at the middle of both prices) or a level of its own."""

    def join(levels: Column, x: Column) -> Column:
        reach = F.greatest(F.get(atr, x["place"]) * MERGE, F.lit(1e-12))
        near = F.array_position(F.transform(levels, lambda e: F.abs(x["price"] - e["price"]) <= reach), True)
        new = F.array(F.struct(x["price"].alias("price"), F.array(x["kind"]).alias("kinds")))
        both = lambda e: F.struct(((e["price"] + x["price"]) / 2).alias("price"), F.array_union(e["kinds"], F.array(x["kind"])).alias("kinds"))
        return let(near, lambda at: F.when(at == 0, F.concat(levels, new)).otherwise(F.transform(levels, lambda e, j: F.when(j + 1 == at, both(e)).otherwise(e))))

    return F.aggregate(found, F.array().cast(LEVELS), join)


def touches(bars: Column, atr: Column, levels: Column, half: int, n: int) -> Column:
    """For each candle of the second half that reaches a level: the nearest one, and what the candle does there."""

    def nearest(i: Column) -> Column:
        b = F.get(bars, i)
        reach = F.greatest(F.get(atr, i) * TOUCH, F.lit(1e-12))
        far = F.transform(levels, lambda e, j: F.struct(F.least(F.abs(b["high"] - e["price"]), F.abs(b["low"] - e["price"]), F.abs(b["close"] - e["price"])).alias("far"), j.alias("level")))
        return let(F.array_min(far), lambda x: F.when(x["far"] <= reach, F.struct(i.alias("i"), x["level"].alias("level"), reach.alias("reach"))))

    def told(hits: Column, x: Column, k: Column) -> Column:
        i, b, e, r = x["i"], F.get(bars, x["i"]), F.get(levels, x["level"]), x["reach"]
        o, h, lo, c, p, kinds = b["open"], b["high"], b["low"], b["close"], e["price"], e["kinds"]
        high, low, zone = (F.array_contains(kinds, kind) for kind in ("SWING_HIGH", "SWING_LOW", "BODY_ZONE"))
        crossed = ((lo < p - r) & (c > p + r)) | ((h > p + r) & (c < p - r))
        upper, lower = (h - F.greatest(o, c)) / b["range"], (F.least(o, c) - lo) / b["range"]
        rejected = ((high | zone) & (upper >= WICK) & (c < p)) | ((low | zone) & (lower >= WICK) & (c > p))
        held = (high & (c <= p + r)) | (low & (c >= p - r))
        recent = F.when(i > half, F.signum(array_mean(F.transform(F.slice(bars, F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3))), lambda y: y["direction"])))).otherwise(0.0)
        turned = (recent != 0) & (b["direction"] != 0) & (b["direction"] != recent)
        since = F.greatest(i - 4, F.lit(half))
        usual = array_median(F.transform(F.slice(bars, since + 1, i - since + 1), lambda y: y["range"]))
        grew = F.coalesce((i + 1 < n) & (F.get(bars, i + 1)["range"] > usual * GROWN), F.lit(False))
        again = F.exists(F.slice(hits, 1, k), lambda y: y["level"] == x["level"])
        label = F.when(rejected, "REJECTION").when(crossed, "BREAK").when(held, "HOLD").when(turned, "PULLBACK").otherwise("TEST")
        flag = lambda v, name: v.cast("int").alias(name)
        return F.struct(
            i.alias("local_index"), b["open_time"].alias("open_time"), p.alias("level_price"), F.array_join(F.array_sort(kinds), "+").alias("level_type"), label.alias("interaction"), flag(again, "repeated_test"),
            flag(grew, "post_interaction_expansion"), *(b[k].alias(k) for k in ("open", "high", "low", "close", "volume")), flag(crossed, "_break"), flag(held, "_hold"), flag(rejected, "_rejection"), flag(turned, "_pullback"),
            flag(high, "_high"), flag(low, "_low"), flag(zone, "_zone"),
        )

    return let(F.array_compact(F.transform(places(half, n), nearest)), lambda hits: F.transform(hits, lambda x, k: told(hits, x, k)))


EPISODES = "array<struct<first:double,last:int,kinds:array<string>,again:int,grew:int>>"


def episodes(events: Column) -> Column:
    """Story tokens: neighbouring touches at one level are one episode, which has one token, and one more if range grew after."""

    def join(groups: Column, x: Column) -> Column:
        g = F.get(groups, F.size(groups) - 1)
        near = (F.abs(x["level_price"] - g["first"]) / F.greatest(F.abs(g["first"]), F.lit(1e-9)) <= EPISODE_NEAR) & (x["local_index"] - g["last"] <= EPISODE_GAP)
        row = lambda first, kinds, again, grew: F.array(F.struct(first.alias("first"), x["local_index"].alias("last"), kinds.alias("kinds"), again.alias("again"), grew.alias("grew")))
        kind, again, grew = F.array(x["interaction"]), x["repeated_test"], x["post_interaction_expansion"]
        more = row(g["first"], F.array_union(g["kinds"], kind), F.greatest(g["again"], again), F.greatest(g["grew"], grew))
        return F.when(F.coalesce(near, F.lit(False)), F.concat(F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0))), more)).otherwise(F.concat(groups, row(x["level_price"], kind, again, grew)))

    def named(g: Column) -> Column:
        has, few = (lambda k: F.array_contains(g["kinds"], k)), F.size(g["kinds"]) <= 2
        token = F.when(has("PULLBACK") & (F.size(g["kinds"]) == 1), "PULLBACK_CLUSTER").when(has("REJECTION") & few, "REJECTION_CLUSTER").when(has("HOLD") & few, "HOLD_CLUSTER").when(g["again"] > 0, "REPEATED_TEST_CLUSTER").otherwise("LEVEL_INTERACTION_CLUSTER")
        return F.array_compact(F.array(token, F.when(g["grew"] > 0, "EXPANSION_AFTER_TEST")))

    return let(F.flatten(F.transform(F.aggregate(events, F.array().cast(EPISODES), join), named)), lambda t: F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1))))


def level_rows(windows: DataFrame, n: int = 20) -> DataFrame:
    """windows_of with STORY_FEATURES, level_story, events (an array) and level_tokens of each window."""
    half = n // 2
    w = windows.withColumn("atr", true_ranges(F.col("bars"), n))
    w = w.withColumn("levels", merged(candidates(F.col("bars"), half), F.col("atr")))
    w = w.withColumn("events", touches(F.col("bars"), F.col("atr"), F.col("levels"), half, n)).drop("bars", "atr")
    e = F.col("events")
    total = lambda name: F.aggregate(e, F.lit(0), lambda t, x: t + x[name])
    counted = dict(zip(COUNTS[1:], ["_break", "_hold", "_rejection", "_pullback", "repeated_test", "post_interaction_expansion", "_high", "_low", "_zone"], strict=True))
    at = lambda i: F.when(F.size(e) > 0, F.element_at(e, i)["local_index"] / max(n - half, 1)).otherwise(-1.0)
    w = w.withColumns({"interaction_count": F.size(e), **{k: total(v) for k, v in counted.items()}, "level_count": F.size("levels"), PLACES[0]: at(1), PLACES[1]: at(-1), "level_tokens": episodes(e)})
    shown = lambda x: F.struct(*(x[k].alias(k) for k in EVENT))
    w = w.withColumn("events", F.transform(e, shown))
    w = w.withColumns({f"{k}_shift": F.col(f"second_{k}") - F.col(f"first_{k}") for k in SHIFTED})
    said = [("interaction_count", "MEANINGFUL_LEVEL_TEST"), ("pullback_count", "PULLBACK_TO_LEVEL"), ("rejection_count", "REJECTION"), ("break_count", "BREAK"), ("hold_count", "HOLD"), ("repeated_level_tests", "REPEATED_TEST"), ("reaction_expansion_count", "POST_TEST_EXPANSION")]
    story = F.array_join(F.array_compact(F.array(*(F.when(F.col(k) > 0, v) for k, v in said))), " -> ")
    return w.withColumn("level_story", F.when(story == "", "NO_MEANINGFUL_LEVEL_INTERACTION").otherwise(story)).drop("levels")


def level_events(rows: DataFrame) -> DataFrame:
    """A row for each touch of the windows of level_rows."""
    # Outer, since Spark would else filter by the array's size first, and compute it with all it depends on for that alone.
    return rows.select(*KEYS, F.inline_outer("events")).where("local_index IS NOT NULL")


#: What is said of counts, in order.
SAID = [("rejection_count", "some tests were rejected"), ("hold_count", "some areas held"), ("pullback_count", "there were returns toward tested areas"), ("repeated_level_tests", "some areas were visited repeatedly")]


def explained_levels() -> Column:
    """A sentence on the counts of level_rows."""
    text = F.array_join(F.array_compact(F.array(*(F.when(F.col(k) > 0, v) for k, v in SAID))), ", ")
    return F.concat(F.when(text == "", "few level interactions were detected").otherwise(text), F.lit("."))
