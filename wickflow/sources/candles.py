"""Candles: resampling ticks, storing, merging, checking, and taking parts of a series.

A series is (symbol, timeframe); its rows are ordered by open_time (epoch ms). Everything that looks at neighbours is
partitioned by series, and numbers rows by idx from 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Timeframes and their steps in ms.
STEPS = {"1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}
SERIES = ["symbol", "timeframe"]
#: The columns of stored candles, in order.
COLUMNS = ["symbol", "timeframe", "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trades", "is_closed"]
SCHEMA = "symbol string, timeframe string, open_time long, close_time long, open double, high double, low double, close double, volume double, quote_volume double, trades long, is_closed int"


def by_time() -> Window:
    return Window.partitionBy(*SERIES).orderBy("open_time")


def resample(ticks: DataFrame, timeframe: str, symbol: str | Column = "event_type", time: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """Candles of one timeframe from ticks; the first and last value of a candle are by time, then by the tie column."""
    step = STEPS[timeframe]
    symbol = F.col(symbol) if isinstance(symbol, str) else symbol
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time).cast("timestamp_ntz"))
    start = (F.floor(micros / (step * 1000)) * step).cast("long")
    at = F.struct(time, tie)
    out = ticks.where(F.col(value).isNotNull()).groupBy(symbol.alias("symbol"), start.alias("open_time")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum(value).alias("quote_volume"), F.count("*").alias("trades"),
    )
    return out.withColumns({"timeframe": F.lit(timeframe), "close_time": F.col("open_time") + step - 1, "is_closed": F.lit(1)}).select(*COLUMNS)


#: Candles of a series that one task numbers (a span of time), and that one task looks at with their neighbours (a block of places).
SPAN_MS, BLOCK = 30 * 86_400_000, 50_000
#: Between a symbol and the number of a block.
MARK = "\x1f"


def indexed(candles: DataFrame) -> DataFrame:
    """candles with idx, the place in their series: the place in a span of time, and how many candles the spans before it have."""
    span = candles.withColumn("_span", F.floor(F.col("open_time") / SPAN_MS))
    so_far = Window.partitionBy(*SERIES).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = span.groupBy(*SERIES, "_span").count().select(*SERIES, "_span", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*SERIES, "_span").orderBy("open_time"))
    return span.withColumn("_n", own).join(before, [*SERIES, "_span"]).withColumn("idx", (F.col("_before") + F.col("_n") - 1).cast("int")).select(*candles.columns, "idx")


def block_of(place: Column) -> Column:
    return F.floor(place / BLOCK)


def haloed(candles: DataFrame, before: int, after: int = 0) -> DataFrame:
    """Indexed candles with _block and _home: each in its own block of BLOCK places, and again, not at home, in those whose candles look at it.

    A candle at home in a block finds before candles before it and after candles after it there, or all there are.
    """
    blocks = F.sequence(block_of(F.greatest(F.col("idx") - after, F.lit(0))), block_of(F.col("idx") + before))
    return candles.withColumn("_block", F.explode(blocks)).withColumn("_home", F.col("_block") == block_of(F.col("idx")))


def in_blocks(candles: DataFrame, function: Callable[[DataFrame], DataFrame], before: int, after: int = 0, at: str = "idx") -> DataFrame:
    """function(candles) by blocks, for a function whose rows are those of candles (their idx in the column at) and depend on so many neighbours at most.

    To the function each block is a series of its own.
    """
    keyed = haloed(candles, before, after).withColumn("symbol", F.concat("symbol", F.lit(MARK), F.col("_block").cast("string"))).drop("_block", "_home")
    out = function(keyed)
    block = F.substring_index("symbol", MARK, -1).cast("long")
    return out.where(block == block_of(F.col(at))).withColumn("symbol", F.substring_index("symbol", MARK, 1))


def coarser(candles: DataFrame, timeframes: list[str]) -> DataFrame:
    """Candles of coarser timeframes from those of one that divides them: ticks are read and gathered once for all."""
    steps = F.array(*(F.struct(F.lit(tf).alias("timeframe"), F.lit(STEPS[tf]).cast("long").alias("step")) for tf in timeframes))
    each = candles.drop("timeframe", "close_time").withColumn("_", F.explode(steps)).select("*", "_.*").withColumn("start", F.col("open_time") - F.pmod("open_time", "step"))
    out = each.groupBy("symbol", "timeframe", "step", "start").agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        *(F.sum(c).alias(c) for c in ("volume", "quote_volume", "trades")), F.min("is_closed").alias("is_closed"),
    )
    return out.withColumns({"open_time": F.col("start"), "close_time": F.col("start") + F.col("step") - 1}).select(*COLUMNS)


def series(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    """Indexed candles of the events table, a symbol for each event type."""
    return indexed(resample(spark.read.parquet(f"{sf_dir}/events.parquet"), timeframe))


def all_series(spark: SparkSession, sf_dir: str, timeframes: list[str] = list(STEPS)) -> DataFrame:
    """Indexed candles of the events table as one symbol, ALL, in many timeframes."""
    fine = resample(spark.read.parquet(f"{sf_dir}/events.parquet"), "1m", F.lit("ALL"))
    return indexed(coarser(fine, timeframes))


def latest(candles: DataFrame, n: int | None) -> DataFrame:
    """The latest n candles of each series; all for None or 0."""
    if not n:
        return candles
    w = Window.partitionBy(*SERIES).orderBy(F.desc("open_time"))
    return candles.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def last_open_time(candles: DataFrame) -> DataFrame:
    return candles.groupBy(*SERIES).agg(F.max("open_time").alias("last_open_time"))


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the rows of new added, or in place of those of the same series and time. Aggregates, so a hot key stays cheap."""
    keys = [*SERIES, "open_time"]
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_"))
    return picked.select(*keys, "_.*").select(*stored.columns)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order; of equal ones the least by its other values, so reruns agree."""
    rest = [c for c in rows.columns if c not in keys]
    at = F.struct(*order, *(c for c in rest if c not in order))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), at).alias("_")).select(*keys, "_.*").select(*rows.columns)


def deduplicated(candles: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row for each series and time: the first in an order of arrival, or else by its values."""
    return first_of(candles, [*SERIES, "open_time"], order or [])


def deduplicated_matches(matches: DataFrame) -> DataFrame:
    """One row for each timeframe and rank."""
    return first_of(matches, ["timeframe", "rank"], [])


def finite(column: str | Column, default: float = 0.0) -> Column:
    """A column as a number; what is none, not a number or infinite becomes the default."""
    x = (F.col(column) if isinstance(column, str) else column).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), default).otherwise(x)


def market(candles: DataFrame, symbol: str, timeframe: str) -> DataFrame:
    """Indexed candles of one series without repeated times; an error if there are none."""
    found = deduplicated(candles.where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)))
    if not found.limit(1).count():
        raise ValueError(f"no candles of {symbol} {timeframe}")
    return indexed(found)


def latest_contiguous(candles: DataFrame, step: int) -> DataFrame:
    """The rows of each series after its last gap of more than step."""
    gap = F.col("open_time") - F.lag("open_time").over(by_time()) > step
    last = F.max(F.when(F.col("_gap"), F.col("open_time"))).over(Window.partitionBy(*SERIES))
    return candles.withColumn("_gap", gap).withColumn("_from", last).where("_from IS NULL OR open_time >= _from").drop("_gap", "_from")


REQUIRED = ["open_time", "open", "high", "low", "close", "volume"]
#: What each failed rule is called in a report, in order.
MESSAGES = {"duplicate_open_time": "duplicate open timestamps", "high_below_low": "high < low", "open_outside_range": "open outside high/low", "close_outside_range": "close outside high/low", "negative_values": "negative OHLCV value", "gaps": "missing timestamp gaps detected"}


def validate(candles: DataFrame, step: int) -> DataFrame:
    """A row for each series: how many rows break each rule, and the messages in order."""
    missing = [c for c in REQUIRED if c not in candles.columns]
    if missing:
        return candles.select(*SERIES).distinct().withColumn("errors", F.array(F.lit(f"missing columns: {sorted(missing)}")))
    w = by_time()
    gap = F.col("open_time") - F.lag("open_time").over(w)
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    checks = {
        "duplicate_open_time": gap == 0,
        "high_below_low": h < lo,
        "open_outside_range": (o > h) | (o < lo),
        "close_outside_range": (c > h) | (c < lo),
        "negative_values": F.least(o, h, lo, c, F.col("volume")) < 0,
        "gaps": gap > step,
    }
    out = candles.withColumns({k: v.cast("int") for k, v in checks.items()}).groupBy(*SERIES).agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in checks))
    return out.withColumn("errors", F.array_compact(F.array(*(F.when(F.col(k) > 0, F.lit(MESSAGES[k])) for k in checks))))


def normalize_klines(raw: DataFrame, now_ms: int) -> DataFrame:
    """Rows of (symbol, timeframe, kline: array<string>) as candles; a candle is closed once its step has passed."""
    k, step = (lambda i: F.element_at("kline", i + 1)), F.element_at(F.create_map(*(F.lit(x) for kv in STEPS.items() for x in kv)), F.col("timeframe"))
    start = k(0).cast("long")
    return raw.select(
        "symbol", "timeframe", start.alias("open_time"), k(6).cast("long").alias("close_time"), *(k(i).cast("double").alias(c) for i, c in enumerate(["open", "high", "low", "close", "volume"], 1)),
        k(7).cast("double").alias("quote_volume"), k(8).cast("long").alias("trades"), (start + step <= now_ms).cast("int").alias("is_closed"),
    )


def export_csv(candles: DataFrame, path: str) -> None:
    """Gzip CSV files in the fixed columns, a folder for each timeframe."""
    candles.select(*COLUMNS).withColumn("_timeframe", F.col("timeframe")).write.partitionBy("_timeframe").option("compression", "gzip").csv(path, header=True)


def restore_csv(spark: SparkSession, path: str, stored: DataFrame | None = None) -> DataFrame:
    """Exported candles, merged into stored ones if given; a path without files gives stored ones, or none."""
    try:
        found = spark.read.schema(SCHEMA).csv(path, header=True).select(*COLUMNS)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], SCHEMA)
    return found if stored is None else upsert(stored, found)


def restored(spark: SparkSession, path: str, timeframes: list[str]) -> DataFrame:
    """What there is to restore of exported candles: a row for each timeframe with its status (FILE NOT FOUND, EMPTY or RESTORED), rows and last open_time."""
    found = restore_csv(spark, path).groupBy("timeframe").agg(F.count("*").alias("rows"), F.max("open_time").alias("last_open_time"))
    there = []
    for tf in timeframes:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_timeframe={tf}")
        there.append((tf, bool(folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder))))
    asked = spark.createDataFrame(there, "timeframe string, _there boolean")
    status = F.when(F.col("rows").isNotNull(), "RESTORED").when(F.col("_there"), "EMPTY").otherwise("FILE NOT FOUND")
    return asked.join(found, "timeframe", "left").select("timeframe", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), "last_open_time")


def increment(stored: DataFrame, offered: DataFrame, step: int, most: int | None = None) -> DataFrame:
    """stored after an update. A series that is new begins with the latest contiguous run of offered candles, most of them at most.

    Offered candles must be closed, start at a multiple of step and be newer than the last stored one. Those that break a rule of
    validate make an error, so nothing is merged then.
    """
    last = last_open_time(stored).withColumnRenamed("last_open_time", "_last")
    newer = offered.where(f"is_closed = 1 AND open_time % {step} = 0").join(last, SERIES, "left").where(F.col("_last").isNull() | (F.col("open_time") > F.col("_last")))
    newer = latest(latest_contiguous(newer.where("_last IS NULL"), step), most).unionByName(newer.where("_last IS NOT NULL")).drop("_last")
    broken = validate(newer, step).where(F.size(F.array_remove("errors", MESSAGES["gaps"])) > 0).select(*SERIES, "errors").limit(3).collect()
    if broken:
        raise ValueError(f"offered candles are not valid: {broken}")
    return upsert(stored, newer)


def paged(fetch: Callable[[int, int], list], start: int, end: int, step: int, most: int, page: int = 1000) -> Iterator[list]:
    """Pages of klines from start to end by a function of (start, limit), until one is empty or short, the cursor stands, or most are read."""
    cursor, count = max(start, 0), 0
    while cursor <= end and count < most:
        rows = fetch(cursor, min(page, most - count))
        if not rows:
            return
        yield rows
        count += len(rows)
        ahead = int(rows[-1][0]) + step
        if len(rows) < min(page, most - count + len(rows)) or ahead <= cursor:
            return
        cursor = ahead


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """Each frame as CSV with a header under its name, in place of what was there; other names stay."""
    for name, df in results.items():
        df.write.mode("overwrite").option("escape", '"').csv(f"{folder}/{name}", header=True)


def read_result(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A frame of write_results, types inferred, quotes minded: what the next step reads in place of the frame itself."""
    return spark.read.option("inferSchema", True).option("escape", '"').csv(f"{folder}/{name}", header=True)
