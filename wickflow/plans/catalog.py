"""Every registered query of the library, and DuckDB SQL that returns the same rows.

A query runs over the events table, resampled to candles with a symbol for each event type. Doubles are rounded to six
places, in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ft
from ..operators import clusters as cu
from ..operators import levels as lv
from ..operators import mtf as mt
from ..operators import outcomes as oc
from ..operators import stories as sr
from ..operators import structure as st
from ..operators import vectors as vc
from ..operators import windows as wd
from ..sources import candles as src
from ..sources import pages as pg
from ..sources import store as cs
from ..streaming import turns as tn
from ..tables import scratch, shared_path, written
from .oracle import FEATURES, build, medians, summary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: In percent; events jump, so turns need a large one.
THRESHOLD, THRESHOLDS = 30.0, (20.0, 30.0, 50.0)
#: Scales of differences between swings, for jumps of this size.
SCALES = st.SCALES | {"swing": 1000.0, "leg": 2000.0}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without a negative zero; whole numbers as long."""
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir), and the SQL that it must agree with."""

    def register(function):
        key = name or function.__name__
        QUERIES[key] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = sql
        return function

    return register


def featured(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    return src.in_blocks(src.series(spark, sf_dir, timeframe), ft.candle_features, ft.REACH)


def behaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.in_blocks(src.series(spark, sf_dir), ft.behaviour, ft.REACH)


def turns(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    return st.zigzag_turns(src.series(spark, sf_dir), threshold)


def r(*names: str) -> str:
    return ", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in names)


# ------------------------------------------------------------------ sources

BAR = "symbol, timeframe, open_time, open_time + {step} - 1 AS close_time, " + r("open", "high", "low", "close", "volume", "quote_volume") + ", trades, CAST(1 AS BIGINT) AS is_closed"
for tf in ("1h", "4h", "1d"):
    query(build(f"SELECT {BAR.format(step=src.STEPS[tf])} FROM bars_{tf}"), f"candles_{tf}")(lambda spark, sf_dir, tf=tf: src.resample(spark.read.parquet(f"{sf_dir}/events.parquet"), tf))


@query(build(f"SELECT * EXCLUDE (n) FROM (SELECT {BAR.format(step=3_600_000)}, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM bars_1h) WHERE n <= 48"))
def candles_latest_n(spark, sf_dir):
    return src.latest(src.series(spark, sf_dir), 48).select(*src.COLUMNS)


@query(build("SELECT symbol, timeframe, max(open_time) AS last_open_time FROM (SELECT * FROM bars_1h UNION ALL SELECT * FROM bars_1d) GROUP BY ALL"))
def last_open_time(spark, sf_dir):
    return src.last_open_time(src.series(spark, sf_dir).unionByName(src.series(spark, sf_dir, "1d")))


@query(build(f"SELECT symbol, timeframe, open_time, CASE WHEN idx % 7 = 0 THEN round(close * 2, 6) ELSE round(close, 6) END AS close, trades FROM c_1h"))
def candles_upsert_merge(spark, sf_dir):
    stored = src.series(spark, sf_dir)
    return src.upsert(stored, stored.where("idx % 7 = 0").withColumn("close", F.col("close") * 2)).select("symbol", "timeframe", "open_time", "close", "trades")


@query(build("""SELECT symbol, timeframe, CAST(0 AS BIGINT) AS duplicate_open_time, CAST(count_if(high < low) AS BIGINT) AS high_below_low, CAST(count_if(open > high OR open < low) AS BIGINT) AS open_outside_range, CAST(count_if(close > high OR close < low) AS BIGINT) AS close_outside_range,
  CAST(count_if(least(open, high, low, close, volume) < 0) AS BIGINT) AS negative_values, CAST(count_if(gap > 3600000) AS BIGINT) AS gaps, concat_ws('; ', CASE WHEN high_below_low > 0 THEN 'high < low' END, CASE WHEN open_outside_range > 0 THEN 'open outside high/low' END, CASE WHEN close_outside_range > 0 THEN 'close outside high/low' END, CASE WHEN negative_values > 0 THEN 'negative OHLCV value' END, CASE WHEN gaps > 0 THEN 'missing timestamp gaps detected' END) AS messages FROM (SELECT *, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS gap FROM bars_1h) GROUP BY ALL"""))
def validate_report(spark, sf_dir):
    return src.validate(src.series(spark, sf_dir), src.STEPS["1h"]).withColumn("messages", F.array_join("errors", "; ")).drop("errors")


@query(build("""SELECT symbol, timeframe, open_time, round(close, 6) AS close FROM (SELECT *, max(CASE WHEN gap > 3600000 THEN open_time END) OVER (PARTITION BY symbol) AS since FROM
  (SELECT *, open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS gap FROM bars_1h)) WHERE since IS NULL OR open_time >= since"""))
def latest_contiguous_segment(spark, sf_dir):
    return src.latest_contiguous(src.series(spark, sf_dir), src.STEPS["1h"]).select("symbol", "timeframe", "open_time", "close")


@query(build(f"SELECT {BAR.format(step=3_600_000)} FROM bars_1h"))
def stored_candles(spark, sf_dir):
    """Candles after three merges into a store: early versions of all, the candles, and early versions of a third that come late, the last merge twice."""
    store = cs.CandleStore(spark, shared_path(spark, "store"))
    with scratch(spark):
        c = written(src.series(spark, sf_dir).select(*src.COLUMNS), "offered")
        early = c.withColumns({"close": F.col("close") * 2, "trades": F.col("trades") - 1})
        for batch, rows in enumerate([early, c, early.where("open_time % 3 = 0")]):
            store.merge(rows, "events", batch)
        store.merge(early, "events", 2)
    return store.read()


@query(build(f"SELECT {BAR.format(step=3_600_000)} FROM bars_1h"))
def paged_candles(spark, sf_dir):
    """Candles as klines of a folder that stands for a server, fetched page by page in spans of time."""
    c = src.series(spark, sf_dir)
    kline = F.to_json(F.array(*(F.col(x).cast("string") for x in ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades"))))
    folder = shared_path(spark, "server")
    c.select(kline.alias("value"), *src.SERIES).write.partitionBy(*src.SERIES).text(folder)
    about = c.agg(F.min("open_time"), F.max("open_time"), F.array_join(F.array_sort(F.collect_set("symbol")), ",")).first()
    spark.dataSource.register(pg.KlinePages)
    fetched = spark.read.format("klines").options(path=folder, symbols=about[2] or "", timeframes="1h", start=str(about[0] or 0), end=str(about[1] or 0), page="100", partitions="3").load()
    return src.normalize_klines(fetched, 4_102_444_800_000).select(*src.COLUMNS)


# ------------------------------------------------------------------ features

ADDED = ["return", "log_return", "true_range", "volume_change", "momentum_10", "roc_20", "body_range_ratio", "upper_wick_ratio", "lower_wick_ratio", "close_position", "range_vs_mean", "volume_z", "atr_14", "volatility_20", "slope_20", "acceleration", "atr_pct"]
W = "(PARTITION BY symbol ORDER BY idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, least: int = 5) -> str:
    return f"CASE WHEN count({x}) OVER {W.format(n - 1)} >= {least} THEN {f}({x}) OVER {W.format(n - 1)} END"


A1 = """SELECT *, close / lag(close) OVER s - 1 AS "return", ln(close / nullif(lag(close) OVER s, 0)) AS log_return, high - low AS rg, greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS true_range,
  volume / lag(volume) OVER s - 1 AS volume_change, close / lag(close, 10) OVER s - 1 AS momentum_10, close / lag(close, 20) OVER s - 1 AS roc_20 FROM c_1h WINDOW s AS (PARTITION BY symbol ORDER BY idx)"""
A2 = f"""SELECT *, abs(close - open) / (rg + 2.220446049250313e-16) AS body_range_ratio, (high - greatest(open, close)) / (rg + 2.220446049250313e-16) AS upper_wick_ratio, (least(open, close) - low) / (rg + 2.220446049250313e-16) AS lower_wick_ratio,
  (close - low) / (rg + 2.220446049250313e-16) AS close_position, rg / ({roll("avg", "rg", 20)} + 2.220446049250313e-16) AS range_vs_mean, CASE WHEN {roll("stddev_samp", "volume", 20)} < 1e-9 THEN 0.0 ELSE (volume - {roll("avg", "volume", 20)}) / ({roll("stddev_samp", "volume", 20)} + 2.220446049250313e-16) END AS volume_z,
  {roll("avg", "true_range", 14)} AS atr_14, {roll("stddev_samp", "log_return", 20)} AS volatility_20, {roll("avg", "log_return", 20)} AS slope_20, "return" - lag("return") OVER (PARTITION BY symbol ORDER BY idx) AS acceleration FROM a1"""
A3 = "SELECT *, atr_14 / (abs(close) + 2.220446049250313e-16) AS atr_pct FROM a2"


@query(build("SELECT symbol, open_time, " + ", ".join(f'round("{x}", 4) + 0.0 AS "{x}"' for x in ADDED) + " FROM a3", a1=A1, a2=A2, a3=A3))
def add_features(spark, sf_dir):
    out = src.in_blocks(src.series(spark, sf_dir), ft.add_features, ft.REACH)
    return out.select("symbol", "open_time", *((F.round(x, 4) + 0.0).alias(x) for x in ADDED))


@query(build("""SELECT symbol, CAST(10 * count(*) AS BIGINT) AS length, round(sum(z), 3) + 0.0 AS total FROM (SELECT symbol, idx, """ + " + ".join(f'(v_{i} - avg(v_{i}) OVER (PARTITION BY symbol)) / (stddev_pop(v_{i}) OVER (PARTITION BY symbol) + 1e-9) * {i + 1}' for i in range(10)) + """ AS z
  FROM (SELECT symbol, idx, """ + ", ".join(f'coalesce("{x}", 0) AS v_{i}' for i, x in enumerate(ft.PATTERN)) + """ FROM a3 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) <= 20)) WHERE true GROUP BY ALL""", a1=A1, a2=A2, a3=A3).replace("round(sum(z), 3) + 0.0", "round(sum(z * z), 2)"))
def pattern_vector_last(spark, sf_dir):
    """Length and a weighted sum of squares of each vector, row by row."""
    v = ft.pattern_vectors(src.in_blocks(src.series(spark, sf_dir), ft.add_features, ft.REACH), 20)
    rows = F.transform(F.sequence(F.lit(0), (F.size("vector") / 10 - 1).cast("int")), lambda i: sum((F.element_at("vector", (i * 10 + k + 1).cast("int")) * (k + 1) for k in range(10)), F.lit(0.0)))
    return v.select("symbol", F.size("vector").cast("long").alias("length"), F.round(F.aggregate(rows, F.lit(0.0), lambda a, x: a + x * x), 2).alias("total"))


@query(build(f"SELECT symbol, idx, {r(*FEATURES)} FROM f_1h"))
def candle_features(spark, sf_dir):
    return featured(spark, sf_dir).select("symbol", "idx", *wd.FEATURES)


B1 = """SELECT *, nullif(high - low, 0) AS rg, (high - low) / nullif(close, 0) * 100 AS range_pct, abs(close - lag(close) OVER s) AS move, abs(close - lag(close, 12) OVER s) AS far FROM c_1h WINDOW s AS (PARTITION BY symbol ORDER BY idx)"""
B2 = f"""SELECT *, abs(close - open) / rg * 100 AS body_pct, (high - greatest(open, close)) / rg * 100 AS upper_wick_pct, (least(open, close) - low) / rg * 100 AS lower_wick_pct,
  CASE WHEN count(*) OVER {W.format(11)} >= 6 THEN (max(high) OVER {W.format(11)} - min(low) OVER {W.format(11)}) / nullif(close, 0) * 100 END AS rolling, range_pct / nullif({roll("median", "range_pct", 20)}, 0) AS range_vs_median, far / nullif({roll("sum", "move", 12, 6)}, 0) AS efficiency FROM b1"""
B3 = f"SELECT *, rolling / nullif({roll('median', 'rolling', 24, 12)}, 0) AS compression_ratio FROM b2"
B4 = """SELECT *, CASE WHEN greatest(upper_wick_pct, lower_wick_pct) > 50 AND body_pct < 40 AND range_vs_median > 1.15 THEN 'rejection' WHEN range_vs_median > 1.5 AND efficiency > 0.55 THEN 'directional' WHEN range_vs_median > 1.5 THEN 'expansion'
  WHEN compression_ratio < 0.75 AND efficiency < 0.35 THEN 'compression' ELSE 'balanced' END AS behaviour_state,
  coalesce(abs(range_vs_median - lag(range_vs_median) OVER s), 0) + coalesce(abs(efficiency - lag(efficiency) OVER s), 0) + coalesce(abs(compression_ratio - lag(compression_ratio) OVER s), 0) AS transition FROM b3 WINDOW s AS (PARTITION BY symbol ORDER BY idx)"""
BEHAVED = ["body_pct", "upper_wick_pct", "lower_wick_pct", "range_vs_median", "efficiency", "compression_ratio", "transition"]
B = {"b1": B1, "b2": B2, "b3": B3, "b4": B4}


@query(build(f"SELECT symbol, idx, behaviour_state, {r(*BEHAVED)} FROM b4", **B))
def behaviour_prepare(spark, sf_dir):
    return behaved(spark, sf_dir).select("symbol", "idx", "behaviour_state", *BEHAVED)


@query(build("SELECT symbol, behaviour_state, count(*) AS candles FROM b4 GROUP BY ALL", **B))
def state_counts(spark, sf_dir):
    return behaved(spark, sf_dir).groupBy("symbol", "behaviour_state").agg(F.count("*").alias("candles"))


@query(build("""SELECT symbol, idx, concat_ws('|', CASE WHEN direction > 0 THEN 'BULLISH' WHEN direction < 0 THEN 'BEARISH' ELSE 'DOJI' END, CASE WHEN body_pct < 0.25 THEN 'SMALL_BODY' WHEN body_pct >= 0.6 THEN 'LARGE_BODY' ELSE 'MEDIUM_BODY' END,
  CASE WHEN range_ratio * 5 < 0.75 THEN 'COMPRESSION' WHEN range_ratio * 5 > 1.25 THEN 'EXPANSION' ELSE 'NORMAL_RANGE' END, CASE WHEN upper_wick_pct >= 0.35 THEN 'UPPER_REJECTION' END, CASE WHEN lower_wick_pct >= 0.35 THEN 'LOWER_REJECTION' END,
  CASE WHEN close_location >= 0.75 THEN 'CLOSE_HIGH' END, CASE WHEN close_location <= 0.25 THEN 'CLOSE_LOW' END, CASE WHEN direction > 0 AND body_pct >= 0.6 AND close_location >= 0.7 THEN 'STRONG_BULL' END, CASE WHEN direction < 0 AND body_pct >= 0.6 AND close_location <= 0.3 THEN 'STRONG_BEAR' END) AS tags FROM f_1h"""))
def candle_tags(spark, sf_dir):
    return ft.tags(featured(spark, sf_dir)).select("symbol", "idx", "tags")


@query(build("""SELECT symbol, idx, CASE WHEN range_ratio <= q1 THEN 'compression' WHEN range_ratio >= q3 AND lower_wick_pct > 1.35 * upper_wick_pct AND lower_wick_pct > 0.8 * body_pct THEN 'expansion_lower_rejection'
  WHEN range_ratio >= q3 AND upper_wick_pct > 1.35 * lower_wick_pct AND upper_wick_pct > 0.8 * body_pct THEN 'expansion_upper_rejection' WHEN range_ratio >= q3 AND body_pct >= 0.6 AND direction <> 0 THEN 'directional_expansion' WHEN range_ratio >= q3 THEN 'expansion'
  WHEN lower_wick_pct > 1.5 * upper_wick_pct AND lower_wick_pct > body_pct THEN 'lower_rejection' WHEN upper_wick_pct > 1.5 * lower_wick_pct AND upper_wick_pct > body_pct THEN 'upper_rejection' WHEN body_pct < 0.3 THEN 'small_body' WHEN direction > 0 THEN 'bullish_body' WHEN direction < 0 THEN 'bearish_body' ELSE 'neutral_body' END AS label
  FROM f_1h JOIN (SELECT symbol, quantile_cont(range_ratio, 0.25) AS q1, quantile_cont(range_ratio, 0.75) AS q3 FROM f_1h GROUP BY symbol) USING (symbol)"""))
def behaviour_states(spark, sf_dir):
    return ft.behaviour_labels(featured(spark, sf_dir)).select("symbol", "idx", "label")


# ------------------------------------------------------------------ structure and outcomes


@query(build(f"SELECT symbol, timeframe, index, confirmation_index, direction, {r('price')} FROM turns"))
def zigzag_pivots(spark, sf_dir):
    return turns(spark, sf_dir)


@query(build(f"SELECT symbol, timeframe, index, confirmation_index, direction, {r('price')} FROM turns"))
def streamed_turns(spark, sf_dir):
    """The same turns from candles that arrive in three spans of time, by a stream that is stopped and started between them."""
    return tn.turns_in_batches(src.series(spark, sf_dir), THRESHOLD)


@query(build(f"SELECT symbol, index, position, pivot_type, coalesce(bars_since_prev, 0) AS bars_since_prev, {r('swing_pct', 'leg_pct', 'normalized_price', 'previous_same_type_price')} FROM pivots"))
def swing_structure(spark, sf_dir):
    return st.structure(turns(spark, sf_dir)).select("symbol", "index", "position", "pivot_type", F.coalesce("bars_since_prev", F.lit(0)).alias("bars_since_prev"), "swing_pct", "leg_pct", "normalized_price", "previous_same_type_price")


MATCH = ["symbol", "target", "candidate_start_index", "candidate_end_index", "candidate_confirmation_index", "pivot_type_sequence", "rank"]


@query(build(f"SELECT {', '.join(MATCH)}, {r('similarity')} FROM pairs_top JOIN last_pivot USING (symbol, target) WHERE rank <= 10"))
def structure_match(spark, sf_dir):
    pivots = st.structure(turns(spark, sf_dir))
    targets = pivots.groupBy(*src.SERIES).agg(F.max("position").alias("end_position"))
    return st.match_structures(pivots, targets, scales=SCALES).select(*MATCH, "similarity")


def walk_forward(spark, sf_dir) -> DataFrame:
    """Matches of all sampled endpoints in one join."""
    pivots = st.structure(turns(spark, sf_dir))
    ends = oc.sampled_endpoints(pivots, src.series(spark, sf_dir)).select(*src.SERIES, F.col("position").alias("end_position"))
    return st.match_structures(pivots, ends, top_k=5, scales=SCALES)


@query(build(f"SELECT {', '.join(MATCH)}, {r('similarity')} FROM pairs_top JOIN sampled USING (symbol, target) WHERE rank <= 5"))
def walk_forward_matches(spark, sf_dir):
    return walk_forward(spark, sf_dir).select(*MATCH, "similarity")


@query(build("SELECT symbol, target FROM sampled"))
def walk_forward_endpoints(spark, sf_dir):
    return oc.sampled_endpoints(st.structure(turns(spark, sf_dir)), src.series(spark, sf_dir)).select("symbol", F.col("position").alias("target"))


def endpoint_outcomes(spark, sf_dir) -> DataFrame:
    ends = turns(spark, sf_dir).select(*src.SERIES, F.col("confirmation_index").alias("endpoint_index")).distinct()
    return oc.measure(ends, src.series(spark, sf_dir))


@query(build(f"SELECT symbol, endpoint_index, horizon, bars_available, target_first, {r('entry_price', 'return_pct', 'mfe_pct', 'mae_pct')} FROM outcomes"))
def endpoint_baseline(spark, sf_dir):
    return endpoint_outcomes(spark, sf_dir).drop("timeframe")


@query(build(summary("outcomes", "symbol")))
def outcome_summary_ci(spark, sf_dir):
    return oc.summarize(endpoint_outcomes(spark, sf_dir), "symbol")


def matched_outcomes(spark, sf_dir) -> DataFrame:
    found = walk_forward(spark, sf_dir).withColumn("endpoint_index", F.col("candidate_confirmation_index"))
    return oc.measure(found.select(*src.SERIES, "endpoint_index", "target", "rank", "similarity"), src.series(spark, sf_dir))


# An entry may be an endpoint of its own or not, so its outcome is measured here.
MO = """SELECT p.symbol, p.target, p.rank, p.similarity, p.candidate_confirmation_index AS endpoint_index, o.horizon, o.target_first, o.return_pct FROM pairs_top p JOIN sampled s ON s.symbol = p.symbol AND s.target = p.target
  JOIN outcomes o ON o.symbol = p.symbol AND o.endpoint_index = p.candidate_confirmation_index WHERE p.rank <= 5"""


@query(build(f"SELECT symbol, target, rank, endpoint_index, horizon, target_first, {r('similarity', 'return_pct')} FROM mo", mo=MO))
def match_outcomes(spark, sf_dir):
    return matched_outcomes(spark, sf_dir).select("symbol", "target", "rank", "endpoint_index", "horizon", "target_first", "similarity", "return_pct")


@query(build(summary("bk", "similarity_bucket"), mo=MO, bk="SELECT *, CASE WHEN similarity >= 0.85 THEN '0.85–1.00' WHEN similarity >= 0.80 THEN '0.80–0.85' WHEN similarity >= 0.75 THEN '0.75–0.80' WHEN similarity >= 0.70 THEN '0.70–0.75' END AS similarity_bucket FROM mo WHERE similarity >= 0.70"))
def similarity_buckets(spark, sf_dir):
    return oc.summarize(oc.bucketed(matched_outcomes(spark, sf_dir)), "similarity_bucket")


@query(build("""SELECT symbol, idx, count(*) OVER w AS bars_available, round(last(close) OVER w / nullif(close, 0) - 1, 6) AS forward_return, round(max(high) OVER w / nullif(close, 0) - 1, 6) AS mfe, round(min(low) OVER w / nullif(close, 0) - 1, 6) AS mae
  FROM c_1h WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"""))
def forward_outcomes(spark, sf_dir):
    return oc.forward_outcomes(src.series(spark, sf_dir), 10).select("symbol", "idx", "bars_available", "forward_return", "mfe", "mae")


@query(build("""SELECT symbol, count(x) AS sample_size, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(max(x), 6) AS maximum, round(min(x), 6) AS minimum, CAST(count_if(x > 0) AS BIGINT) AS up, CAST(count_if(x < 0) AS BIGINT) AS down, CAST(count_if(x = 0) AS BIGINT) AS neutral
  FROM (SELECT symbol, last(close) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) / nullif(close, 0) - 1 AS x FROM c_1h) WHERE x IS NOT NULL GROUP BY ALL"""))
def returns_summary(spark, sf_dir):
    return oc.summarize_returns(oc.forward_outcomes(src.series(spark, sf_dir), 10), "forward_return", "symbol")


@query(build("SELECT symbol, target, endpoint_index FROM kept WHERE keep", numbered="SELECT p.symbol, p.target, candidate_confirmation_index AS endpoint_index, row_number() OVER (PARTITION BY p.symbol ORDER BY candidate_confirmation_index, p.target, similarity DESC) AS n FROM pairs_top p JOIN sampled s ON s.symbol = p.symbol AND s.target = p.target WHERE p.rank <= 5",
    kept="SELECT symbol, n, target, endpoint_index, endpoint_index AS held, true AS keep FROM numbered WHERE n = 1 UNION ALL SELECT e.symbol, e.n, e.target, e.endpoint_index, CASE WHEN e.endpoint_index - k.held >= 50 THEN e.endpoint_index ELSE k.held END, e.endpoint_index - k.held >= 50 FROM kept k JOIN numbered e ON e.symbol = k.symbol AND e.n = k.n + 1"))
def deoverlapped(spark, sf_dir):
    found = walk_forward(spark, sf_dir).withColumn("endpoint_index", F.col("candidate_confirmation_index"))
    return oc.deoverlapped(found.select(*src.SERIES, "target", "endpoint_index", "similarity"), 50).select("symbol", "target", "endpoint_index")


@query(build("""SELECT horizon, samples, target, round(greatest(0.0, (p + zz2 / 2 / samples - z * sqrt((p * (1 - p) + zz2 / 4 / samples) / samples)) / (1 + zz2 / samples)), 6) AS low, round(least(1.0, (p + zz2 / 2 / samples + z * sqrt((p * (1 - p) + zz2 / 4 / samples) / samples)) / (1 + zz2 / samples)), 6) AS high
  FROM (SELECT *, target / samples::DOUBLE AS p, 1.6448536269514722::DOUBLE AS z, pow(1.6448536269514722::DOUBLE, 2) AS zz2 FROM (SELECT horizon, count(*) AS samples, CAST(count_if(target_first = 'target') AS BIGINT) AS target FROM outcomes GROUP BY ALL))"""))
def target_rates_90(spark, sf_dir):
    """Target rates of all endpoints with intervals at a tabulated level."""
    out = endpoint_outcomes(spark, sf_dir).groupBy("horizon").agg(F.count("*").alias("samples"), F.count_if(F.col("target_first") == "target").alias("target"))
    low, high = oc.wilson_at(F.col("target"), F.col("samples"), 0.90)
    return out.select("horizon", "samples", "target", low.alias("low"), high.alias("high"))


@query(build("SELECT symbol, idx, open_time, close > avg(close) OVER (PARTITION BY symbol ORDER BY idx) + 1e-9 AS signal FROM c_1h QUALIFY idx >= 20"))
def prefix_signals(spark, sf_dir):
    """Whether each candle's close is above the mean of all closes up to it."""
    out = oc.folded(
        src.series(spark, sf_dir).select(*src.SERIES, "open_time", "close"), start=lambda: (0, 0.0, 0.0), update=lambda s, c: (s[0] + 1, s[1] + c.close, c.close), result=lambda s: bool(s[2] > s[1] / s[0] + 1e-9), schema="boolean", first=20
    )
    return out.drop("timeframe")


EV = "SELECT symbol, index, confirmation_index, direction, h.horizon, c.close AS p, arg_max(n.close, n.idx) AS cl, max(n.high) AS hi, min(n.low) AS lo FROM turns JOIN c_1h c USING (symbol) CROSS JOIN (SELECT unnest([5, 10, 20, 50])::BIGINT AS horizon) h JOIN c_1h n ON n.symbol = turns.symbol AND n.idx > confirmation_index AND n.idx <= confirmation_index + h.horizon WHERE c.idx = confirmation_index GROUP BY ALL"
RV = "SELECT symbol, index, confirmation_index, direction, horizon, (cl / p - 1) * CASE WHEN direction = 'UP' THEN 100 ELSE -100 END AS signed_return, (CASE WHEN direction = 'UP' THEN hi / p ELSE p / nullif(lo, 0) END - 1) * 100 AS max_favorable, (CASE WHEN direction = 'UP' THEN lo / p ELSE p / nullif(hi, 0) END - 1) * 100 AS max_adverse FROM ev"


def reversals(spark, sf_dir, threshold: float = THRESHOLD) -> DataFrame:
    return oc.signed_forward(turns(spark, sf_dir, threshold), src.series(spark, sf_dir))


EVENT_COLUMNS = ["event_id", "pivot_index", "confirmation_index", "direction", "pivot_price", "pivot_time", "confirmation_time", "confirmation_close", "confirmation_delay_candles", "pre_window_start", "pre_window_end"]
RE = """SELECT p.symbol, 'R' || lpad(CAST(position + 1 AS VARCHAR), 5, '0') AS event_id, p.position, p.index AS pivot_index, p.confirmation_index, p.direction, p.price AS pivot_price, a.open_time AS pivot_time, b.open_time AS confirmation_time, b.close AS confirmation_close,
  p.confirmation_index - p.index AS confirmation_delay_candles, p.confirmation_index - 19 AS pre_window_start, p.confirmation_index AS pre_window_end FROM pivots p JOIN c_1h a ON a.symbol = p.symbol AND a.idx = p.index JOIN c_1h b ON b.symbol = p.symbol AND b.idx = p.confirmation_index
  WHERE p.confirmation_index >= 19 AND p.confirmation_index + 1 < (SELECT count(*) FROM c_1h c WHERE c.symbol = p.symbol)"""


def episodes(spark, sf_dir, threshold: float = THRESHOLD) -> DataFrame:
    return oc.reversal_events(st.structure(turns(spark, sf_dir, threshold)), src.series(spark, sf_dir))


@query(build(f"SELECT symbol, {', '.join(x if x not in ('pivot_price', 'confirmation_close') else r(x) for x in EVENT_COLUMNS)} FROM re", re=RE))
def reversal_events(spark, sf_dir):
    return episodes(spark, sf_dir).select("symbol", *EVENT_COLUMNS)


@query(build(f"SELECT symbol, index, confirmation_index, direction, horizon, {r('signed_return', 'max_favorable', 'max_adverse')} FROM rv", ev=EV.replace("SELECT symbol", "SELECT turns.symbol", 1), rv=RV))
def reversal_outcomes(spark, sf_dir):
    return reversals(spark, sf_dir).select("symbol", "index", "confirmation_index", "direction", "horizon", "signed_return", "max_favorable", "max_adverse")


EVT = EV.replace("SELECT symbol", "SELECT t.threshold, t.symbol", 1).replace("FROM turns JOIN c_1h c USING (symbol)", "FROM turns_all t JOIN c_1h c ON c.symbol = t.symbol").replace("turns.symbol", "t.symbol") + " HAVING confirmation_index >= 19"


@query(build("SELECT threshold, horizon, count(*) AS n, round(avg(signed_return), 6) AS mean, round(median(signed_return), 6) AS median, CAST(count_if(signed_return > 0) AS BIGINT) AS positive, CAST(count_if(signed_return < 0) AS BIGINT) AS negative, round(count_if(signed_return > 0) * 100.0::DOUBLE / count(*), 6) AS positive_share_pct FROM rv GROUP BY ALL", ev=EVT, rv=RV.replace("SELECT symbol", "SELECT threshold, symbol", 1)))
def reversal_summary(spark, sf_dir):
    """What followed reversals of several sizes, all found in one pass."""
    x, candles = F.col("signed_return"), src.series(spark, sf_dir)
    found = oc.signed_forward(st.turns_of_each(candles, list(THRESHOLDS)).where("confirmation_index >= 19"), candles)
    out = found.groupBy("threshold", "horizon")
    return out.agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.count_if(x > 0).alias("positive"), F.count_if(x < 0).alias("negative"), (F.count_if(x > 0) * 100.0 / F.count("*")).alias("positive_share_pct"))


RM = """SELECT a.symbol, a.event_id, b.event_id AS match_event_id, b.position, exp(-sqrt(sum(""" + " + ".join(f"pow(x.{f} - y.{f}, 2)" for f in FEATURES) + """) / 180)) AS similarity
  FROM re a JOIN re b ON b.symbol = a.symbol AND b.direction = a.direction AND b.position < a.position AND abs(b.confirmation_index - a.confirmation_index) >= 5
  JOIN z x ON x.symbol = a.symbol AND x.wend = a.confirmation_index JOIN z y ON y.symbol = b.symbol AND y.wend = b.confirmation_index AND y.off = x.off GROUP BY ALL"""
RK = "SELECT symbol, event_id, match_event_id, similarity, row_number() OVER (PARTITION BY symbol, event_id ORDER BY round(similarity, 9) DESC, position) AS match_rank FROM rm"


def matched_reversals(spark, sf_dir, threshold: float = THRESHOLD) -> DataFrame:
    z = wd.standardized(featured(spark, sf_dir), oc.EPISODE)
    return oc.reversal_matches(episodes(spark, sf_dir, threshold), z.select(*wd.KEYS, F.concat(*wd.FEATURES).alias("v")))


@query(build(f"SELECT symbol, event_id, match_event_id, match_rank, {r('similarity')} FROM rk WHERE match_rank <= 10", re=RE, rm=RM, rk=RK))
def reversal_matches(spark, sf_dir):
    """For every reversal the earlier ones of its direction whose 20 candles up to confirmation are most like its own."""
    return matched_reversals(spark, sf_dir).select("symbol", "event_id", "match_event_id", "match_rank", "similarity")


@query(build("SELECT e.symbol, e.confirmed_reversals, coalesce(m.matches, 0) AS same_direction_match_rows, coalesce(m.alike, 0) AS matches_similarity_75 FROM (SELECT symbol, count(*) AS confirmed_reversals FROM re GROUP BY symbol) e LEFT JOIN (SELECT symbol, count(*) AS matches, CAST(count_if(similarity >= 0.75) AS BIGINT) AS alike FROM rk WHERE match_rank <= 10 GROUP BY symbol) m USING (symbol)", re=RE, rm=RM, rk=RK))
def reversal_frequency(spark, sf_dir):
    found = matched_reversals(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("same_direction_match_rows"), F.count_if(F.col("similarity") >= 0.75).alias("matches_similarity_75"))
    return episodes(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("confirmed_reversals")).join(found, "symbol", "left").fillna(0)


# ------------------------------------------------------------------ windows


@query(build(f"SELECT symbol, timeframe, rank, wend - 19 AS candidate_start, wend AS candidate_end, {r('similarity')} FROM ranked WHERE rank <= 10"))
def knn_windows(spark, sf_dir):
    return wd.knn(featured(spark, sf_dir))


@query(build(" UNION ALL ".join(f"SELECT symbol, timeframe, wend AS candidate_end, '{x}' AS feature, round({x}, 6) AS rmse, round({w / sum(FEATURES.values())!r}, 6) AS weight, round({x} * {w / sum(FEATURES.values())!r}, 6) AS weighted_difference FROM ranked WHERE rank = 1" for x, w in FEATURES.items())))
def knn_feature_contrib(spark, sf_dir):
    return wd.contributions(featured(spark, sf_dir))


@query(build("SELECT symbol, timeframe, bin, count(*) AS windows, round(min(low + bin * width), 6) + 0.0 AS low, round(count(*) / any_value(total) / any_value(width), 6) AS density FROM (SELECT s.*, low, width, total, least(59, CAST(floor((similarity - low) / width) AS BIGINT)) AS bin FROM sim s JOIN (SELECT symbol, timeframe, min(similarity) AS low, (max(similarity) - min(similarity)) / 60 AS width, count(*)::DOUBLE AS total FROM sim GROUP BY ALL) USING (symbol, timeframe)) GROUP BY ALL"))
def knn_histogram(spark, sf_dir):
    return wd.histogram(wd.similarities(featured(spark, sf_dir)))


@query(build("SELECT symbol, timeframe, count(*) AS windows, round(max(similarity), 6) AS best, 100.0::DOUBLE AS percentile_of_best, " + ", ".join(f"round(quantile_cont(similarity, {q}), 6) AS {x}" for q, x in [(0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")]) + " FROM sim GROUP BY ALL"))
def knn_distribution(spark, sf_dir):
    return wd.distribution(featured(spark, sf_dir))


STATES = ["bullish", "bearish", "body", "range_level", "compression_75", "expansion_125", "upper_rejection", "lower_rejection", "alternation", "bull_first", "bull_second", "range_first", "range_second"]


@query(build(f"SELECT symbol, wend AS window_end, {r(*STATES)} FROM d_1h"))
def window_states(spark, sf_dir):
    return wd.described(featured(spark, sf_dir)).select("symbol", F.col("end").alias("window_end"), *STATES)


LABELLED = {"transition_profile": wd.profile, "micro_behaviour": wd.micro_behaviour, "archetype": wd.archetype, "pattern_code": wd.pattern_code, "regime": wd.regime, "transition_type": wd.transition_type}
MINI = {  # SQL of the labels, thresholds in the same order
    "transition_profile": "CASE WHEN bull_first <= 0.35 AND bull_second >= 0.65 THEN 'BEARISH_TO_BULLISH_SHIFT' WHEN bull_first >= 0.65 AND bull_second <= 0.35 THEN 'BULLISH_TO_BEARISH_SHIFT' WHEN abs(bull_first - 0.5) <= 0.2 AND abs(bull_second - 0.5) <= 0.2 AND compression_75 >= 0.3 THEN 'SIDEWAYS_LIKE' WHEN abs(bull_first - 0.5) <= 0.2 AND greatest(bull_second, 1 - bull_second) >= 0.65 AND range_second - range_first >= 0.15 THEN 'SIDEWAYS_TO_DIRECTIONAL_LIKE' WHEN range_second - range_first >= 0.2 THEN 'RANGE_EXPANSION_LIKE' WHEN range_second - range_first <= -0.2 THEN 'RANGE_COMPRESSION_LIKE' ELSE 'MIXED_SEQUENCE' END",
    "micro_behaviour": "CASE WHEN compression >= 0.55 AND abs(bullish - 0.5) <= 0.15 AND greatest(upper_rejection, lower_rejection) >= 0.35 THEN 'WICK_REJECTION_COMPRESSION' WHEN compression >= 0.55 AND abs(bullish - 0.5) <= 0.15 THEN 'BALANCED_COMPRESSION' WHEN compression >= 0.45 AND abs(bull_second - bull_first) >= 0.25 THEN 'DIRECTIONAL_COMPRESSION' WHEN expansion >= 0.35 AND range_second - range_first >= 0.1 THEN 'RANGE_EXPANSION' WHEN greatest(upper_rejection, lower_rejection) >= 0.45 AND abs(bullish - 0.5) <= 0.25 THEN 'REJECTION_BALANCE' WHEN bull_second - bull_first >= 0.25 AND range_second >= range_first THEN 'BULLISH_SHIFT' WHEN bull_second - bull_first <= -0.25 AND range_second >= range_first THEN 'BEARISH_SHIFT' WHEN bullish >= 0.7 AND alternation <= 0.35 AND body >= 0.6 THEN 'PERSISTENT_BULLISH_BODY' WHEN bullish <= 0.3 AND alternation <= 0.35 AND body >= 0.6 THEN 'PERSISTENT_BEARISH_BODY' WHEN alternation >= 0.55 THEN 'HIGH_ALTERNATION' WHEN body <= 0.25 THEN 'SMALL_BODY_MIX' ELSE 'MIXED_MICRO_BEHAVIOUR' END",
    "archetype": "CASE WHEN bull_second - bull_first >= 0.3 AND range_second - range_first >= 0.1 THEN 'BEARISH_TO_BULLISH_SHIFT' WHEN bull_second - bull_first <= -0.3 AND range_second - range_first >= 0.1 THEN 'BULLISH_TO_BEARISH_SHIFT' WHEN compression >= 0.55 AND abs(bullish - 0.5) <= 0.15 THEN 'SIDEWAYS_COMPRESSION' WHEN abs(bullish - 0.5) <= 0.2 AND greatest(bullish, 1 - bullish) >= 0.65 AND range_second - range_first >= 0.1 THEN 'SIDEWAYS_TO_DIRECTIONAL' WHEN expansion >= 0.35 AND range_second - range_first >= 0.1 THEN 'EXPANSION_SEQUENCE' WHEN compression >= 0.55 AND range_second - range_first <= -0.1 THEN 'COMPRESSION_SEQUENCE' WHEN either_rejection >= 0.45 AND abs(bullish - 0.5) <= 0.25 THEN 'REJECTION_MIX' WHEN bullish >= 0.7 AND alternation <= 0.35 THEN 'PERSISTENT_BULLISH_BODY' WHEN bullish <= 0.3 AND alternation <= 0.35 THEN 'PERSISTENT_BEARISH_BODY' WHEN alternation >= 0.55 THEN 'HIGH_ALTERNATION' ELSE 'MIXED_BEHAVIOUR' END",
    "pattern_code": "concat_ws(' | ', CASE WHEN 1 - 2 * abs(bullish - 0.5) >= 0.7 THEN 'BALANCED' WHEN bullish > 0.5 THEN 'BULL_BIASED' ELSE 'BEAR_BIASED' END, CASE WHEN range_second - range_first >= 0.2 THEN 'EXPANDING' WHEN range_second - range_first <= -0.2 THEN 'COMPRESSING' ELSE 'STABLE' END, CASE WHEN lower_rejection - upper_rejection >= 0.12 THEN 'LOWER_WICK' WHEN lower_rejection - upper_rejection <= -0.12 THEN 'UPPER_WICK' ELSE 'WICK_BALANCED' END, CASE WHEN bull_second - bull_first >= 0.2 THEN 'BULL_SHIFT' WHEN bull_second - bull_first <= -0.2 THEN 'BEAR_SHIFT' ELSE 'DIRECTION_BALANCED' END, CASE WHEN alternation >= 0.55 THEN 'HIGH_ALT' WHEN alternation <= 0.3 THEN 'LOW_ALT' ELSE 'MID_ALT' END, CASE WHEN body >= 0.6 THEN 'LARGE_BODY' WHEN body <= 0.25 THEN 'SMALL_BODY' ELSE 'MID_BODY' END, CASE WHEN range_last_third - range_first_third >= 0.35 THEN 'COMP_TO_EXPAND' WHEN range_last_third - range_first_third <= -0.35 THEN 'EXP_TO_COMPRESS' ELSE 'RANGE_STABLE' END, CASE WHEN close_location >= 0.65 THEN 'CLOSE_HIGH' WHEN close_location <= 0.35 THEN 'CLOSE_LOW' ELSE 'CLOSE_MID' END)",
    "regime": "CASE WHEN abs(direction_first) >= 0.2 AND abs(direction_second) >= 0.15 AND direction_first * direction_second < 0 AND (direction_second - direction_first) * direction_first < 0 THEN 'TREND_TO_OPPOSITE_DIRECTION' WHEN abs(direction_first) <= 0.15 AND abs(direction_second) >= 0.2 AND scaled_range_second - scaled_range_first >= 0.15 THEN 'SIDEWAYS_TO_DIRECTIONAL_EXPANSION' WHEN abs(direction_first) >= 0.2 AND abs(direction_second) <= 0.15 AND scaled_range_second - scaled_range_first < 0.1 THEN 'DIRECTIONAL_TO_SIDEWAYS' WHEN scaled_range_second - scaled_range_first >= 0.25 AND abs(direction_second) >= abs(direction_first) + 0.1 THEN 'COMPRESSION_TO_EXPANSION' WHEN scaled_range_second - scaled_range_first <= -0.25 AND abs(direction_second) <= abs(direction_first) + 0.05 THEN 'EXPANSION_TO_COMPRESSION' WHEN abs(direction_first) <= 0.15 AND abs(direction_second) <= 0.15 AND alternation_second >= alternation_first + 0.1 THEN 'SIDEWAYS_ALTERNATION_INCREASE' WHEN abs(direction_first - direction_second) < 0.15 AND abs(scaled_range_second - scaled_range_first) < 0.15 THEN 'STABLE_REGIME' ELSE 'MIXED_TRANSITION' END",
    "transition_type": "CASE WHEN abs(direction_first) >= 0.2 AND abs(direction_second) >= 0.15 AND direction_first * direction_second < 0 THEN 'OPPOSITE_DIRECTION_SHIFT' WHEN abs(direction_first) <= 0.15 AND abs(direction_second) >= 0.2 AND scaled_range_second - scaled_range_first >= 0.15 THEN 'SIDEWAYS_TO_DIRECTIONAL' WHEN abs(direction_first) >= 0.2 AND abs(direction_second) <= 0.15 THEN 'DIRECTIONAL_TO_SIDEWAYS' WHEN scaled_range_second - scaled_range_first >= 0.25 THEN 'COMPRESSION_TO_EXPANSION' WHEN scaled_range_second - scaled_range_first <= -0.25 THEN 'EXPANSION_TO_COMPRESSION' WHEN abs(direction_first - direction_second) < 0.15 AND abs(scaled_range_second - scaled_range_first) < 0.15 THEN 'STABLE' ELSE 'MIXED' END",
}
#: Regimes, their neighbours and clusters are of windows that end every so many candles, as in the reference.
REGIME_STEP = 10
for _name, _label in LABELLED.items():
    query(build(f"SELECT symbol, wend AS window_end, {MINI[_name]} AS {_name} FROM d_1h"), f"window_{_name}")(lambda spark, sf_dir, n=_name, f=_label: wd.described(featured(spark, sf_dir)).select("symbol", F.col("end").alias("window_end"), f().alias(n)))
    query(build(f"SELECT *, round(windows * 100.0::DOUBLE / sum(windows) OVER (PARTITION BY symbol), 6) AS share_pct FROM (SELECT symbol, {MINI[_name]} AS {_name}, count(*) AS windows FROM d_1h{' WHERE wend % 10 = 9' if _name == 'regime' else ''} GROUP BY ALL)"), f"{_name}_distribution")(
        lambda spark, sf_dir, n=_name, f=_label: wd.described(featured(spark, sf_dir)).where(f"(end - 19) % {REGIME_STEP} = 0" if n == "regime" else "true").groupBy("symbol", f().alias(n)).agg(F.count("*").alias("windows")).withColumn("share_pct", F.col("windows") * 100.0 / F.sum("windows").over(wd.Window.partitionBy("symbol")))
    )

BLOCK = "SELECT symbol, timeframe, wend, off, direction, rr, upper_wick_pct, lower_wick_pct, alternation, body_pct, close_location, ntile(5) OVER (PARTITION BY symbol ORDER BY off) AS block FROM w_1h WHERE wend = last"
BLOCKS = "SELECT symbol, wend, block, count(*) AS candles, avg((direction > 0)::DOUBLE) AS bullish, avg(rr) AS range_level, avg((upper_wick_pct >= 0.35)::DOUBLE) AS upper_rejection, avg((lower_wick_pct >= 0.35)::DOUBLE) AS lower_rejection, coalesce(avg(alternation) FILTER (off > begins), 0.0) AS alternation, avg(body_pct) AS body, avg(close_location) AS close_location FROM (SELECT *, min(off) OVER (PARTITION BY symbol, block) AS begins FROM bl) GROUP BY ALL"


@query(build(f"SELECT symbol, wend AS window_end, block, candles, {r('bullish', 'range_level', 'upper_rejection', 'lower_rejection', 'alternation', 'body', 'close_location')} FROM bs", bl=BLOCK, bs=BLOCKS))
def sequence_blocks(spark, sf_dir):
    return wd.blocks(featured(spark, sf_dir)).select("symbol", F.col("end").alias("window_end"), "block", "candles", "bullish", "range_level", "upper_rejection", "lower_rejection", "alternation", "body", "close_location")


@query(build("SELECT symbol, wend AS window_end, string_agg(CASE WHEN bullish >= 0.6 THEN 'BULL' WHEN bullish <= 0.4 THEN 'BEAR' ELSE 'BAL' END, ' -> ' ORDER BY block) AS direction_path, string_agg(CASE WHEN range_level >= 1.15 THEN 'EXP' WHEN range_level <= 0.85 THEN 'COMP' ELSE 'NORM' END, ' -> ' ORDER BY block) AS range_path FROM bs GROUP BY ALL", bl=BLOCK, bs=BLOCKS))
def sequence_paths(spark, sf_dir):
    return wd.block_paths(wd.blocks(featured(spark, sf_dir))).select("symbol", F.col("end").alias("window_end"), "direction_path", "range_path")


# ------------------------------------------------------------------ windows against windows of other kinds


CODES = {"direction_balance": "bullish - bearish", "alternation": "alternation", "body_level": "body", "body_shift": "body_second - body_first", "small_body_fraction": "small_body", "large_body_fraction": "large_body", "upper_rejection": "upper_rejection", "lower_rejection": "lower_rejection",
    "rejection_balance": "1 - abs(upper_rejection - lower_rejection)", "wick_bias": "lower_rejection - upper_rejection", "range_level": "range_level", "range_shift": "range_second - range_first", "compression_fraction": "compression", "expansion_fraction": "expansion", "expansion_transition": "range_last_third - range_first_third",
    "close_location": "close_location", "close_shift": "close_second - close_first", "direction_shift": "bull_second - bull_first", "first_third_alternation": "alternation_first_third", "last_third_alternation": "alternation_last_third", "bullish_fraction": "bullish", "bearish_fraction": "bearish", "middle_third_range": "range_middle_third"}


@query(build("SELECT symbol, wend AS window_end, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in CODES.items()) + " FROM d_1h"))
def window_fingerprint_components(spark, sf_dir):
    return wd.fingerprints(wd.described(featured(spark, sf_dir))).select("symbol", F.col("end").alias("window_end"), *wd.COMPONENTS)


@query()
def window_fingerprints(spark, sf_dir):
    return wd.fingerprints(wd.described(featured(spark, sf_dir))).select("symbol", F.col("end").alias("window_end"), "pattern_code", "fingerprint_id")


V23 = {"pool": f"SELECT * EXCLUDE (same) FROM (SELECT v.*, d.label, d.label = n.label AS same FROM v23 v JOIN (SELECT symbol, wend, {MINI['regime']} AS label FROM d_1h) d USING (symbol, wend) JOIN (SELECT symbol, {MINI['regime']} AS label FROM d_1h WHERE wend = last) n USING (symbol) WHERE wend <= last - 20 AND (wend - 19) % 10 = 0) QUALIFY same OR count_if(same) OVER (PARTITION BY symbol) < 3",
       "pool_now": "SELECT * FROM v23 WHERE wend = last"} | medians("pool", 23)


@query(build(f"SELECT symbol, timeframe, rank, wend AS window_end, label AS regime, {r('similarity')} FROM (SELECT *, exp(-23 * distance) AS similarity, row_number() OVER (PARTITION BY symbol ORDER BY round(exp(-23 * distance), 9) DESC, wend) AS rank FROM pool_d) WHERE rank <= 15", **V23))
def regime_knn(spark, sf_dir):
    """Windows of each series most like its last one by 23 measures, among those of its regime if there are three."""
    f = featured(spark, sf_dir)
    rows, cols = wd.vectors(f, 20, wd.REGIME)
    rows = rows.join(wd.described(f).select(*wd.KEYS, wd.regime().alias("regime")), wd.KEYS)
    now = rows.where("end = last")
    pool = rows.where(f"end <= last - 20 AND (end - 19) % {REGIME_STEP} = 0").join(now.select(*src.SERIES, F.col("regime").alias("_now")), src.SERIES)
    same = F.col("regime") == F.col("_now")
    pool = pool.withColumn("_enough", F.count_if(same).over(wd.Window.partitionBy(*src.SERIES)) >= 3).where(~F.col("_enough") | same).drop("_enough", "_now")
    found = wd.by_medians(pool, now, cols, factor=float(len(cols)))
    return wd.top(found, 15).select(*src.SERIES, "rank", F.col("end").alias("window_end"), "regime", "similarity")


# The parts of a match: ten candles before it, itself, ten after it, fewer at the series' ends; by a range join.
CX = {
    "cx_p": """SELECT m.symbol, m.rank, m.wend, m.similarity, p.part, greatest(CASE p.part WHEN 'before' THEN m.wend - 29 WHEN 'matched' THEN m.wend - 19 ELSE m.wend + 1 END, 0) AS a, least(CASE p.part WHEN 'before' THEN m.wend - 20 WHEN 'matched' THEN m.wend ELSE m.wend + 10 END, l.last) AS b
  FROM ranked m JOIN (SELECT symbol, max(idx) AS last FROM f_1h GROUP BY symbol) l USING (symbol) CROSS JOIN (VALUES ('before'), ('matched'), ('after')) p(part) WHERE m.rank <= 25""",
    "cx_f": "SELECT p.*, f.idx - p.a AS place, p.b - p.a + 1 AS n, f.direction, f.range_ratio * 5 AS rr, f.body_pct, f.upper_wick_pct, f.lower_wick_pct, f.alternation FROM cx_p p JOIN f_1h f ON f.symbol = p.symbol AND f.idx BETWEEN p.a AND p.b",
    "cx_d": """SELECT symbol, rank, part, avg((direction > 0)::DOUBLE) AS bullish, avg(rr) AS range_level, avg(alternation) FILTER (place > 0) AS alternation, avg(body_pct) AS body, avg((rr < 0.85)::DOUBLE) AS compression, avg((rr > 1.15)::DOUBLE) AS expansion,
    avg((upper_wick_pct >= 0.35)::DOUBLE) AS upper_rejection, avg((lower_wick_pct >= 0.35)::DOUBLE) AS lower_rejection, avg((upper_wick_pct >= 0.35 OR lower_wick_pct >= 0.35)::DOUBLE) AS either_rejection,
    avg((direction > 0)::DOUBLE) FILTER (place < greatest(n // 2, 1)) AS bull_first, avg((direction > 0)::DOUBLE) FILTER (place >= n - greatest(n // 2, 1)) AS bull_second, avg(rr) FILTER (place < greatest(n // 2, 1)) AS range_first, avg(rr) FILTER (place >= n - greatest(n // 2, 1)) AS range_second
  FROM cx_f GROUP BY ALL""",
    "cx": "SELECT p.symbol, p.rank, p.part, p.wend, p.similarity, d.bullish, d.range_level, d.alternation, "
    + ", ".join(f"CASE WHEN p.b < p.a THEN 'NONE' WHEN p.b = p.a THEN 'INSUFFICIENT_DATA' ELSE {MINI[x]} END AS {x}" for x in ("archetype", "micro_behaviour")) + " FROM cx_p p LEFT JOIN cx_d d USING (symbol, rank, part)",
}
SPAN = "symbol, rank, wend - 19 AS candidate_start, wend AS candidate_end, round(similarity, 6) AS similarity, "
OF_PART = lambda c, out=None: ", ".join((f"round(max({c}) FILTER (part = '{x}'), 6) + 0.0" if c in ("bullish", "range_level", "alternation") else f"max({c}) FILTER (part = '{x}')") + f" AS {x}_{out or c}" for x in ("before", "matched", "after"))


def match_contexts(spark, sf_dir, columns: list[str]) -> DataFrame:
    """The 25 windows most like each series' last one, with columns of what stands before, in and after them."""
    f = featured(spark, sf_dir)
    found = wd.top(wd.similarities(f), 25).select(*src.SERIES, "rank", (F.col("end") - 19).alias("start"), "end", "similarity")
    out = found.join(wd.context_row(wd.contexts(f, found), columns), [*src.SERIES, "start", "end"])
    return out.withColumnsRenamed({"start": "candidate_start", "end": "candidate_end"}).drop("timeframe")


@query(build(f"SELECT {SPAN}{OF_PART('archetype')}, {OF_PART('micro_behaviour')}, {OF_PART('bullish')}, {OF_PART('range_level', 'range')} FROM cx GROUP BY symbol, rank, wend, similarity", **CX))
def match_transitions(spark, sf_dir):
    """How each match and the ten candles on either side of it are labelled."""
    out = match_contexts(spark, sf_dir, ["archetype", "micro_behaviour", "bullish", "range_level"])
    return out.withColumnsRenamed({f"{x}_range_level": f"{x}_range" for x in ("before", "matched", "after")})


@query(build(f"SELECT * REPLACE (coalesce(before_bullish, 0.0) AS before_bullish) FROM (SELECT {SPAN}{OF_PART('bullish')}, {OF_PART('range_level', 'range')}, {OF_PART('alternation')}, {OF_PART('archetype')} FROM cx GROUP BY symbol, rank, wend, similarity)", **CX))
def neighbour_context(spark, sf_dir):
    """Measures of each match and the ten candles on either side of it. Without candles before it the bullish share there is 0, after it null."""
    out = match_contexts(spark, sf_dir, ["bullish", "range_level", "alternation", "archetype"])
    return out.withColumnsRenamed({f"{x}_range_level": f"{x}_range" for x in ("before", "matched", "after")}).withColumn("before_bullish", F.coalesce("before_bullish", F.lit(0.0)))


# Windows of up to eight candles on either side of a pivot, each scaled by its own medians.
RADIUS = 8


def centred_sql(places: str) -> dict[str, str]:
    """CTEs from places (symbol, key, a, b), the bounds of windows: ctz has their scaled features by place."""
    return {
        "ct": places, "ctw": "SELECT t.symbol, t.key, f.idx - t.a AS place, " + ", ".join(f"f.{x}" for x in FEATURES) + " FROM ct t JOIN f_1h f ON f.symbol = t.symbol AND f.idx BETWEEN t.a AND t.b",
        "ctm": "SELECT symbol, key, count(*) AS n, " + ", ".join(f"median({x}) AS m_{x}" for x in FEATURES) + " FROM ctw GROUP BY ALL",
        "cts": "SELECT symbol, key, " + ", ".join(f"median(abs({x} - m_{x})) * 1.4826 AS s_{x}" for x in FEATURES) + " FROM ctw JOIN ctm USING (symbol, key) GROUP BY ALL",
        "ctz": "SELECT symbol, key, place, n, " + ", ".join(f"({x} - m_{x}) / CASE WHEN s_{x} < 1e-6 THEN 1.0 ELSE s_{x} END AS {x}" for x in FEATURES) + " FROM ctw JOIN ctm USING (symbol, key) JOIN cts USING (symbol, key)",
    }


ALIKE = "exp(-(" + " + ".join(f"sqrt(avg(pow(a.{x} - b.{x}, 2))) * {w / sum(FEATURES.values())!r}" for x, w in FEATURES.items()) + "))"
CENTRE = f"SELECT p.symbol, p.index AS centre, greatest(p.index - {RADIUS}, 0) AS a, least(p.index + {RADIUS}, l.last) AS b FROM pivots p JOIN last_pivot t ON t.symbol = p.symbol AND t.target = p.position JOIN (SELECT symbol, max(idx) AS last FROM c_1h GROUP BY symbol) l ON l.symbol = p.symbol"
BEST5 = "SELECT p.symbol, p.rank, p.similarity, p.candidate_end_index, p.pivot_type_sequence FROM pairs_top p JOIN last_pivot USING (symbol, target) WHERE p.rank <= 5"


def last_pivots(pivots: DataFrame) -> DataFrame:
    return pivots.groupBy(*src.SERIES).agg(F.max("position").alias("end_position"), F.max_by("index", "position").alias("centre"))


@query(build(f"SELECT m.symbol, m.rank AS structural_rank, round(m.similarity, 6) AS structural_similarity, round(s.candle_similarity, 6) AS candle_similarity, m.candidate_end_index AS candle_end, m.pivot_type_sequence FROM b5 m LEFT JOIN (SELECT b.symbol, b.key, {ALIKE} AS candle_similarity FROM ctz a JOIN ctz b ON a.symbol = b.symbol AND a.place = b.place AND a.n = b.n JOIN cc ON cc.symbol = a.symbol AND cc.centre = a.key GROUP BY ALL) s ON s.symbol = m.symbol AND s.key = m.candidate_end_index",
    cc=CENTRE, b5=BEST5, **centred_sql(f"SELECT symbol, centre AS key, a, b FROM cc UNION SELECT m.symbol, m.candidate_end_index, greatest(m.candidate_end_index - {RADIUS}, 0), least(m.candidate_end_index + {RADIUS}, l.last) FROM b5 m JOIN (SELECT symbol, max(idx) AS last FROM c_1h GROUP BY symbol) l USING (symbol)")))
def structural_candle_compare(spark, sf_dir):
    """The five runs of pivots most like the last one, with the likeness of the candles around their last pivots to those around the last of all."""
    pivots, f = st.structure(turns(spark, sf_dir)), featured(spark, sf_dir)
    now = last_pivots(pivots)
    found = st.match_structures(pivots, now, top_k=5, scales=SCALES).withColumn("centre", F.col("candidate_end_index"))
    w = wd.centred(f, found.select(*src.SERIES, "centre").unionByName(now.select(*src.SERIES, "centre")), RADIUS)
    own = now.join(w, [*src.SERIES, "centre"]).select(*src.SERIES, *(F.col(c).alias(f"_c_{c}") for c in FEATURES))
    out = found.join(w, [*src.SERIES, "centre"]).join(own, src.SERIES)
    return out.select("symbol", F.col("rank").alias("structural_rank"), F.col("similarity").alias("structural_similarity"), wd.likeness().alias("candle_similarity"), F.col("centre").alias("candle_end"), "pivot_type_sequence")


@query(build(f"SELECT * FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY round(similarity, 9) DESC, key) AS rank, key - n + 1 AS candidate_start, key AS candidate_end, round(similarity, 6) AS similarity FROM (SELECT b.symbol, b.key, b.n, {ALIKE} AS similarity FROM ctz a JOIN ctz b ON a.symbol = b.symbol AND a.place = b.place AND a.key = -1 AND b.key >= 0 GROUP BY ALL)) WHERE rank <= 5",
    cc=CENTRE, **centred_sql(f"SELECT symbol, CAST(-1 AS BIGINT) AS key, a, b FROM cc UNION ALL SELECT c.symbol, c.idx, c.idx - (cc.b - cc.a), c.idx FROM c_1h c JOIN cc USING (symbol) WHERE c.idx BETWEEN {RADIUS} AND greatest({RADIUS}, cc.centre - {2 * RADIUS}) AND c.idx - (cc.b - cc.a) >= 0 AND c.idx < cc.a")))
def centred_candle_matches(spark, sf_dir):
    """The five earlier windows whose candles are most like those around each series' last pivot."""
    found = wd.compared_to_centre(featured(spark, sf_dir), last_pivots(st.structure(turns(spark, sf_dir))), RADIUS)
    return wd.top(found, 5).select("symbol", "rank", F.col("start").alias("candidate_start"), F.col("end").alias("candidate_end"), "similarity")


# ------------------------------------------------------------------ timeframes
# All events are one symbol here, in eight timeframes.

TFS = ("1h", "4h", "1d")
STEP = "CASE timeframe " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in src.STEPS.items()) + " END"


def featured_all(spark, sf_dir, candles: DataFrame | None = None) -> DataFrame:
    return src.in_blocks(src.all_series(spark, sf_dir) if candles is None else candles, ft.candle_features, ft.REACH)


@query(build(f"SELECT {BAR.format(step=STEP)} FROM bars_all"))
def candles_all_timeframes(spark, sf_dir):
    return src.all_series(spark, sf_dir).select(*src.COLUMNS)


NOW = f"SELECT symbol, timeframe, {STEP} AS step, {', '.join(mt.HALVES)}, {MINI['transition_type']} AS transition_type FROM d_all WHERE wend = last"


def mtf_now(spark, sf_dir) -> DataFrame:
    return mt.current(wd.described(featured_all(spark, sf_dir)))


@query(build(f"SELECT symbol, timeframe, transition_type, {r(*mt.HALVES)} FROM nw", nw=NOW))
def mtf_current(spark, sf_dir):
    return mtf_now(spark, sf_dir)


@query(build("SELECT a.symbol, a.timeframe AS low_timeframe, b.timeframe AS high_timeframe, round(a.direction_second - b.direction_second, 6) + 0.0 AS direction_difference, round(a.scaled_range_second - b.scaled_range_second, 6) + 0.0 AS range_difference, round((a.scaled_range_second - a.scaled_range_first) - (b.scaled_range_second - b.scaled_range_first), 6) + 0.0 AS range_shift_difference, a.transition_type AS low_transition_type, b.transition_type AS high_transition_type FROM nw a JOIN nw b ON a.symbol = b.symbol AND a.step < b.step", nw=NOW))
def mtf_pairs(spark, sf_dir):
    return mt.pairs(mtf_now(spark, sf_dir))


@query(build("""SELECT symbol, concat_ws(' | ', CASE WHEN d <= 0.2 THEN 'DIRECTION_ALIGNED' WHEN d >= 0.5 THEN 'DIRECTION_DIVERGENT' ELSE 'DIRECTION_MIXED' END, CASE WHEN g <= 0.25 THEN 'RANGE_ALIGNED' WHEN g >= 0.75 THEN 'RANGE_DIVERGENT' ELSE 'RANGE_MIXED' END,
  CASE WHEN a THEN 'EXPANSION_CONTEXT_PRESENT' WHEN b THEN 'COOLING_CONTEXT_PRESENT' WHEN c THEN 'DIRECTION_SHIFT_PRESENT' ELSE 'NO_MAJOR_CROSS_TF_SHIFT' END) AS relationship
  FROM (SELECT symbol, max(direction_second) - min(direction_second) AS d, max(scaled_range_second) - min(scaled_range_second) AS g, bool_or(transition_type IN ('SIDEWAYS_TO_DIRECTIONAL', 'COMPRESSION_TO_EXPANSION')) AS a, bool_or(transition_type IN ('DIRECTIONAL_TO_SIDEWAYS', 'EXPANSION_TO_COMPRESSION')) AS b, bool_or(transition_type = 'OPPOSITE_DIRECTION_SHIFT') AS c FROM nw GROUP BY symbol)""", nw=NOW))
def mtf_relationship(spark, sf_dir):
    return mt.relationship(mtf_now(spark, sf_dir))


@query(build(f"SELECT d.symbol, d.timeframe, c.candles AS candles_available, round(s.best, 6) AS best_similarity, {r(*(f'd.{x}' for x in STATES)).replace('AS d.', 'AS ')}, {MINI['transition_profile']} AS transition_profile FROM d_all d JOIN (SELECT symbol, timeframe, count(*) AS candles FROM c_all GROUP BY ALL) c USING (symbol, timeframe) LEFT JOIN (SELECT symbol, timeframe, max(similarity) AS best FROM sim_all GROUP BY ALL) s USING (symbol, timeframe) WHERE d.wend = d.last"))
def mtf_analysis(spark, sf_dir):
    """Each timeframe's last window described, with the similarity of its nearest earlier one."""
    f = featured_all(spark, sf_dir)
    now = wd.described(f).where("end = last").select(*src.SERIES, (F.col("last") + 1).cast("long").alias("candles_available"), *STATES, wd.profile().alias("transition_profile"))
    return now.join(wd.similarities(f).groupBy(*src.SERIES).agg(F.max("similarity").alias("best_similarity")), src.SERIES, "left")


WINDOWS = {"wa": f"SELECT v.symbol, v.timeframe, v.wend, c.open_time + {STEP.replace('CASE timeframe', 'CASE v.timeframe')} AS close_ts, exp(-v.distance) AS similarity FROM v19_d v JOIN c_all c ON c.symbol = v.symbol AND c.timeframe = v.timeframe AND c.idx = v.wend", "v19_now": "SELECT * FROM v19 WHERE wend = last"} | medians("v19", 19)


def compared_all(spark, sf_dir, candles: DataFrame | None = None) -> DataFrame:
    """Every window of every timeframe with its close and its similarity to the current one by 19 measures. Windows are described once, and compared once."""
    with scratch(spark) as keep:
        rows, cols = wd.vectors(featured_all(spark, sf_dir, candles), 20, wd.HISTORY, {"close_ts": mt.closes()})
        rows = written(rows, "windows")
        return keep(written(wd.by_medians(rows, rows.where("end = last"), cols).select(*wd.KEYS, "close_ts", "similarity"), "compared"))


def overlap_sql(tfs) -> str:
    return f"SELECT symbol, max(a) AS common_start, min(b) AS common_end, count(*) AS timeframes FROM (SELECT symbol, timeframe, min(close_ts) AS a, max(close_ts) AS b FROM wa WHERE timeframe IN ({', '.join(repr(x) for x in tfs)}) GROUP BY ALL) GROUP BY symbol"


@query(build("SELECT * FROM ov", **WINDOWS, ov=overlap_sql(src.STEPS)))
def mtf_overlap(spark, sf_dir):
    return mt.overlap(compared_all(spark, sf_dir))


def synced_sql(mode: str) -> dict[str, str]:
    tfs, _ = mt.MODES[mode]
    return {"ov": overlap_sql(tfs), "rf": f"SELECT w.symbol, w.close_ts FROM wa w JOIN ov USING (symbol) WHERE w.timeframe = '{mode}' AND w.close_ts BETWEEN common_start AND common_end AND w.close_ts <> (SELECT max(close_ts) FROM wa x WHERE x.symbol = w.symbol AND x.timeframe = '{mode}')",
            "sy": f"SELECT w.* FROM wa w JOIN rf USING (symbol, close_ts) WHERE w.timeframe IN ({', '.join(repr(x) for x in tfs)}) QUALIFY count(*) OVER (PARTITION BY symbol, close_ts) = {len(tfs)}"}


for _mode in mt.MODES:
    _tfs = mt.MODES[_mode][0]
    query(build(f"SELECT symbol, close_ts AS reference_timestamp, rank, {', '.join(f'round(s_{x}, 6) AS similarity_{x}' for x in _tfs)}, round(combined, 6) AS combined_similarity FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(combined, 9) DESC, close_ts) AS rank FROM (SELECT symbol, close_ts, {', '.join(f"max(similarity) FILTER (timeframe = '{x}') AS s_{x}" for x in _tfs)}, ({' + '.join(f"max(similarity) FILTER (timeframe = '{x}')" for x in _tfs)}) / {len(_tfs)} AS combined FROM sy GROUP BY ALL)) WHERE rank <= 25", **WINDOWS, **synced_sql(_mode)), f"mtf_history_{_mode}")(
        lambda spark, sf_dir, mode=_mode: mt.history(compared_all(spark, sf_dir), mode)
    )


def closes(spark, sf_dir, tf: str) -> DataFrame:
    return src.series(spark, sf_dir, tf).select("symbol", (F.col("open_time") + src.STEPS[tf]).alias("close_ts"), F.col("close").alias(f"close_{tf}"))


CLOSES = {f"cl_{tf}": f"SELECT symbol, open_time + {src.STEPS[tf]} AS close_ts, close AS close_{tf} FROM bars_{tf}" for tf in TFS}


@query(build(f"SELECT symbol, close_ts, {r('close_1h', 'close_4h', 'close_1d')} FROM cl_1h JOIN cl_4h USING (symbol, close_ts) JOIN cl_1d USING (symbol, close_ts)", **CLOSES))
def mtf_exact_history(spark, sf_dir):
    return mt.exact([closes(spark, sf_dir, tf) for tf in TFS], ["symbol", "close_ts"])


@query(build(f"SELECT a.symbol, a.close_ts, {r('a.close_1h').replace('AS a.close_1h', 'AS close_1h')}, round(b.close_1d, 6) + 0.0 AS asof_close_1d FROM cl_1h a ASOF JOIN cl_1d b ON a.symbol = b.symbol AND a.close_ts >= b.close_ts", **CLOSES))
def mtf_asof_context(spark, sf_dir):
    return mt.asof(closes(spark, sf_dir, "1h"), closes(spark, sf_dir, "1d"), "close_ts", "symbol", ["close_1d"])


# ------------------------------------------------------------------ levels and stories

# Interactions with earlier candles of the window, by joins: what each earlier candle offers, the nearest of it, and flags of each touch.
PL = {
    "pl_b": """SELECT *, avg(direction) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent, median(raw_range) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS usual, lead(raw_range) OVER w AS next_range
  FROM w_1h WINDOW w AS (PARTITION BY symbol, wend ORDER BY off)""",
    "pl_n": """SELECT a.*, b.off AS source, k.ord, [b.high, b.low, (greatest(b.open, b.close) + least(b.open, b.close)) / 2][k.ord + 1] AS level, greatest(b.raw_range * 0.2, 1e-12) AS tol
  FROM pl_b a JOIN pl_b b ON a.symbol = b.symbol AND a.wend = b.wend AND b.off < a.off CROSS JOIN (SELECT unnest([0, 1, 2]) AS ord) k
  WHERE least(abs(a.high - level), abs(a.low - level), abs(a.close - level)) / tol <= 1
  QUALIFY row_number() OVER (PARTITION BY a.symbol, a.wend, a.off ORDER BY least(abs(a.high - level), abs(a.low - level), abs(a.close - level)) / tol, b.off, k.ord) = 1""",
    "pl_f": """SELECT *, ['PRIOR_HIGH', 'PRIOR_LOW', 'PRIOR_BODY'][ord + 1] AS level_type, ord = 0 AND close > level AS above, ord = 1 AND close < level AS below, ord = 0 AND close <= level OR ord = 1 AND close >= level AS hold,
    ord = 0 AND (high - greatest(open, close)) / raw_range >= 0.35 AND close < level OR ord = 1 AND (least(open, close) - low) / raw_range >= 0.35 AND close > level AS rejection,
    sign(recent) <> 0 AND direction <> 0 AND direction <> sign(recent) AS pullback, coalesce(next_range > usual * 1.25, false) AS grew
  FROM pl_n WHERE low <= level AND level <= high OR abs(close - level) <= tol""",
    "pl": """SELECT e.*, EXISTS (SELECT 1 FROM pl_f p WHERE p.symbol = e.symbol AND p.wend = e.wend AND p.off < e.off AND abs(e.level - p.level) <= e.tol) AS again,
    CASE WHEN pullback THEN 'PULLBACK_TO_PRIOR_LEVEL' WHEN rejection THEN 'REJECTION_AT_PRIOR_LEVEL' WHEN above THEN 'BREAK_ABOVE_PRIOR_HIGH' WHEN below THEN 'BREAK_BELOW_PRIOR_LOW' ELSE 'LEVEL_REVISIT' END AS event FROM pl_f e""",
    "pl_t": """SELECT symbol, wend, avg(direction) FILTER (off < 6) AS direction_first_third, avg(direction) FILTER (off >= 14) AS direction_last_third, avg(raw_range) FILTER (off < 6) AS range_first_third, avg(raw_range) FILTER (off >= 14) AS range_last_third FROM w_1h GROUP BY ALL""",
    "pl_c": """SELECT symbol, wend, count(*) AS interaction_count, min(off) AS first_off, max(off) AS last_off, count_if(above OR below) AS break_count, count_if(hold) AS hold_count, count_if(rejection) AS rejection_count, count_if(pullback) AS pullback_count,
    count_if(again) AS repeated_level_hits, count_if(grew) AS reaction_expansion_count, string_agg(level_type, ' -> ' ORDER BY off) AS interaction_level_types FROM pl GROUP BY ALL""",
    "pl_w": """SELECT symbol, wend, coalesce(interaction_count, 0) AS interaction_count, coalesce(wend - 19 + first_off, -1) AS first_interaction_index, coalesce(wend - 19 + last_off, -1) AS last_interaction_index, """
    + ", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("break_count", "hold_count", "rejection_count", "pullback_count", "repeated_level_hits", "reaction_expansion_count"))
    + """, coalesce(interaction_level_types, 'NONE') AS interaction_level_types, direction_first_third, direction_last_third, direction_last_third - direction_first_third AS direction_shift, range_first_third, range_last_third, range_last_third - range_first_third AS range_shift,
    CASE WHEN interaction_count IS NULL THEN 'NO_PRIOR_LEVEL_INTERACTION' ELSE concat_ws(' -> ', 'PRIOR_LEVEL_INTERACTION', CASE WHEN pullback_count > 0 THEN 'PULLBACK_PRESENT' END, CASE WHEN rejection_count > 0 THEN 'REJECTION_PRESENT' END, CASE WHEN break_count > 0 THEN 'LEVEL_BREAK_PRESENT' END,
      CASE WHEN hold_count > 0 THEN 'LEVEL_HOLD_PRESENT' END, CASE WHEN repeated_level_hits > 0 THEN 'REPEATED_LEVEL_TEST' END, CASE WHEN reaction_expansion_count > 0 THEN 'POST_INTERACTION_EXPANSION' END) END AS story FROM pl_t LEFT JOIN pl_c USING (symbol, wend)""",
}
PL_FIELDS = ", ".join(r(x) if x.endswith(("third", "shift")) else x for x in lv.PRIOR_FIELDS)


def prior_interactions(spark, sf_dir) -> DataFrame:
    return lv.prior_interactions(anatomy(src.series(spark, sf_dir)))


@query(build(f"SELECT symbol, off, source, level_type, event, {r('level')} FROM pl WHERE wend = last", **PL))
def price_levels_v1(spark, sf_dir):
    """What each candle of a series' last window does at the level of an earlier one."""
    return prior_interactions(spark, sf_dir).where("end = last").select("symbol", F.inline("events")).select("symbol", "off", "source", "level_type", "event", "level")


@query(build(f"SELECT symbol, wend AS window_end, {PL_FIELDS} FROM pl_w", **PL))
def prior_level_interactions(spark, sf_dir):
    """Every window's interactions with the levels of its own earlier candles."""
    return prior_interactions(spark, sf_dir).select("symbol", F.col("end").alias("window_end"), *lv.PRIOR_FIELDS)


@query(build(f"SELECT symbol, rank, wend - 19 AS candidate_start, wend AS candidate_end, a.open_time, b.open_time + 3600000 - 1 AS close_time, {r('similarity')}, {PL_FIELDS} FROM (SELECT symbol, rank, wend, similarity FROM ranked WHERE rank <= 25) JOIN pl_w USING (symbol, wend) JOIN (SELECT symbol, idx + 19 AS wend, open_time FROM c_1h) a USING (symbol, wend) JOIN (SELECT symbol, idx AS wend, open_time FROM c_1h) b USING (symbol, wend)", **PL))
def prior_level_matches(spark, sf_dir):
    """The interactions of the 25 windows most like each series' last one."""
    found = wd.top(wd.similarities(featured(spark, sf_dir)), 25).select(*wd.KEYS, "rank", "similarity")
    times = src.series(spark, sf_dir).select(*src.SERIES, "idx", "open_time", "close_time")
    begun = times.select(*src.SERIES, (F.col("idx") + 19).alias("end"), "open_time")
    out = found.join(prior_interactions(spark, sf_dir), wd.KEYS).join(begun, wd.KEYS).join(times.select(*src.SERIES, F.col("idx").alias("end"), "close_time"), wd.KEYS)
    return out.select("symbol", "rank", (F.col("end") - 19).alias("candidate_start"), F.col("end").alias("candidate_end"), "open_time", "close_time", "similarity", *lv.PRIOR_FIELDS)


LEVELS = ["prior_high", "prior_low", "prior_body_high", "prior_body_low", "current_high", "current_low", "current_close"]


@query(build(f"SELECT symbol, rank, candidate_end, off AS local_index, open_time, {r(*LEVELS)} FROM (SELECT w.symbol, m.rank, w.wend AS candidate_end, w.off, w.open_time, lag(w.high) OVER s AS prior_high, lag(w.low) OVER s AS prior_low, greatest(lag(w.open) OVER s, lag(w.close) OVER s) AS prior_body_high, least(lag(w.open) OVER s, lag(w.close) OVER s) AS prior_body_low, w.high AS current_high, w.low AS current_low, w.close AS current_close FROM w_1h w JOIN (SELECT symbol, wend, rank FROM ranked WHERE rank <= 25) m USING (symbol, wend) WINDOW s AS (PARTITION BY w.symbol, w.wend ORDER BY w.off)) WHERE off > 0"))
def prior_level_table(spark, sf_dir):
    """The levels that each candle of those windows takes from the one before it."""
    found = wd.top(wd.similarities(featured(spark, sf_dir)), 25).select(*wd.KEYS, "rank")
    out = lv.level_table(src.series(spark, sf_dir), found)
    return out.select("symbol", "rank", F.col("end").alias("candidate_end"), F.col("off").alias("local_index"), "open_time", *LEVELS)


def anatomy(candles: DataFrame) -> DataFrame:
    return src.in_blocks(candles, lambda c: ft.raw_anatomy(ft.candle_features(c)), ft.REACH)


def analysed(candles: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Levels and stories of every window of indexed candles, or of those in keys, the last of each series among them. For these only the candles that they look at are described."""
    return told_of(anatomy(candles if keys is None else wd.seen_from(candles, keys, ft.REACH + 19)), keys)


def told_of(described: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    windows = lv.windows_of(described)
    return sr.told(lv.level_rows(windows if keys is None else windows.join(keys, wd.KEYS, "left_semi")))


@query()
def price_levels_v2(spark, sf_dir):
    return analysed(src.series(spark, sf_dir)).select("symbol", "end", *lv.STORY_FEATURES, "level_story")


@query()
def level_events(spark, sf_dir):
    return lv.level_events(analysed(src.series(spark, sf_dir))).drop("timeframe")


@query()
def story_tokens(spark, sf_dir):
    return analysed(src.series(spark, sf_dir)).select("symbol", "end", sr.story(F.col("tokens")).alias("story"), F.size("events").alias("story_event_count"), F.size("tokens").alias("story_phase_count"))


POOL = 100


def screened(described: DataFrame) -> DataFrame:
    """Every window but the current one with its similarity to that by 22 half means in units of price."""
    rows, cols = wd.vectors(described, 20, wd.SCREEN)
    return wd.by_quartiles(rows, cols, F.col("end") == F.col("last")).select(*wd.KEYS, "last", "similarity")


@query()
def story_matches(spark, sf_dir):
    """Coarse ranking of all windows first; stories and level features only for the pool that it leaves. The candles are described once."""
    with scratch(spark) as keep:
        described = keep(written(anatomy(src.series(spark, sf_dir)), "described"))
        pool = keep(written(wd.top(screened(described), POOL).select(*wd.KEYS, "last", F.col("similarity").alias("screen_similarity")), "pool"))
    keys = pool.select(*wd.KEYS).unionByName(pool.select(*src.SERIES, F.col("last").alias("end")).distinct())
    told = told_of(described, keys)
    own = told.where("end = last").select(*src.SERIES, F.col("tokens").alias("own"), *(F.col(c).alias(f"own_{c}") for c in lv.STORY_FEATURES))
    both = pool.drop("last").join(told, wd.KEYS).join(own, src.SERIES)
    both = both.withColumns({"sequence_similarity": sr.story_similarity("own", "tokens"), "feature_similarity": sr.feature_similarity(lv.STORY_FEATURES)})
    both = both.withColumn("similarity", 0.75 * F.col("sequence_similarity") + 0.25 * F.col("feature_similarity"))
    return wd.top(both, 25).select("symbol", "rank", "end", sr.story(F.col("tokens")).alias("story"), "sequence_similarity", "feature_similarity", "screen_similarity", "similarity")


def current_all(spark, sf_dir) -> DataFrame:
    """The last window of each of the eight timeframes with its levels and story."""
    candles = written(src.all_series(spark, sf_dir), "candles")
    last = candles.groupBy(*src.SERIES).agg(F.max("idx").alias("end"))
    return analysed(candles, last)


@query()
def story_current(spark, sf_dir):
    return current_all(spark, sf_dir).select(*src.SERIES, sr.story(F.col("tokens")).alias("story"), F.array_join(sr.families(F.col("tokens")), " -> ").alias("family_story"), sr.explained(F.col("tokens")).alias("explained"), "level_story", lv.explained_levels().alias("levels_explained"))


@query()
def story_cross_summary(spark, sf_dir):
    return sr.cross_summary(current_all(spark, sf_dir), mt.step_of(F.col("timeframe"))).drop("wider", "tighter")


@query()
def story_family_alignment(spark, sf_dir):
    """How far the current stories of each two timeframes agree."""
    now = current_all(spark, sf_dir).select(*src.SERIES, mt.step_of(F.col("timeframe")).alias("step"), sr.families(F.col("tokens")).alias("f"))
    side = lambda k: now.select("symbol", *(F.col(c).alias(f"{c}_{k}") for c in ("timeframe", "step", "f")))
    both = side("a").join(side("b"), "symbol").where("step_a < step_b").withColumn("alignment_score", sr.alignment(F.col("f_a"), F.col("f_b")))
    return both.select("symbol", "timeframe_a", "timeframe_b", "alignment_score", sr.aligned(F.col("alignment_score")).alias("relationship"))


@query()
def story_family_matrix(spark, sf_dir):
    """The transitions of the current stories' families, and the timeframes that have them."""
    now = current_all(spark, sf_dir).select(*src.SERIES, sr.families(F.col("tokens")).alias("tokens"))
    out = sr.transitions(now).groupBy("symbol", "from_token", "to_token").pivot("timeframe", mt.ALL).agg(F.lit(1))
    marks = [F.coalesce(F.col(tf), F.lit(0)).alias(f"in_{tf}") for tf in mt.ALL]
    return out.select("symbol", "from_token", "to_token", *marks, sum((F.coalesce(F.col(tf), F.lit(0)) for tf in mt.ALL), F.lit(0)).alias("timeframes"), F.array_join(F.array_compact(F.array(*(F.when(F.col(tf) == 1, tf) for tf in mt.ALL))), ",").alias("names"))


def replayed(spark, sf_dir, mode: str) -> DataFrame:
    """Each reference time with, for each timeframe, its window's story, family story and their similarity to the current; screen_rank: its place by candles alone."""
    with scratch(spark) as keep:
        candles = written(src.all_series(spark, sf_dir), "candles")
        at = written(mt.synchronized(compared_all(spark, sf_dir, candles), mode), "synchronized")
        exact_only = at.where("synchronization = 'EXACT'").groupBy("symbol", "reference_timestamp").agg(F.avg("similarity").alias("candle_similarity"))
        place = F.row_number().over(wd.Window.partitionBy("symbol").orderBy(F.desc(F.round("candle_similarity", 9)), "reference_timestamp"))
        at = written(at.drop("close_ts").join(exact_only.withColumn("screen_rank", place), ["symbol", "reference_timestamp"]), "replayed")
        last = candles.groupBy(*src.SERIES).agg(F.max("idx").alias("end"))
        told = analysed(candles, at.select(*wd.KEYS).unionByName(last.select(*wd.KEYS)).distinct())
        told = written(told.select(*wd.KEYS, "last", "tokens", sr.families(F.col("tokens")).alias("family")), "told")
        now = told.where("end = last").select(*src.SERIES, F.col("family").alias("own"))
        out = at.join(told.drop("last"), wd.KEYS).join(now, src.SERIES).withColumn("story_similarity", sr.family_similarity("own", "family"))
        return keep(written(out, "replays"))


def replay_matches(rows: DataFrame, mode: str, top_k: int = 25) -> DataFrame:
    """Reference times of replayed rows by .6 candle and .4 story similarity of the exact timeframes, with the family stories of all."""
    tfs = [*mt.MODES[mode][0], *mt.MODES[mode][1]]
    story = F.avg(F.when(F.col("synchronization") == "EXACT", F.col("story_similarity"))).alias("story_similarity")
    out = rows.groupBy("symbol", "reference_timestamp", "screen_rank", "candle_similarity").agg(story, *(F.max(F.when(F.col("timeframe") == tf, F.col("family"))).alias(f"story_{tf}") for tf in tfs))
    out = out.withColumn("combined_similarity", 0.60 * F.col("candle_similarity") + 0.40 * F.col("story_similarity"))
    return wd.top(out, top_k, ["symbol"], "combined_similarity", "screen_rank")


def told_rows(matches: DataFrame) -> DataFrame:
    return matches.select(*(F.array_join(c, " -> ").alias(c) if t == "array<string>" else F.col(c) for c, t in matches.dtypes))


for _mode in mt.MODES:
    query(name=f"story_history_{_mode}")(lambda spark, sf_dir, mode=_mode: told_rows(replay_matches(replayed(spark, sf_dir, mode), mode)))


@query()
def story_history_heat(spark, sf_dir):
    """Story similarity of each timeframe at the reference times of story_history_1h."""
    rows = replayed(spark, sf_dir, "1h")
    kept = replay_matches(rows, "1h").select("symbol", "reference_timestamp")
    rows = rows.join(kept, ["symbol", "reference_timestamp"], "left_semi")
    out = rows.groupBy("symbol", "reference_timestamp").pivot("timeframe", mt.ALL).agg(F.avg("story_similarity"))
    return out.select("symbol", "reference_timestamp", *(F.col(tf).alias(f"story_similarity_{tf}") for tf in mt.ALL))


TOLD_TFS = [f"story_{tf}" for tf in mt.ALL]


def archetypes(spark, sf_dir) -> DataFrame:
    return sr.leader_clusters(replay_matches(replayed(spark, sf_dir, "1h"), "1h"), "rank", "symbol", TOLD_TFS)


@query()
def story_archetypes(spark, sf_dir):
    """The archetype of each of the best reference times; the first of each leads it, and is its representative."""
    return told_rows(archetypes(spark, sf_dir).withColumn("archetype", sr.archetype_name(F.col("cluster"))))


@query()
def archetype_summary(spark, sf_dir):
    return sr.archetype_summary(archetypes(spark, sf_dir), "symbol", "rank")


@query()
def archetype_transitions(spark, sf_dir):
    return sr.archetype_transitions(archetypes(spark, sf_dir), "symbol", TOLD_TFS)


@query()
def archetype_phases(spark, sf_dir):
    return sr.mean_phases(archetypes(spark, sf_dir), "symbol", TOLD_TFS)


@query()
def story_explanations(spark, sf_dir):
    return analysed(src.series(spark, sf_dir)).select("symbol", "end", sr.story(F.col("tokens")).alias("story"), sr.explained(F.col("tokens")).alias("explained"))


def user_stories(spark, sf_dir) -> DataFrame:
    """Event types of each user in order, less repeats; a user's group is user_id % 8."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return e.groupBy("user_id").agg(rows.alias("all")).select("user_id", (F.col("user_id") % 8).alias("grp"), sr.without_repeats(F.col("all")).alias("tokens"))


US = "SELECT user_id, user_id % 8 AS grp, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type"
TR = "SELECT user_id, grp, event_type AS from_token, nxt AS to_token FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY n) AS nxt FROM us) WHERE nxt IS NOT NULL"
TC = "SELECT tr.grp, from_token, to_token, count(*) AS occurrences, count(DISTINCT user_id) AS stories, count(DISTINCT user_id) * 100.0::DOUBLE / any_value(total) AS presence_pct FROM tr JOIN (SELECT grp, count(DISTINCT user_id) AS total FROM us GROUP BY grp) USING (grp) GROUP BY ALL"
TOLD = {"us": US, "tr": TR, "tc": TC}


def counted(spark, sf_dir) -> DataFrame:
    return sr.transition_counts(user_stories(spark, sf_dir), "grp", "user_id")


@query(build(f"SELECT grp, from_token, to_token, occurrences, stories, {r('presence_pct')} FROM tc", **TOLD))
def story_transition_counts(spark, sf_dir):
    return counted(spark, sf_dir)


@query(build(f"SELECT * FROM (SELECT grp, from_token, to_token, occurrences, stories, {r('presence_pct')}, row_number() OVER (PARTITION BY grp ORDER BY stories DESC, occurrences DESC, from_token, to_token) AS rank FROM tc) WHERE rank <= 15", **TOLD))
def story_transition_top(spark, sf_dir):
    return sr.top_transitions(counted(spark, sf_dir), "grp")


@query(build("SELECT t.grp, t.from_token, t.to_token, coalesce(c.occurrences, 0) AS occurrences, coalesce(c.stories, 0) AS stories, round(coalesce(c.presence_pct, 0), 6) + 0.0 AS presence_pct, CASE WHEN coalesce(c.presence_pct, 0) >= 50 THEN 'COMMON' WHEN c.presence_pct > 0 THEN 'PRESENT' ELSE 'NOT_SEEN' END AS status FROM (SELECT DISTINCT grp, from_token, to_token FROM tr) t LEFT JOIN tc c ON c.grp = (t.grp + 1) % 8 AND c.from_token = t.from_token AND c.to_token = t.to_token", **TOLD))
def story_transition_annotated(spark, sf_dir):
    """The transitions of each group, with what the next group's stories say of them."""
    now = sr.transitions(user_stories(spark, sf_dir)).select("grp", "from_token", "to_token").distinct()
    counts = counted(spark, sf_dir).withColumn("grp", (F.col("grp") + 7) % 8)
    return sr.annotated(now, counts, "grp")


@query(build("SELECT from_token, to_token, " + ", ".join(f"CAST(count_if(grp = {g}) AS BIGINT) AS g{g}" for g in range(8)) + " FROM tr GROUP BY ALL", **TOLD))
def transition_family_matrix(spark, sf_dir):
    out = sr.transitions(user_stories(spark, sf_dir)).groupBy("from_token", "to_token").pivot("grp", list(range(8))).count()
    return out.select("from_token", "to_token", *(F.coalesce(str(g), F.lit(0)).alias(f"g{g}") for g in range(8)))


@query(build("""SELECT a.user_id AS a, b.user_id AS b, round(len(list_intersect(a.p, b.p)) / nullif(len(list_distinct(list_concat(a.p, b.p))), 0)::DOUBLE, 6) + 0.0 AS similarity FROM ps a JOIN ps b ON b.user_id = a.user_id + 1""", ps="SELECT user_id, list(DISTINCT from_token || '>' || to_token) AS p FROM tr GROUP BY user_id", **TOLD))
def story_jaccard(spark, sf_dir):
    """Likeness of the transitions of neighbouring users."""
    sets = sr.transitions(user_stories(spark, sf_dir)).groupBy("user_id").agg(F.collect_set(F.concat_ws(">", "from_token", "to_token")).alias("p"))
    other = sets.select((F.col("user_id") - 1).alias("user_id"), F.col("p").alias("q"))
    return sets.join(other, "user_id").select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b"), sr.jaccard(F.col("p"), F.col("q")).alias("similarity"))


@query(build("SELECT a.user_id AS a, b.user_id AS b, round(1 - levenshtein(a.s, b.s) / greatest(len(a.s), len(b.s))::DOUBLE, 6) + 0.0 AS similarity FROM ss a JOIN ss b ON b.user_id = a.user_id + 1", ss="SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'I' WHEN 'click' THEN 'R' WHEN 'purchase' THEN 'D' WHEN 'signup' THEN 'B' ELSE 'L' END, '' ORDER BY n) AS s FROM us GROUP BY user_id", us=US))
def story_alignment(spark, sf_dir):
    """Alignment of neighbouring users' stories, their event types read as families."""
    names = {"view": "INITIAL_CONTEXT", "click": "RANGE_CHANGE", "purchase": "DIRECTION_CHANGE", "signup": "BODY_CHANGE"}
    as_family = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    told = user_stories(spark, sf_dir).select("user_id", F.transform("tokens", lambda t: F.coalesce(F.try_element_at(as_family, t), F.lit("LEVEL_INTERACTION"))).alias("t"))
    other = told.select((F.col("user_id") - 1).alias("user_id"), F.col("t").alias("u"))
    return told.join(other, "user_id").select(F.col("user_id").alias("a"), (F.col("user_id") + 1).alias("b"), sr.alignment(F.col("t"), F.col("u")).alias("similarity"))


# ------------------------------------------------------------------ clusters and vectors


def fingerprinted(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, current, all windows) as vectors of 70 means, each by its spread over the history: every tenth earlier window that doesn't overlap the current one."""
    own = wd.fingerprint_measures(20)
    rows, cols = wd.ended(featured(spark, sf_dir), 20, own), list(own)
    history = (F.col("end") <= F.col("last") - 20) & ((F.col("end") - 19) % REGIME_STEP == 0)
    rows = rows.join(wd.spreads(rows.where(history), cols), src.SERIES)
    rows = written(rows.select(*wd.KEYS, "last", F.array(*((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in cols)).alias("v")), "windows")
    return rows.where(history), rows.where("end = last"), rows


@query()
def kmeans_clusters(spark, sf_dir):
    history, current, _ = fingerprinted(spark, sf_dir)
    return cu.summary(history, current, cu.kmeans(history)).drop("timeframe")


@query()
def cluster_rarity(spark, sf_dir):
    history, current, _ = fingerprinted(spark, sf_dir)
    return cu.rarity(history, current, cu.kmeans(history))


@query()
def cluster_of_matches(spark, sf_dir):
    """The cluster nearest to each of the 25 windows most like the current one."""
    history, _, rows = fingerprinted(spark, sf_dir)
    centres = cu.kmeans(history)
    found = wd.top(wd.similarities(featured(spark, sf_dir)), 25).select(*wd.KEYS, "rank", "similarity")
    out = cu.assigned(rows.join(found, wd.KEYS), centres).join(centres, src.SERIES)
    return out.select("symbol", "rank", "end", "similarity", "cluster", cu.cluster_name(F.get("centres", F.col("cluster"))).alias("name"))


def embedded(spark, sf_dir):
    """All vectors, and those that ask; a vector's label stands for its lookback."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("lookback"), F.col("embedding").alias("vector"))
    return e, e.where("id % 100 = 0").withColumnRenamed("id", "query_id")


VEC = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"
ZV = "SELECT vec_id, label, i, (x - avg(x) OVER (PARTITION BY vec_id)) / (stddev_pop(x) OVER (PARTITION BY vec_id) + 1e-9) AS z FROM ve"
VS = "SELECT q.vec_id AS query_id, v.vec_id AS id, 1 / (1 + sqrt(sum((v.z - q.z) * (v.z - q.z))) / sqrt(count(*))) AS euclidean, (sum(v.z * q.z) / (sqrt(sum(v.z * v.z)) * sqrt(sum(q.z * q.z))) + 1) / 2 AS cosine FROM zv q JOIN zv v ON v.label = q.label AND v.i = q.i AND v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL"


@query(build("SELECT * EXCLUDE (n), n AS rank FROM (SELECT query_id, id, round(euclidean, 6) AS euclidean, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(euclidean, 9) DESC, id) AS n FROM vs) WHERE n <= 10", ve=VEC, zv=ZV, vs=VS))
def vector_similarity_topk(spark, sf_dir):
    return vc.search(*embedded(spark, sf_dir), by="euclidean").select("query_id", "id", "euclidean", "cosine", "rank")


@query()
def ensemble_search(spark, sf_dir):
    return vc.search(*embedded(spark, sf_dir)).withColumnRenamed("lookback", "label")


@query()
def ensemble_search_effort(spark, sf_dir):
    """Pairs that ensemble_search compares and, of these, begins to warp."""
    return vc.search(*embedded(spark, sf_dir), effort=True)


# ------------------------------------------------------------------ more views of the above


@query(build("SELECT symbol, position, offset_, idx, round(path, 6) + 0.0 AS close_path_pct FROM (SELECT p.symbol, p.position, c.idx - p.index AS offset_, c.idx, (c.close / nullif(b.close, 0) - 1) * 100 AS path FROM pivots p JOIN c_1h c ON c.symbol = p.symbol AND c.idx BETWEEN p.index - 8 AND p.index + 8 JOIN c_1h b ON b.symbol = p.symbol AND b.idx = p.index)").replace("offset_", "place"))
def pivot_microscope(spark, sf_dir):
    """The candles around every pivot."""
    centres = st.structure(turns(spark, sf_dir)).select(*src.SERIES, "position", F.col("index").alias("centre"))
    out = wd.around(src.series(spark, sf_dir), centres, 8)
    return out.select("symbol", "position", F.col("offset").alias("place"), "idx", "close_path_pct")


@query(build(f"SELECT p.symbol, p.index, p.pivot_type, {r('f.body_pct', 'f.range_ratio', 'f.close_location').replace('AS f.', 'AS ')} FROM pivots p JOIN f_1h f ON f.symbol = p.symbol AND f.idx = p.index"))
def pivot_anatomy(spark, sf_dir):
    pivots = st.structure(turns(spark, sf_dir)).select(*src.SERIES, F.col("index").alias("idx"), "pivot_type")
    return pivots.join(featured(spark, sf_dir), [*src.SERIES, "idx"]).select("symbol", F.col("idx").alias("index"), "pivot_type", "body_pct", "range_ratio", "close_location")


@query()
def structure_signatures(spark, sf_dir):
    return st.signatures(st.structure(turns(spark, sf_dir)))


#: The tags of a state matrix.
TAGS = ["BULLISH", "BEARISH", "SMALL_BODY", "LARGE_BODY", "COMPRESSION", "EXPANSION", "UPPER_REJECTION", "LOWER_REJECTION", "CLOSE_HIGH", "CLOSE_LOW"]


@query(build("SELECT symbol, off, (direction > 0)::BIGINT AS bullish, (direction < 0)::BIGINT AS bearish, (body_pct < 0.25)::BIGINT AS small_body, (body_pct >= 0.6)::BIGINT AS large_body, (rr < 0.75)::BIGINT AS compression, (rr > 1.25)::BIGINT AS expansion, (upper_wick_pct >= 0.35)::BIGINT AS upper_rejection, (lower_wick_pct >= 0.35)::BIGINT AS lower_rejection, (close_location >= 0.75)::BIGINT AS close_high, (close_location <= 0.25)::BIGINT AS close_low FROM w_1h WHERE wend = last"))
def state_matrix(spark, sf_dir):
    return wd.tag_matrix(ft.tags(featured(spark, sf_dir)), TAGS).drop("timeframe", "end")


BS_SQL = ORACLE_SQL["behaviour_states"].partition("SELECT symbol, idx, CASE")
PHASE = f"""SELECT b.symbol, CASE WHEN f.idx BETWEEN b.wend - 19 AND b.wend THEN 'matched_window' ELSE 'context' END AS phase, f.*, CASE{BS_SQL[2].partition(" FROM f_1h JOIN")[0]} FROM (SELECT symbol AS sy, wend FROM ranked WHERE rank = 1) m
  JOIN (SELECT symbol, wend FROM ranked WHERE rank = 1) b ON b.symbol = m.sy JOIN f_1h f ON f.symbol = b.symbol AND f.idx BETWEEN b.wend - 29 AND b.wend + 10 JOIN (SELECT symbol, quantile_cont(range_ratio, 0.25) AS q1, quantile_cont(range_ratio, 0.75) AS q3 FROM f_1h GROUP BY symbol) q ON q.symbol = b.symbol"""


@query(build("""SELECT symbol, phase, min(idx) AS start_index, max(idx) AS end_index, round(avg(range_ratio), 6) AS mean_range_ratio, round(avg(body_pct), 6) AS mean_body_pct, round(avg((direction > 0)::DOUBLE), 6) AS bullish_fraction, round(avg((direction < 0)::DOUBLE), 6) AS bearish_fraction, round(avg((lower_wick_pct > upper_wick_pct * 1.5)::DOUBLE), 6) AS lower_rejection_fraction,
  round(avg((upper_wick_pct > lower_wick_pct * 1.5)::DOUBLE), 6) AS upper_rejection_fraction, string_agg(label, ' → ' ORDER BY idx) AS behaviour_sequence FROM ph GROUP BY ALL""", ph=PHASE))
def phase_summary(spark, sf_dir):
    """The window most like the current one, and the ten candles on either side of it."""
    f = ft.behaviour_labels(featured(spark, sf_dir))
    best = wd.top(wd.similarities(featured(spark, sf_dir)), 1).select(*src.SERIES, F.col("end").alias("_end"))
    rows = f.join(best, src.SERIES).where("idx BETWEEN _end - 29 AND _end + 10")
    share = lambda c: F.avg(c.cast("double"))
    up, low, steps = F.col("upper_wick_pct"), F.col("lower_wick_pct"), F.array_sort(F.collect_list(F.struct("idx", "label")))
    return rows.groupBy("symbol", F.when(F.col("idx") > F.col("_end") - 20, F.when(F.col("idx") <= F.col("_end"), "matched_window").otherwise("context")).otherwise("context").alias("phase")).agg(
        F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), F.avg("range_ratio").alias("mean_range_ratio"), F.avg("body_pct").alias("mean_body_pct"), share(F.col("direction") > 0).alias("bullish_fraction"),
        share(F.col("direction") < 0).alias("bearish_fraction"), share(low > up * 1.5).alias("lower_rejection_fraction"), share(up > low * 1.5).alias("upper_rejection_fraction"),
        F.array_join(F.transform(steps, lambda x: x["label"]), " → ").alias("behaviour_sequence"),
    )


HEAT = ["body_pct", "upper_wick_pct", "lower_wick_pct", "range_vs_median", "efficiency"]


@query(build("SELECT symbol, idx, " + ", ".join(f"round(coalesce({x}, 0.0), 6) + 0.0 AS {x}" for x in HEAT[:3]) + ", round(coalesce(least(greatest(range_vs_median, 0.0), 3.0) / 3 * 100, 0.0), 6) + 0.0 AS range_vs_median, round(coalesce(least(greatest(efficiency, 0.0), 1.0) * 100, 0.0), 6) + 0.0 AS efficiency FROM b4", **B))
def anatomy_heat(spark, sf_dir):
    return ft.heat_scaled(behaved(spark, sf_dir)).select("symbol", "idx", *HEAT)


@query(build(f"SELECT symbol, timeframe, open_time, open_time + 3600000 - 1 AS close_time, {r('open', 'high', 'low', 'close', 'volume', 'quote_volume')}, trades, (open_time + 3600000 <= 1706000000000)::BIGINT AS is_closed FROM bars_1h"))
def normalized_klines(spark, sf_dir):
    """Candles as an exchange's arrays of strings, and read from those."""
    c = src.series(spark, sf_dir)
    kline = F.array(*(F.col(x).cast("string") for x in ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades")))
    return src.normalize_klines(c.select(*src.SERIES, kline.alias("kline")), 1_706_000_000_000)


QS = {"qs": "SELECT symbol, timeframe, " + ", ".join(f"quantile_cont(x{i}, 0.75) - quantile_cont(x{i}, 0.25) AS q{i}" for i in range(22)) + " FROM v22 GROUP BY ALL",
      "sc": "SELECT v.symbol, v.wend, 1 / (1 + sqrt((" + " + ".join(f"pow((v.x{i} - n.x{i}) / greatest(q{i}, 1e-9), 2)" for i in range(22)) + ") / 22)) AS similarity FROM v22 v JOIN v22 n ON n.symbol = v.symbol AND n.wend = n.last JOIN qs ON qs.symbol = v.symbol WHERE v.wend <> v.last"}


@query(build("SELECT symbol, wend AS window_end, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(similarity, 9) DESC, wend) AS rank FROM sc) WHERE rank <= 100", **QS))
def screened_windows(spark, sf_dir):
    """The pool that stories are told of: windows most like the last one by 22 half means."""
    return wd.top(screened(anatomy(src.series(spark, sf_dir))), POOL).select("symbol", F.col("end").alias("window_end"), "rank", "similarity")


@query()
def level_ranking(spark, sf_dir):
    """Windows before the last one, which they don't overlap, most like it by what happened at levels."""
    rows = analysed(src.series(spark, sf_dir)).where("end = last OR end <= last - 20").select(*wd.KEYS, "last", *lv.FEATURES)
    return wd.top(wd.by_quartiles(rows, lv.FEATURES, F.col("end") == F.col("last")), 25).select("symbol", "end", "rank", "similarity")


@query(build("SELECT from_token, to_token, string_agg(DISTINCT grp::VARCHAR, ',' ORDER BY grp::VARCHAR) AS groups FROM tr GROUP BY ALL HAVING count(DISTINCT grp) >= 2", **TOLD))
def common_transitions(spark, sf_dir):
    """Transitions that several groups have, with the groups."""
    t = sr.transitions(user_stories(spark, sf_dir)).select("from_token", "to_token", F.col("grp").cast("string").alias("grp")).distinct()
    return t.groupBy("from_token", "to_token").agg(F.array_sort(F.collect_list("grp")).alias("g")).where(F.size("g") >= 2).select("from_token", "to_token", F.array_join("g", ",").alias("groups"))
