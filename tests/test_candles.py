"""Candle operators on small series whose results can be worked out by hand."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wickflow.functions import features as ft
from wickflow.operators import clusters, levels, mtf, outcomes, stories, structure, vectors, windows
from wickflow.sources import candles as src
from wickflow.sources import store
from wickflow.streaming import ingest

CLOSES = [100, 101, 102, 101, 99, 98, 99, 101, 103, 102, 104]


def bars(spark, closes, symbol="A", step=60_000, timeframe="1m"):
    rows = [(symbol, timeframe, i * step, c - 0.2, c + 0.5, c - 0.5, float(c), float(10 + i)) for i, c in enumerate(closes)]
    return src.indexed(spark.createDataFrame(rows, "symbol string, timeframe string, open_time long, open double, high double, low double, close double, volume double"))


def test_valid_series_has_no_errors(spark):
    assert src.validate(bars(spark, CLOSES), 60_000).first().errors == []


def test_each_rule_is_reported(spark):
    bad = bars(spark, CLOSES).withColumns({"high": F.when(F.col("idx") == 3, 0.0).otherwise(F.col("high")), "volume": F.when(F.col("idx") == 4, -1.0).otherwise(F.col("volume")), "open_time": F.when(F.col("idx") == 10, 10_000_000).otherwise(F.col("open_time"))})
    got = src.validate(bad, 60_000).first()
    assert got.errors == ["high < low", "open outside high/low", "close outside high/low", "negative OHLCV value", "missing timestamp gaps detected"] and got.gaps == 1
    assert src.validate(bad.drop("volume"), 60_000).first().errors == ["missing columns: ['volume']"]


def test_latest_contiguous_run(spark):
    b = bars(spark, CLOSES)
    assert src.latest_contiguous(b, 60_000).count() == 11
    assert sorted(r.idx for r in src.latest_contiguous(b.where("idx not in (3, 7)"), 60_000).collect()) == [8, 9, 10]


def test_upsert_is_idempotent_and_replaces(spark):
    b = bars(spark, CLOSES).drop("idx")
    new = b.where("open_time >= 540000").withColumn("close", F.lit(7.0)).unionByName(b.limit(1).withColumn("open_time", F.lit(-1).cast("long")))
    once = src.upsert(b, new)
    assert once.count() == 12 and once.where("close = 7").count() == 2
    assert sorted(src.upsert(once, new).collect()) == sorted(once.collect())


def test_increment_takes_closed_newer_candles(spark):
    b = bars(spark, CLOSES).drop("idx").withColumn("is_closed", F.lit(1))
    out = src.increment(b.where("open_time < 300000"), b.withColumn("is_closed", (F.col("open_time") < 600000).cast("int")), 60_000)
    assert out.count() == 10


def test_klines_and_csv(spark, tmp_path):
    raw = spark.createDataFrame([("A", "1m", ["60000", "1", "3", "0.5", "2", "9", "119999", "18", "4"])], "symbol string, timeframe string, kline array<string>")
    got = src.normalize_klines(raw, 120_000)
    r = got.first()
    assert (r.open_time, r.open, r.high, r.low, r.close, r.volume, r.trades, r.is_closed) == (60_000, 1.0, 3.0, 0.5, 2.0, 9.0, 4, 1)
    assert src.normalize_klines(raw, 119_999).first().is_closed == 0
    src.export_csv(got, str(tmp_path / "csv"))
    assert src.restore_csv(spark, str(tmp_path / "csv")).collect() == got.collect()


def test_features_of_flat_and_first_candles(spark):
    rows = ft.candle_features(bars(spark, [5, 5, 5]).withColumns({c: F.lit(5.0) for c in ("open", "high", "low", "close")})).orderBy("idx").collect()
    assert [(r.direction, r.body_pct, r.alternation, r.body_change) for r in rows] == [(0, 0, 0, 0)] * 3
    out = ft.add_features(bars(spark, CLOSES)).orderBy("idx").collect()
    assert out[0]["return"] is None and out[3].volatility_20 is None and abs(out[10].momentum_10 - 0.04) < 1e-12
    vector = ft.pattern_vectors(ft.add_features(bars(spark, CLOSES)), 5).first().vector
    assert len(vector) == 50 and all(map(math.isfinite, vector))


def test_zigzag(spark):
    got = [(r["index"], r.confirmation_index, r.direction, r.price) for r in structure.zigzag_turns(bars(spark, CLOSES), 1.0).orderBy("index").collect()]
    assert got == [(2, 4, "DOWN", 102.0), (5, 6, "UP", 98.0)]
    assert structure.zigzag_turns(bars(spark, [5] * 9), 1.0).count() == 0
    assert structure.zigzag_turns(bars(spark, [100, 100.5, 99.6, 100.2]), 1.0).count() == 0
    flips = structure.zigzag_turns(bars(spark, [100, 110, 99, 110, 99]), 10.0).orderBy("index").collect()
    assert [(r["index"], r.direction) for r in flips] == [(1, "DOWN"), (2, "UP"), (3, "DOWN")]


def test_structure_labels(spark):
    turns = structure.zigzag_turns(bars(spark, [10, 12, 10, 13, 11, 12.5, 9, 11]), 5.0)
    assert [r.pivot_type for r in structure.structure(turns).orderBy("index").collect()] == [None, None, "HH", "HL", "LH", "LL"]


@pytest.mark.parametrize(("path", "label"), [([(103, 99.5)], "target"), ([(101, 98)], "stop"), ([(103, 98)], "ambiguous"), ([(101, 99.5)], "neither"), ([], "no_data"), ([(101, 99.5), (101, 98), (103, 99.5)], "stop")])
def test_which_level_came_first(spark, path, label):
    rows = [("A", "1h", 0, 100.0, 100.0, 100.0)] + [("A", "1h", i + 1, float(h), float(lo), (h + lo) / 2) for i, (h, lo) in enumerate(path)]
    b = spark.createDataFrame(rows, "symbol string, timeframe string, idx int, high double, low double, close double")
    ends = spark.createDataFrame([("A", "1h", 0)], "symbol string, timeframe string, endpoint_index int")
    got = outcomes.measure(ends, b, horizons=(5,)).first()
    assert (got.target_first, got.bars_available) == (label, len(path))


def test_wilson_interval(spark):
    low, high = outcomes.wilson(F.lit(72), F.lit(103))
    r = spark.range(1).select(low.alias("low"), high.alias("high"), outcomes.wilson(F.lit(0), F.lit(0))[0].alias("none")).first()
    assert abs(r.low - 0.6049) < 1e-3 and abs(r.high - 0.7791) < 1e-3 and r.none is None


def test_spacing_keeps_rows_exactly_apart(spark):
    rows = spark.createDataFrame([("A", "1h", x) for x in (0, 5, 10, 19, 20, 29)], "symbol string, timeframe string, at int")
    assert sorted(r["at"] for r in outcomes.spaced(rows, "at", 10, ["at"]).collect()) == [0, 10, 20]


def test_window_like_itself_is_the_nearest(spark):
    closes = [100 + 5 * math.sin(i * i) for i in range(30)]
    shaped = bars(spark, closes + closes).withColumn("open", F.col("close") + F.sin("close")).withColumns({"high": F.greatest("open", "close") + F.abs(F.sin(F.col("close") * 3)), "low": F.least("open", "close") - F.abs(F.cos(F.col("close") * 7))})
    got = windows.knn(ft.candle_features(shaped, 5), 10, 3).where("rank = 1").first()
    assert got.candidate_end == 29 and got.similarity > 0.9


def test_blocks_split_as_evenly_as_can_be(spark):
    got = windows.blocks(ft.candle_features(bars(spark, CLOSES)), n=11, count=5).orderBy("block").collect()
    assert [r.candles for r in got] == [3, 2, 2, 2, 2]


def test_asof_is_backward_and_inclusive(spark):
    left = spark.createDataFrame([("A", t) for t in (5, 10, 15)], "symbol string, close_ts long")
    right = spark.createDataFrame([("A", 10, 1.0), ("A", 14, 2.0), ("B", 1, 9.0)], "symbol string, close_ts long, v double")
    assert [(r.close_ts, r.asof_v) for r in mtf.asof(left, right, "close_ts", "symbol", ["v"]).orderBy("close_ts").collect()] == [(10, 1.0), (15, 2.0)]


def test_story_tools(spark):
    df = spark.createDataFrame([(" A -> B ->  -> B",), (None,), ("INITIAL_X -> RANGE_EXPANSION -> RANGE_COMPRESSION -> HOLD_CLUSTER -> ODD",)], "s string")
    got = [(r.t, r.u, r.f) for r in df.select(stories.parsed(F.col("s")).alias("t"), stories.without_repeats(stories.parsed(F.col("s"))).alias("u"), stories.families(stories.parsed(F.col("s"))).alias("f")).collect()]
    assert got[0][0] == ["A", "B", "B"] and got[0][1] == ["A", "B"] and got[1] == ([], [], []) and got[2][2] == ["INITIAL_CONTEXT", "RANGE_CHANGE", "HOLD", "ODD"]
    told = spark.createDataFrame([("S", 1, ["A", "B"], ["A"]), ("S", 2, ["A", "B"], ["A"]), ("S", 3, ["X", "Y", "Z"], None)], "symbol string, id int, one array<string>, two array<string>")
    got = {r.id: r for r in stories.leader_clusters(told, "id", "symbol", ["one", "two"]).collect()}
    assert [got[i].cluster for i in (1, 2, 3)] == [0, 0, 1] and got[2].distance == 0
    said = spark.createDataFrame([(["INITIAL_X", "RANGE_EXPANSION", "REJECTION_CLUSTER", "HOLD_CLUSTER", "REPEATED_TEST_CLUSTER"],), (["ODD"],)], "t array<string>").select(stories.explained(F.col("t")).alias("s")).collect()
    assert said[0].s == "Candle movement became wider at one or more points. There were signs of rejection around tested areas. There were periods where price stayed around an area." and said[1].s == stories.MIXED


def test_level_episodes(spark):
    event = "struct<local_index:int,level_price:double,interaction:string,repeated_test:int,post_interaction_expansion:int>"
    rows = [([],), ([(1, 100.0, "PULLBACK", 0, 0), (3, 100.1, "PULLBACK", 0, 1), (9, 100.0, "HOLD", 0, 0), (10, 130.0, "TEST", 0, 0), (11, 130.0, "BREAK", 1, 0)],)]
    got = [r.t for r in spark.createDataFrame(rows, f"e array<{event}>").select(levels.episodes(F.col("e")).alias("t")).collect()]
    assert got == [[], ["PULLBACK_CLUSTER", "EXPANSION_AFTER_TEST", "HOLD_CLUSTER", "REPEATED_TEST_CLUSTER"]]


def test_finite_and_first_of(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("Infinity",)], "s string")
    assert [r.v for r in df.select(src.finite("s", 7.0).alias("v")).collect()] == [1.5, 7.0, 7.0, 7.0, 7.0]
    rows = spark.createDataFrame([("1h", 1, 5), ("1h", 1, 4), ("1h", 2, 9)], "timeframe string, rank int, end int")
    assert sorted((r["rank"], r.end) for r in src.deduplicated_matches(rows).collect()) == [(1, 4), (2, 9)]
    with pytest.raises(ValueError):
        src.market(bars(spark, CLOSES), "B", "1m")
    assert src.market(bars(spark, CLOSES).drop("idx").unionByName(bars(spark, CLOSES).drop("idx")), "A", "1m").count() == 11


def test_pages_stop(spark):
    step, have = 10, [[t] for t in range(0, 250, 10)]
    fetch = lambda start, limit: [x for x in have if x[0] >= start][:limit]
    assert [len(p) for p in src.paged(fetch, -5, 10**6, step, 100, page=10)] == [10, 10, 5]
    assert [len(p) for p in src.paged(fetch, 0, 10**6, step, 12, page=10)] == [10, 2]
    assert list(src.paged(lambda s, n: [], 0, 100, step, 100)) == [] and len(list(src.paged(lambda s, n: [[-10]] * n, 0, 100, step, 50, page=10))) == 1
    assert [len(p) for p in src.paged(fetch, 0, 95, step, 100, page=5)] == [5, 5]


def test_results_are_written_and_read(spark, tmp_path):
    one = spark.createDataFrame([("a, \"b\"", 1.5)], "story string, x double")
    for _ in range(2):
        src.write_results({"one": one}, str(tmp_path))
    assert src.read_result(spark, str(tmp_path), "one").collect() == one.collect()
    assert src.restore_csv(spark, str(tmp_path / "none")).count() == 0


def test_prefixes(spark):
    got = outcomes.on_prefixes(bars(spark, CLOSES), lambda p, i: float(len(p) * 100 + p.close.iloc[-1] - i), "double", 8).orderBy("idx").collect()
    assert [(r.idx, r.signal) for r in got] == [(i, (i + 1) * 100 + CLOSES[i] - i) for i in (8, 9, 10)]


def test_folded_signals_equal_those_of_prefixes(spark):
    c = bars(spark, CLOSES)
    c = c.unionByName(c.withColumn("symbol", F.lit("B")).where("idx < 4"))
    start, update = (lambda: (0, 0.0, 0.0)), lambda s, c: (s[0] + 1, max(s[1], c.high), c.close)
    got = outcomes.folded(c, start, update, lambda s: s[0] * 1000 + s[1] - s[2], "double", 2).collect()
    want = outcomes.on_prefixes(c, lambda p, i: len(p) * 1000 + p.high.max() - p.close.iloc[-1], "double", 2).collect()
    assert len(got) == 11 and sorted(got) == sorted(want)


def test_zones(spark):
    r = spark.range(1).select(levels.zone_bounds(F.lit(100.0), F.lit(10.0)).alias("z")).first().z
    assert (r.low, r.high) == (98.0, 102.0)


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        structure.checked({"type": 0.5, "swing": 0.6})


def test_warping():
    assert vectors.dtw([1, 2, 3], [1, 2, 2, 3]) == 0 and vectors.dtw([0.0], [2.0]) == 2 and vectors.dtw([[0, 0], [1, 1]], [[3, 4]]) == pytest.approx(5 + 13**0.5)


def test_kmeans_separates(spark):
    points = spark.createDataFrame([("A", "1h", i, [float(i // 10) * 10, float(i % 3)]) for i in range(30)], "symbol string, timeframe string, end int, v array<double>")
    centres = clusters.kmeans(points, k=3)
    got = clusters.assigned(points, centres).toPandas()
    assert got.groupby(got.end // 10).cluster.nunique().tolist() == [1, 1, 1] and got.cluster.nunique() == 3
    assert clusters.rarity(points, points.where("end = 29"), centres).first().rarity_pct > 0
    assert len(clusters.kmeans(points.where("end < 2"), k=8).first().centres) == 2 and len(clusters.kmeans(points, k=1).first().centres) == 1


def test_streams(spark, tmp_path):
    message = '{"k":{"t":%d,"T":59999,"s":"abc","i":"1m","o":"1","h":"2","l":"1","c":"%s","v":"3","q":"4","n":5,"x":%s}}'
    for i, (t, c, closed) in enumerate([(0, "1.5", "true"), (0, "1.7", "true"), (60000, "1.9", "false")]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text(message % (t, c, closed) + "\nnot json\n")
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
    q = ingest.closed_candles(stream).writeStream.foreachBatch(ingest.merge_into(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = store.CandleStore(spark, str(tmp_path / "out")).read().collect()
    assert len(got) == 1 and got[0].symbol == "ABC" and got[0].close in (1.5, 1.7)
    ticks = pd.DataFrame({"event_type": "A", "ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:59", "2024-01-01 03:00"]), "value": [1.0, 2.0, 3.0], "event_id": [1, 2, 3]})
    spark.createDataFrame(ticks).coalesce(1).write.parquet(str(tmp_path / "ticks"))
    schema = spark.read.parquet(str(tmp_path / "ticks")).schema
    out = ingest.streaming_candles(spark.readStream.schema(schema).parquet(str(tmp_path / "ticks"))).writeStream.format("memory").queryName("bars").outputMode("append").start()
    out.processAllAvailable()
    out.stop()
    assert [(r.open, r.close, r.trades) for r in spark.sql("SELECT * FROM bars").collect()] == [(1.0, 2.0, 2)]
