"""The candle store, the paged source and the streams: merges that fail or meet, late messages, restarts."""

import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest

from wickflow.operators import structure
from wickflow.sources import candles as src
from wickflow.sources import pages, store
from wickflow.streaming import turns

STEP = src.STEPS["1h"]


def row(symbol, i, close, trades, timeframe="1h"):
    return (symbol, timeframe, i * STEP, i * STEP + STEP - 1, close, close, close, close, 1.0, 1.0, trades, 1)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, src.SCHEMA)


def closes(found):
    return {(r.symbol, r.open_time // STEP): r.close for r in found.collect()}


def test_late_older_messages_do_not_replace(spark, tmp_path):
    kept = store.CandleStore(spark, f"{tmp_path}/s")
    assert kept.read().count() == 0
    kept.merge(rows_of(spark, [row("A", 0, 1.0, 5), row("A", 1, 1.0, 5), row("A", 1000, 9.0, None)]))
    kept.merge(rows_of(spark, [row("A", 0, 2.0, 3), row("A", 1, 2.0, 7), row("A", 1, 2.5, 6), row("B", 1, 3.0, 1)]))
    kept.merge(rows_of(spark, [row("A", 1000, 10.0, None)]))  # without trades the last batch wins
    assert closes(kept.read()) == {("A", 0): 1.0, ("A", 1): 2.0, ("A", 1000): 10.0, ("B", 1): 3.0}
    assert closes(kept.read(1)) == {("A", 0): 1.0, ("A", 1): 1.0, ("A", 1000): 9.0}


def test_a_merge_that_fails_midway_changes_nothing_and_can_run_again(spark, tmp_path, monkeypatch):
    kept = store.CandleStore(spark, f"{tmp_path}/s")
    kept.merge(rows_of(spark, [row("A", i, 1.0, 1) for i in range(5)]), "klines", 0)
    new = rows_of(spark, [row("A", i, 2.0, 2) for i in range(3, 8)])
    real = store.CandleStore._put

    def fails(self, manifest):
        raise OSError("lost between data and manifest")

    monkeypatch.setattr(store.CandleStore, "_put", fails)
    with pytest.raises(OSError, match="lost"):
        kept.merge(new, "klines", 1)
    assert kept.version() == 1 and closes(kept.read()) == {("A", i): 1.0 for i in range(5)}
    monkeypatch.setattr(store.CandleStore, "_put", real)
    want = {("A", i): 1.0 if i < 3 else 2.0 for i in range(8)}
    assert kept.merge(new, "klines", 1) == 2 and closes(kept.read()) == want
    assert kept.merge(rows_of(spark, [row("A", 0, 7.0, 99)]), "klines", 1) == 2 and closes(kept.read()) == want  # batch 1 was merged before
    kept.vacuum()
    assert closes(kept.read()) == want and len([x for x in (tmp_path / "s/data").iterdir() if not x.name.startswith(".")]) == 1


def test_merges_that_meet_are_both_there(spark, tmp_path):
    path = f"{tmp_path}/s"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda s: store.CandleStore(spark, path).merge(rows_of(spark, [row(s, i, 1.0, 1) for i in range(3)])), "ABCD"))
    assert set(closes(store.CandleStore(spark, path).read())) == {(s, i) for s in "ABCD" for i in range(3)}
    assert store.CandleStore(spark, path).version() == 4


@pytest.mark.parametrize(("page", "spans"), [(3, 1), (3, 4), (1000, 7)])
def test_pages_give_each_candle_once(spark, tmp_path, page, spans):
    times = [0, 1, 2, 3, 7, 8, 20, 21, 22, 23]  # gaps, over the ends of spans
    folder = tmp_path / "symbol=A" / "timeframe=1h"
    folder.mkdir(parents=True)
    for n, part in enumerate((times[5:], times[:6])):  # one candle is in two files
        (folder / f"{n}.txt").write_text("".join(json.dumps([t * STEP, "1", "2", "0.5", str(t), "1", t * STEP + STEP - 1, "1", 3]) + "\n" for t in part))
    spark.dataSource.register(pages.KlinePages)
    read = lambda a, b: spark.read.format("klines").options(path=str(tmp_path), symbols="A,B", timeframes="1h", start=str(a), end=str(b), page=str(page), partitions=str(spans)).load()
    got = src.normalize_klines(read(0, 23 * STEP), 10**15).collect()
    assert sorted((r.open_time // STEP, r.close) for r in got) == [(t, float(t)) for t in times] and {r.symbol for r in got} == {"A"}
    assert sorted(int(r.kline[0]) // STEP for r in read(2 * STEP, 20 * STEP - 1).collect()) == [2, 3, 7, 8]


def test_paging_stops_as_a_server_does():
    asked = []

    def fetch(start, limit):
        asked.append((start, limit))
        return [[t] for t in range(start, min(start + limit, 7))]

    assert [len(x) for x in src.paged(fetch, 0, 100, 1, 100, page=3)] == [3, 3, 1] and asked == [(0, 3), (3, 3), (6, 3)]
    assert [len(x) for x in src.paged(fetch, 0, 100, 1, 4, page=3)] == [3, 1]
    assert list(src.paged(lambda a, n: [[0]] * n, 5, 100, 1, 100, page=2)) == [[[0], [0]]]  # the cursor would not move


def test_turns_of_a_stream_equal_the_batch_after_restarts(spark):
    rng = random.Random(13)
    walk, rows = {"A": 100.0, "B": 50.0}, []
    for i in range(300):
        for s in walk:
            walk[s] *= 1 + rng.uniform(-0.06, 0.06)
            rows.append(row(s, i, None if rng.random() < 0.02 else walk[s], 1))
    rows += [row("C", i, 5.0, 1) for i in range(3)]
    candles = src.indexed(spark.createDataFrame(rows, src.SCHEMA))
    want = {tuple(r) for r in structure.zigzag_turns(candles, 10.0).collect()}
    assert len(want) > 20
    for batches in (1, 4):
        assert {tuple(r) for r in turns.turns_in_batches(candles, 10.0, batches).collect()} == want
    assert turns.turns_in_batches(candles.limit(0), 10.0).collect() == []


def test_restore_says_what_is_missing(spark, tmp_path):
    src.export_csv(rows_of(spark, [row("A", i, 1.0, 1) for i in range(4)]), f"{tmp_path}/out")
    (tmp_path / "out" / "_timeframe=1d").mkdir()
    got = {r.timeframe: (r.status, r["rows"], r.last_open_time) for r in src.restored(spark, f"{tmp_path}/out", ["1h", "4h", "1d"]).collect()}
    assert got == {"1h": ("RESTORED", 4, 3 * STEP), "4h": ("FILE NOT FOUND", 0, None), "1d": ("EMPTY", 0, None)}
