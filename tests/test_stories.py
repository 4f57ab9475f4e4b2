"""Levels, touches and stories against plain Python that shares no code with the library."""

import random
from statistics import mean, median

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wickflow.plans import catalog
from wickflow.sources import candles as src
from wickflow.tables import scratch, written

N, HALF = 20, 10


def sign(x):
    return (x > 0) - (x < 0)


def plain_levels(w, atr):
    found = []
    for i in range(1, HALF - 1):
        near = (w[i - 1], w[i + 1])
        if all(w[i].high >= x.high for x in near):
            found.append((w[i].high, i, "SWING_HIGH"))
        if all(w[i].low <= x.low for x in near):
            found.append((w[i].low, i, "SWING_LOW"))
    bodies = [abs(x.close - x.open) for x in w[:HALF]]
    found += [((w[i].open + w[i].close) / 2, i, "BODY_ZONE") for i, b in enumerate(bodies) if b > 0 and b >= 1.25 * median(bodies)]
    levels = []
    for price, i, kind in sorted(found, key=lambda x: x[0]):
        for level in levels:
            if abs(level[0] - price) <= max(0.5 * atr[i], 1e-12):
                level[0] = (level[0] + price) / 2
                level[1].add(kind)
                break
        else:
            levels.append([price, {kind}])
    return levels


def plain_window(w):
    """(counts and levels, touches, story) of a window's candles."""
    ranges, ways = [max(x.high - x.low, 1e-12) for x in w], [sign(x.close - x.open) for x in w]
    true = [max(x.high - x.low, abs(x.high - p.close), abs(x.low - p.close)) for x, p in zip(w, w[:1] + w[:-1], strict=True)]
    atr = [max(median(true[max(0, k - 13) : k + 1]), 1e-12) for k in (max(i, 2) for i in range(N))]
    levels, touched, out, totals = plain_levels(w, atr), set(), [], dict.fromkeys("break hold reject pull again grew high low zone".split(), 0)
    for i in range(HALF, N):
        x, reach = w[i], max(0.2 * atr[i], 1e-12)
        distances = [min(abs(v - p) for v in (x.high, x.low, x.close)) for p, _ in levels]
        if not distances or min(distances) > reach:
            continue
        k = distances.index(min(distances))
        p, kinds = levels[k]
        high, low, zone = (t in kinds for t in ("SWING_HIGH", "SWING_LOW", "BODY_ZONE"))
        does = {
            "break": (x.low < p - reach and x.close > p + reach) or (x.high > p + reach and x.close < p - reach),
            "reject": ((high or zone) and (x.high - max(x.open, x.close)) / ranges[i] >= 0.35 and x.close < p) or ((low or zone) and (min(x.open, x.close) - x.low) / ranges[i] >= 0.35 and x.close > p),
            "hold": (high and x.close <= p + reach) or (low and x.close >= p - reach),
            "pull": i > HALF and sign(mean(ways[i - 3 : i])) * ways[i] < 0,
            "again": k in touched, "grew": i + 1 < N and ranges[i + 1] > 1.25 * median(ranges[max(HALF, i - 4) : i + 1]), "high": high, "low": low, "zone": zone,
        }
        touched.add(k)
        for name, yes in does.items():
            totals[name] += bool(yes)
        label = next((v for t, v in (("reject", "REJECTION"), ("break", "BREAK"), ("hold", "HOLD"), ("pull", "PULLBACK")) if does[t]), "TEST")
        out.append((i, p, "+".join(sorted(kinds)), label, int(does["again"]), int(does["grew"])))
    return levels, totals, out, plain_story(w, ranges, ways, out)


def plain_story(w, ranges, ways, touches):
    bodies = [abs(x.close - x.open) for x in w]
    halves = lambda v: (mean(v[:HALF]), mean(v[HALF:]))
    (d, e), (r, q), (b, c) = halves(ways), halves(ranges), halves(bodies)
    story = ["INITIAL_BULLISH_BIAS" if d >= 0.25 else "INITIAL_BEARISH_BIAS" if d <= -0.25 else "INITIAL_BALANCED_BEHAVIOUR"]
    story += ["RANGE_EXPANSION"] * (q > 1.2 * r) + ["RANGE_COMPRESSION"] * (q < 0.8 * r)
    if abs(e - d) >= 0.35:
        story.append("DIRECTIONAL_SHIFT" if d * e < -0.03 else "DIRECTION_CHANGE_IN_CHARACTER")
    story += ["BODY_EXPANSION"] * (c > 1.2 * b) + ["BODY_COMPRESSION"] * (c < 0.8 * b)
    x, y, z = mean(ways[:6]), mean(ways[6:12]), mean(ways[12:])
    story += ["COUNTERMOVE_AND_RENEWAL"] * (x * y < -0.05 and z * x > 0.02)
    groups = []
    for t in touches:
        if groups and abs(t[1] - groups[-1][0][1]) / max(abs(groups[-1][0][1]), 1e-9) <= 0.0015 and t[0] - groups[-1][-1][0] <= 3:
            groups[-1].append(t)
        else:
            groups.append([t])
    for g in groups:
        labels = {t[3] for t in g}
        if labels == {"PULLBACK"}:
            story.append("PULLBACK_CLUSTER")
        elif len(labels) <= 2 and labels & {"REJECTION", "HOLD"}:
            story.append("REJECTION_CLUSTER" if "REJECTION" in labels else "HOLD_CLUSTER")
        else:
            story.append("REPEATED_TEST_CLUSTER" if any(t[4] for t in g) else "LEVEL_INTERACTION_CLUSTER")
        if any(t[5] for t in g):
            story.append("EXPANSION_AFTER_TEST")
    return [t for i, t in enumerate(story) if i == 0 or t != story[i - 1]]


@pytest.fixture(scope="module")
def plain(spark, sf):
    """Of every window of every symbol, by (symbol, end)."""
    all_ = src.series(spark, sf).toPandas().sort_values(["symbol", "idx"])
    series = {s: list(own.itertuples()) for s, own in all_.groupby("symbol")}
    return series, {(s, e): plain_window(rows[e - N + 1 : e + 1]) for s, rows in series.items() for e in range(N - 1, len(rows))}


def test_levels_and_touches(spark, sf, plain):
    _, want = plain
    rows = {(r.symbol, r.end): r for r in catalog.QUERIES["price_levels_v2"](spark, sf).collect()}
    assert set(rows) == set(want)
    names = {"break": "break_count", "hold": "hold_count", "reject": "rejection_count", "pull": "pullback_count", "again": "repeated_level_tests", "grew": "reaction_expansion_count", "high": "swing_high_tests", "low": "swing_low_tests", "zone": "body_zone_tests"}
    for key, (levels, totals, touches, _) in want.items():
        r = rows[key]
        assert r.level_count == len(levels) and r.interaction_count == len(touches) and {k: r[v] for k, v in names.items()} == totals, key
        places = (touches[0][0] / 10, touches[-1][0] / 10) if touches else (-1.0, -1.0)
        assert (r.first_interaction_position, r.last_interaction_position) == pytest.approx(places)
    got = {}
    for r in sorted(catalog.QUERIES["level_events"](spark, sf).collect(), key=lambda r: r.local_index):
        got.setdefault((r.symbol, r.end), []).append((r.local_index, pytest.approx(r.level_price, abs=2e-6), r.level_type, r.interaction, r.repeated_test, r.post_interaction_expansion))
    assert got == {k: t for k, (_, _, t, _) in want.items() if t}


def test_stories(spark, sf, plain):
    _, want = plain
    got = {(r.symbol, r.end): r.story for r in catalog.QUERIES["story_tokens"](spark, sf).collect()}
    assert got == {k: " -> ".join(s) for k, (_, _, _, s) in want.items()}


CHEAP = [{"LEVEL_INTERACTION_CLUSTER", "REPEATED_TEST_CLUSTER"}, {"REJECTION_CLUSTER", "HOLD_CLUSTER"}, {"RANGE_EXPANSION", "BODY_EXPANSION"}, {"RANGE_COMPRESSION", "BODY_COMPRESSION"}, {"DIRECTIONAL_SHIFT", "DIRECTION_CHANGE_IN_CHARACTER"}]


CHEAP_FAMILIES = [{"LEVEL_INTERACTION", "REJECTION"}, {"LEVEL_INTERACTION", "PULLBACK"}, {"LEVEL_INTERACTION", "EXPANSION_AFTER_TEST"}, {"REJECTION", "HOLD"}, {"RANGE_CHANGE", "BODY_CHANGE"}, {"DIRECTION_CHANGE", "BODY_CHANGE"}]


def plain_edits(a, b, cheap, cost):
    rows = [[max(i, j) if not i or not j else None for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (0 if x == y else cost if {x, y} in cheap else 1))
    return rows[-1][-1]


def plain_likeness(a, b):
    if not a or not b:
        return 0.0
    x, y = (np.linspace(0, 1, n) if n > 1 else np.zeros(1) for n in (min(len(a), 16), min(len(b), 16)))
    k = min(len(x), len(y))
    return 0.6 * (1 - plain_edits(a, b, CHEAP, 0.35) / max(len(a), len(b))) + 0.25 * mean(p == q for p, q in zip(a[:k], b[:k], strict=True)) + 0.15 * (1 - np.abs(x[:k] - y[:k]).mean())


def test_likeness_of_stories(spark):
    from wickflow.operators import stories

    rng = random.Random(14)
    tokens = sorted({x for p in CHEAP for x in p}) + ["ODD"]
    kinds = sorted({x for p in CHEAP_FAMILIES for x in p}) + ["INITIAL_CONTEXT"]
    some = lambda of, most: [rng.choice(of) for _ in range(rng.randrange(most))]
    rows = [(list("abc"), list("abcde"), [], []), ([], [], ["HOLD"], ["HOLD"])] + [(some(tokens, 22), some(tokens, 22), some(kinds, 9), some(kinds, 9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, f array<string>, g array<string>")
    got = df.select("*", stories.story_similarity("a", "b").alias("s"), stories.family_similarity("f", "g").alias("t")).collect()
    assert got[0].s == pytest.approx(0.7225)
    for r in got:
        assert r.s == pytest.approx(plain_likeness(r.a, r.b), abs=1e-12)
        assert r.t == pytest.approx(max(0.0, 1 - plain_edits(r.f, r.g, CHEAP_FAMILIES, 0.5) / max(len(r.f), len(r.g))) if r.f and r.g else 0.0, abs=1e-12)


def test_matches_are_the_best_of_the_pool(spark, sf, plain):
    """Pool by the screen's ranking; then three quarters of the story's likeness and one of the features'."""
    series, want = plain
    features = {(r.symbol, r.end): np.array([float(r[c]) for c in catalog.lv.STORY_FEATURES]) for r in catalog.QUERIES["price_levels_v2"](spark, sf).collect()}
    pool = catalog.QUERIES["screened_windows"](spark, sf).toPandas()
    got = catalog.QUERIES["story_matches"](spark, sf).toPandas()
    for symbol, rows in series.items():
        last = (symbol, len(rows) - 1)
        q, scored = features[last], []
        for end in pool[pool.symbol == symbol].window_end:
            x = features[symbol, end]
            alike = 1 / (1 + np.sqrt(np.mean(((x - q) / np.maximum(abs(q) * 0.25, 1)) ** 2)))
            scored.append((-round(0.75 * plain_likeness(want[last][3], want[symbol, end][3]) + 0.25 * alike, 5), end))
        own = got[got.symbol == symbol].sort_values("rank")
        assert len(own) == min(25, len(rows) - N) and own.similarity.round(5).tolist() == pytest.approx([-s for s, _ in sorted(scored)[:25]], abs=2e-5)
        assert all(" -> ".join(want[symbol, r.end][3]) == r.story for r in own.itertuples())


def test_level_ranking(spark, sf, plain):
    series, _ = plain
    rows = catalog.QUERIES["price_levels_v2"](spark, sf).toPandas()
    got = catalog.QUERIES["level_ranking"](spark, sf).toPandas()
    for symbol, candles in series.items():
        last = len(candles) - 1
        own = rows[(rows.symbol == symbol) & ((rows.end == last) | (rows.end <= last - N))]
        x = own[catalog.lv.FEATURES].to_numpy(float)
        scale = np.maximum(np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0), 1e-9)
        now = x[(own.end == last).to_numpy()][0]
        sims = 1 / (1 + np.linalg.norm((x - now) / scale, axis=1) / np.sqrt(len(now)))
        best = np.sort(sims[(own.end != last).to_numpy()])[::-1][:25]
        assert got[got.symbol == symbol].sort_values("rank").similarity.to_numpy() == pytest.approx(best, abs=1e-4)


def test_fingerprint_ids(spark, sf):
    import hashlib

    parts = catalog.wd.fingerprints(catalog.wd.described(catalog.featured(spark, sf))).toPandas()
    names = sorted(catalog.wd.COMPONENTS)
    assert len(names) == 23
    for r in parts.sample(60, random_state=1).itertuples():
        v = np.array([getattr(r, c) for c in names])
        assert r.fingerprint_id == "FP-" + hashlib.sha1(np.round(v, 2).tobytes()).hexdigest()[:10].upper()


def test_clusters_of_windows(spark, sf):
    """Lloyd's rounds in numpy over the 70 means of every tenth window."""
    history, current, _ = catalog.fingerprinted(spark, sf)
    got, rare = catalog.QUERIES["kmeans_clusters"](spark, sf).toPandas(), catalog.QUERIES["cluster_rarity"](spark, sf).toPandas().set_index("symbol")
    now = current.toPandas().set_index("symbol").v
    for symbol, own in history.toPandas().groupby("symbol"):
        x = np.stack(own.sort_values("end").v)
        assert x.shape[1] == 70
        k = min(8, len(x))
        centres, labels = x[np.linspace(0, len(x) - 1, k, dtype=int)].copy(), None
        for _ in range(25):
            far = ((x[:, None] - centres) ** 2).mean(2)
            if labels is not None and (labels == far.argmin(1)).all():
                break
            labels = far.argmin(1)
            for i in set(labels):
                centres[i] = x[labels == i].mean(0)
        mine = got[got.symbol == symbol].sort_values("cluster")
        assert mine.windows.tolist() == np.bincount(labels, minlength=k).tolist()
        away = ((centres - np.array(now[symbol])) ** 2).mean(1)
        assert mine.distance_from_current.to_numpy() == pytest.approx(away, abs=1e-5) and mine.is_current_cluster.to_numpy().argmax() == away.argmin()
        nearest = ((x[:, None] - centres) ** 2).mean(2).min(1)
        assert rare.rarity_pct[symbol] == pytest.approx((nearest <= away.min()).mean() * 100)
        for r in mine.itertuples():
            c = centres[r.cluster]
            name = lambda v, a, b, m: a if v > 0.2 else b if v < -0.2 else m
            assert r.name == f"{name(c[0], 'BULL_BIASED', 'BEAR_BIASED', 'BALANCED')} | {name(c[3], 'WIDE_RANGE', 'TIGHT_RANGE', 'MID_RANGE')} | {name(c[1], 'HIGH_ALTERNATION', 'LOW_ALTERNATION', 'MID_ALTERNATION')}"


def test_replays_combine_candles_and_stories(spark, sf):
    heat = catalog.QUERIES["story_history_heat"](spark, sf).toPandas().set_index("reference_timestamp")
    candles = catalog.QUERIES["mtf_history_1h"](spark, sf).toPandas().set_index("reference_timestamp")
    rows = catalog.QUERIES["story_history_1h"](spark, sf).toPandas()
    assert len(rows) and set(rows.reference_timestamp) == set(heat.index) <= set(candles.index)
    for r in rows.itertuples():
        exact = [heat.loc[r.reference_timestamp, f"story_similarity_{tf}"] for tf in catalog.mt.ALL[:-1]]
        assert r.story_similarity == pytest.approx(np.mean(exact), abs=2e-6) and r.candle_similarity == pytest.approx(candles.combined_similarity[r.reference_timestamp], abs=2e-6)
        assert r.combined_similarity == pytest.approx(0.6 * r.candle_similarity + 0.4 * r.story_similarity, abs=2e-6)
    assert pd.Series(rows["rank"]).tolist() == sorted(rows["rank"])


def test_every_reference_time_is_replayed(spark, monkeypatch):
    """A time whose candles are less like the current ones may have a story that is more so: no time is left out before stories are told."""
    monkeypatch.setattr(catalog, "POOL", 5)
    sf = "/root/testdata/sf0.01"
    with scratch(spark):
        rows = catalog.replayed(spark, sf, "1h")
        times = catalog.mt.synchronized(catalog.compared_all(spark, sf), "1h").where("synchronization = 'EXACT'").groupBy("reference_timestamp").agg(F.avg("similarity").alias("s")).collect()
        best = catalog.replay_matches(rows, "1h").collect()
        told = rows.where("synchronization = 'EXACT'").groupBy("reference_timestamp").agg(F.avg("story_similarity").alias("t")).collect()
    own = {r.reference_timestamp: r.s for r in times}
    assert len(own) > 5 and {r.reference_timestamp for r in told} == {*own}
    want = sorted((0.6 * own[r.reference_timestamp] + 0.4 * r.t for r in told), reverse=True)[:25]
    assert [r.combined_similarity for r in sorted(best, key=lambda r: r.rank)] == pytest.approx(want, abs=1e-9)
    place = {t: i for i, t in enumerate(sorted(own, key=lambda t: (-round(own[t], 9), t)), 1)}
    assert all(r.screen_rank == place[r.reference_timestamp] for r in best) and max(r.screen_rank for r in best) > 5


def test_windows_of_keys_are_told_as_among_all(spark, sf):
    with scratch(spark):
        candles = written(catalog.src.series(spark, sf), "candles")
        last = candles.groupBy("symbol", "timeframe").agg(F.max("idx").alias("end"))
        keys = last.unionByName(candles.where("idx % 37 = 0").select("symbol", "timeframe", F.col("idx").alias("end"))).distinct()
        assert catalog.wd.seen_from(candles, last, 83).count() == sum(min(r.end, 83) + 1 for r in last.collect())
        columns = ["symbol", "end", "last", "tokens", "level_story", "range_shift", "level_count"]
        own = catalog.analysed(candles, keys).select(columns).collect()
        whole = catalog.analysed(candles).join(keys, ["symbol", "timeframe", "end"], "left_semi").select(columns).collect()
        assert len(own) > last.count() and sorted(own) == sorted(whole)


def test_windows_of_all_timeframes_are_compared_once(spark, sf, monkeypatch):
    names = []
    real = catalog.written
    monkeypatch.setattr(catalog, "written", lambda df, name: (names.append(name), real(df, name))[1])
    with scratch(spark):
        found = catalog.compared_all(spark, sf)
        assert names == ["windows", "compared"]  # and what is read next is a table
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0
