"""Exact search among vectors against scores of all pairs, in plain Python that shares no code with the library."""

import math
import random
from collections import defaultdict

import pytest

from wickflow.operators import vectors

SCHEMA = "id long, lookback long, vector array<double>"


def warped(a, b):
    rows = [[math.inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    rows[0][0] = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = abs(x - y) + min(rows[i - 1][j], rows[i][j - 1], rows[i - 1][j - 1])
    return rows[-1][-1]


def z(v):
    m = sum(v) / len(v)
    s = math.sqrt(sum((x - m) ** 2 for x in v) / len(v)) + 1e-9
    return [(x - m) / s for x in v]


def ensemble(a, b):
    n, x, y = math.sqrt(len(a)), z(a), z(b)
    sizes = math.sqrt(sum(i * i for i in x)) * math.sqrt(sum(i * i for i in y))
    alike = (sum(i * j for i, j in zip(x, y, strict=True)) / sizes + 1) / 2 if sizes else 0.5
    return 0.30 / (1 + math.dist(x, y) / n) + 0.45 * alike + 0.25 / (1 + warped(a, b) / n)


def waves(rng, many, sizes):
    """Waves of every shift, with noise, level and scale of their own."""
    out = []
    for i in range(many):
        n, level, scale = rng.choice(sizes), rng.uniform(-2, 2), rng.choice([0.1, 1, 5])
        out.append((i, rng.choice([5, 10, 10, None]), [level + scale * (math.sin(t / 3 + i / 9) + rng.gauss(0, 0.4)) for t in range(n)]))
    return out


def brute(rows, queries, k, least):
    out = defaultdict(list)
    for q, lookback, asked in queries:
        scored = [(-round(s, 9), i) for i, own, v in rows if i != q and len(v) == len(asked) and (lookback is None or own == lookback) and (s := ensemble(asked, v)) >= least]
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return {q: x for q, x in out.items() if x}


def result(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        out[r.query_id].append((r.id, round(r.ensemble, 9)))
    return dict(out)


@pytest.mark.parametrize(("k", "least", "piece", "block", "warps"), [(3, 0.0, 4000, 500, 64), (3, 0.0, 7, 2, 1), (10, 0.8, 20, 3, 4), (200, 0.0, 50, 50, 16)])
def test_search_equals_all_pairs(spark, monkeypatch, k, least, piece, block, warps):
    for name, x in (("PIECE", piece), ("BLOCK", block), ("WARPS", warps)):
        monkeypatch.setattr(vectors, name, x)
    rows = waves(random.Random(8), 120, [24, 24, 25, 1])
    rows += [(500, 10, [3.0] * 24), (501, 10, rows[0][2]), (502, 10, rows[0][2])]
    queries = [(i, lookback if i % 2 else None, v) for i, lookback, v in rows[:12]] + [(900, 77, rows[0][2]), (901, 10, [1.0, 2.0]), (902, 10, [2.0] * 24)]
    given = spark.createDataFrame([*rows, (600, 10, None), (601, 10, [])], SCHEMA)
    asked = spark.createDataFrame([*queries, (903, 10, None)], SCHEMA.replace("id long", "query_id long", 1))
    assert result(vectors.search(given, asked, k, least).collect()) == brute(rows, queries, k, least)


def test_bounds_spare_most_warping(spark):
    rows = waves(random.Random(9), 600, [24])
    given = spark.createDataFrame(rows, SCHEMA)
    asked = given.where("id < 5").withColumnRenamed("id", "query_id").withColumn("lookback", vectors.F.lit(None).cast("long"))
    effort = vectors.search(given, asked, k=3, effort=True).collect()
    assert len(effort) == 5 and all(r.compared == 600 for r in effort) and sum(r.warped for r in effort) < 600 * 5 / 3


def test_least_warping_is_no_more_than_warping():
    rng = vectors.np.random.default_rng(10)
    for n in (1, 2, 3, 24):
        v, q = rng.normal(0, 1, (50, n)), rng.normal(0, 2, n)
        assert all(low <= warped(list(q), list(x)) + 1e-9 for low, x in zip(vectors.warp_least(q, v), v, strict=True))


def test_warping_of_pairs_of_other_lengths(spark):
    rng = random.Random(11)
    pairs = [([rng.gauss(0, 1) for _ in range(rng.randrange(1, 6))], [rng.gauss(0, 1) for _ in range(rng.randrange(1, 6))]) for _ in range(60)] + [(None, [1.0]), ([1.0], None)]
    found = spark.createDataFrame(pairs, "a array<double>, b array<double>").withColumn("d", vectors.dtw_distance("a", "b")).collect()
    assert len(found) == 62
    for r in found:
        assert r.d is None if r.a is None or r.b is None else r.d == pytest.approx(warped(r.a, r.b), abs=1e-12)


def test_index_is_added_to_and_filtered(spark, tmp_path):
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    up, down = [float(x) for x in range(20)], [float(-x) for x in range(20)]
    ask = lambda lookback: spark.createDataFrame([(-1, lookback, up)], SCHEMA.replace("id long", "query_id long", 1))
    assert index.search(ask(None)).collect() == []
    index.add(spark.createDataFrame([(1, 20, up, {"side": "UP"}), (2, 20, down, {"side": "DOWN"}), (3, 10, up[:10], None)], SCHEMA + ", metadata map<string,string>"))
    index.add(spark.createDataFrame([(4, 30, up), (5, 20, [x + 0.01 for x in up])], SCHEMA))
    got = index.search(ask(20), metadata=("side",)).orderBy("rank").collect()
    assert [(r.id, r.lookback, r.side) for r in got] == [(1, 20, "UP"), (5, 20, None)] and got[0].ensemble == pytest.approx(1)
    assert [r.id for r in index.search(ask(None)).orderBy("rank").collect()] == [1, 4, 5]
    assert {r.id for r in index.search(ask(20), minimum_similarity=0.0).collect()} == {1, 2, 5}


def test_pairs_out_of_reach_are_left_and_others_have_their_distance():
    rng = random.Random(12)
    for n, m in ((1, 1), (1, 5), (24, 24), (24, 17), (40, 64)):
        scale = [10.0 ** rng.randrange(-3, 4) for _ in range(50)]
        a, b = (vectors.np.array([[x * rng.gauss(0, 1) for _ in range(size)] for x in scale]) for size in (n, m))
        want = vectors.np.array([warped(list(x), list(y)) for x, y in zip(a, b, strict=True)])
        most = want * vectors.np.array([rng.choice([0.05, 0.5, 0.95, 1.0 + 1e-9, 2.0]) for _ in want])
        got = vectors.dtw_many(a, b, most)
        near = want <= most
        assert got[near] == pytest.approx(want[near], rel=1e-12) and (got[~near] > most[~near]).all()
        found = vectors.in_reach(a, b, most)
        assert found[near].all() and not found[want > 3 * most + scale].any()


def test_few_pairs_are_warped_in_double_precision_to_the_end(spark, monkeypatch):
    whole, warp = [], vectors.dtw_many

    def seen(a, b, most=None):
        if most is None:
            whole.append(len(a))
        return warp(a, b, most)

    monkeypatch.setattr(vectors, "dtw_many", seen)
    rng = vectors.np.random.default_rng(13)  # noise, of which the bounds on warping say little
    v, ids = rng.normal(0, 0.125, (1500, 64)), vectors.np.arange(1500)
    rows = list(vectors.compared(v, v[:10], ids, ids[:10], 10, 0.0, "ensemble"))
    assert len(rows) == 110 and sum(whole) < 10 * 1500 / 20
    for j in (0, 9):
        want = sorted((-round(ensemble(list(v[j]), list(x)), 9), i) for i, x in enumerate(v[:40]) if i != j)[:3]
        near = list(vectors.compared(v[:40], v[j : j + 1], ids[:40], ids[j : j + 1], 3, 0.0, "ensemble"))[:3]
        assert [(-round(r[5], 9), r[1]) for r in near] == want


def test_effort_counts_pairs_of_all_pieces_once_and_warps_none_twice(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 50)
    reach = vectors.in_reach
    rng = vectors.np.random.default_rng(14)
    v, ids = rng.normal(0, 0.125, (300, 64)), vectors.np.arange(300)
    seen = []
    monkeypatch.setattr(vectors, "in_reach", lambda a, b, most: (seen.append(len(a)), reach(a, b, most))[1])
    warped = sum(r[6] for r in vectors.compared(v, v[:5], ids, ids[:5], 3, 0.0, "ensemble"))
    assert warped == sum(seen) + 5 * 2 * 3  # those of the best bounds, and those that go through single precision
    given = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], SCHEMA)
    effort = vectors.search(given, given.where("id < 5").withColumnRenamed("id", "query_id"), k=3, effort=True).collect()
    assert len(effort) == 5 and all(r.compared == 300 and 0 < r.warped < 300 for r in effort)
