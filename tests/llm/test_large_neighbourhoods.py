"""Texts that share signatures by chance must not grow into neighbourhoods whose parts are all compared with each other."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickflow.llm import jaccard_join


def linked_pairs(sets, percent):
    return [(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def components_of(rows, k, percent):
    """Least id reachable, for rows of distinct ids whose texts have k words or more."""
    words = [t.split() for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in words]
    label = {i: i for i, _ in rows}
    for i, j in linked_pairs(sets, percent):
        a, b = label[rows[i][0]], label[rows[j][0]]
        label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_keep_linked_sets_together(percent):
    rng = random.Random(percent)
    for n in (1, 2, 3, 5, 8, 13, 40, 150, 600):  # sets with a signature in common are of like sizes
        sets = []
        for _ in range(8):
            base = [rng.getrandbits(63) for _ in range(n)]
            sets += [{*base}, *({*rng.sample(base, n - cut), *(rng.getrandbits(63) for _ in range(more))} for cut, more in [(n // 10, 0), (n // 12, n // 12), (0, n // 6)])]
        tokens = [np.sort(np.array([*x], np.uint64)) for x in sets]
        labels = jaccard_join.neighbours(np.array([len(x) for x in sets]), [jaccard_join.sketch(x) for x in tokens], percent)
        pairs = linked_pairs(sets, percent)
        assert len(pairs) >= 16 and all(labels[i] == labels[j] for i, j in pairs)
        assert len({*labels.tolist()}) >= 8 - (n < 8) * 7


def test_chance_makes_no_large_neighbourhood(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    phrase = "one and the same"
    rows = []
    for i in range(400):
        w = [word() for _ in range(20)]
        text = " ".join([*w[:10], phrase, *w[10:]])
        rows += [(2 * i, text)] + ([(2 * i + 1, f"{text} {word()}")] if i % 20 == 0 else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    largest = []
    resolve = jaccard_join.resolve
    monkeypatch.setattr(jaccard_join, "COMMON_IN", 0.4)  # the phrase counts as rare, as one of a 1600th of very many texts does
    monkeypatch.setattr(jaccard_join, "resolve", lambda units, *a: largest.append(units.groupBy("pod").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0]) or resolve(units, *a))
    want = components_of(rows, 4, 85)
    for loose in (20, 10**9):
        monkeypatch.setattr(jaccard_join, "LOOSE", loose, raising=False)
        assert {r.doc_id: r.component_id for r in jaccard_join.join_components(docs, 4, 85).collect()} == want
    assert largest[0] <= 3 and largest[-1] > 20
    assert sum(k != v for k, v in want.items()) == 20


def test_signatures_of_one_text_a_class(spark, monkeypatch):
    """Most rows are copies: these give no signatures, and are linked with what the first of them is linked with."""
    rng = random.Random(5)
    rows = []
    for i in range(30):
        w = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)]
        rows += [(10 * i + j, " ".join(w)) for j in range(5)] + [(10 * i + j, " ".join([*w, "more"])) for j in (5, 6)]
    seen = []
    hubs = jaccard_join.hubs
    monkeypatch.setattr(jaccard_join, "hubs", lambda docs, *a: seen.append(docs.count()) or hubs(docs, *a))
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows} and seen == [60]


def test_all_neighbourhoods_taken_apart(spark, odd, monkeypatch):
    from test_other_operators import brute_components, near_copies

    monkeypatch.setattr(jaccard_join, "LOOSE", 1, raising=False)
    rows = near_copies(random.Random(8), 60) + [(r.doc_id if r.doc_id is None else r.doc_id + 10_000, r.text) for r in odd.collect()]
    got = Counter(map(tuple, jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()))
    assert got == brute_components(rows, 4, 85)
