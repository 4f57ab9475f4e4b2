"""The sample gives the first model only: every labelled row teaches, and every row set aside sets thresholds."""

import random
import zlib

import numpy as np

from wickflow.llm import toxicity


def texts(n, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("stone", "river", "cloud", "paper", "green") for b in ("house", "wind", "light", "work", "field")]
    out = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(20)]
        if i % 4 == 0:
            w[rng.randrange(20)] = rng.choice(["vilegrub", "murkoid", "zorbling", "quashery"])
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_rows_beyond_the_sample_teach(spark, monkeypatch):
    rows = texts(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = lambda flip: spark.createDataFrame([(i, 1 - y if i in flip else y) for i, _, y in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 12, 0: 12})
    monkeypatch.setattr(toxicity, "STEPS", 20)
    sample = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda t, y: sample.extend(t) or train(t, y, steps=20))
    seen = {}
    for name in ("taught_by_all", "calibrate_by_all"):
        f = getattr(toxicity, name)
        monkeypatch.setattr(toxicity, name, lambda model, df, *a, f=f, name=name: seen.setdefault(name, []).append(df.count()) or f(model, df, *a))
    first, again = (toxicity.learned(docs, labels({})) for _ in range(2))
    folds = [zlib.crc32(str(i).encode()) % 5 for i, *_ in rows]
    assert seen == {"taught_by_all": [sum(f > 1 for f in folds)] * 2, "calibrate_by_all": [sum(f == 1 for f in folds)] * 2}
    np.testing.assert_allclose(first.table, again.table, atol=1e-6)
    beyond = [i for i, t, _ in rows if folds[i] > 1 and t not in {*sample}][:40]
    other = toxicity.learned(docs, labels({*beyond}))
    assert np.abs(first.table - other.table).max() > 1e-4 and not first.speed


def test_a_pass_in_one_task_learns():
    rows = [r for r in texts(800) if r[0] % 5]
    model = toxicity.train([t for _, t, _ in rows[:8]], [y for *_, y in rows[:8]], steps=2)
    lesson = toxicity.Lesson(model, {0: [], 1: []})
    for _, t, y in rows:
        lesson.add(t, y)
    after = lesson.end()
    assert lesson.taught == len(rows)
    back = toxicity.moved(model, toxicity.flat(after) - toxicity.flat(model))
    np.testing.assert_allclose(toxicity.flat(back), toxicity.flat(after), atol=1e-5)

    def auc(m):
        held = [r for r in texts(800, 2) if r[0] % 5 == 0]
        z, y = np.array(toxicity.Scorer(m).logits([t for _, t, _ in held])[0]), np.array([r[2] for r in held])
        return (z[y == 1][:, None] > z[y == 0]).mean()

    assert auc(after) > max(0.8, auc(model))
