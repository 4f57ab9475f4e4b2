"""Operators on documents must find all there is: places of notices, labelled rows to learn from, links."""

from wickflow.llm import jaccard_join, licenses, toxicity


def test_edited_notice_before_a_better_one():
    notice = "released under the mit license"
    for text, want in [
        ("released under the mit licence released under the mit license x", [(0, 30), (31, 61)]),
        ("released under the mit licence released under the mit lisence released under the mit license released under teh mit license", [(0, 30), (31, 61), (62, 92), (93, 123)]),
    ]:
        found = licenses.fuzzy_places(text, {notice: ("mit", "mit")})
        assert [(a, b) for _, a, b, _, _ in found] == want and min(e for *_, e, _ in found) == 0


def test_sample_is_of_the_labels_that_docs_have(spark, monkeypatch):
    """docs is a small part of a large labels table, and has enough labelled rows of its own."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(0, 2000, 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 50 % 2) for i in range(2000)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 8, 0: 10})
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append(labels))
    monkeypatch.setattr(toxicity, "calibrate", lambda model, texts, labels, weights: seen.append(labels))
    toxicity.learned(docs, labels)
    found = sum(seen, [])
    assert (found.count(1), found.count(0)) == (8, 10)


def test_ids_that_repeat_with_other_texts_keep_their_links(spark):
    a, t, u = (" ".join(f"{x}{i}" for i in range(60)) for x in "atu")
    rows = [(3, a), (5, a), (5, t), (7, f"{t} more"), (9, ""), (9, u), (9, None), (10, f"{u} more"), (11, "alone in this table of texts")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard_join.join_components(docs, 4, 85).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (9, 9), (10, 9), (11, 11)}


def test_a_text_beyond_the_budget_takes_nothing_from_others(monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", {1: 100, 0: 50})
    ids = [(1, 1), (2, 1), (3, 0), (4, 1), (5, 0), (6, 1)]
    assert sorted(toxicity.within(ids, {1: 5000, 2: 60, 3: 80, 4: 50, 5: 70, 6: 40})) == [(2,), (5,), (6,)]


def test_one_huge_labelled_text_leaves_the_others_taught(spark, monkeypatch):
    rows = [(i, "bad " * 20 if i % 2 else "good " * 20) for i in range(1, 80)] + [(1000 + i, "bad " * 30_000) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(text like 'bad%' as int) as toxic")
    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", {1: 100_000, 0: 100_000})
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.extend(texts))
    monkeypatch.setattr(toxicity, "calibrate", lambda model, texts, labels, weights: seen.extend(texts))
    toxicity.learned(docs, labels)
    assert len(seen) == sum(1 for i, _ in rows[:79] if toxicity_fold(i)) and max(map(len, seen)) < 200


def toxicity_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 != 0


def test_differing_texts_under_one_id_all_stay(spark):
    """Only what is near a text of lesser id (or hash, under one id) goes, whichever rows share an id; reruns keep the same rows."""
    a, t, u, v = (" ".join(f"{x}{i}" for i in range(60)) for x in "atuv")
    rows = [(1, a, "x"), (1, t, "x"), (2, f"{a} more", "x"), (3, f"{u} more", "x"), (3, u, "x"), (3, u, "y"), (4, v, "x"), (None, a, "x"), (None, a, "x"), (5, "", "x"), (5, None, "x"), (6, f"{t} end", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = [tuple(r) for r in jaccard_join.one_of_each(docs).collect()]
    texts = [(i, x) for i, x, _ in kept]
    assert sorted(x for x in texts if x[0] in (1, 2, 4, 6)) == [(1, a), (1, t), (4, v)]
    assert [x for i, x in texts if i == 3] in ([u], [f"{u} more"]) and texts.count((None, a)) == 2 and len([x for x in texts if x[0] == 5]) == 1
    for n in (1, 3):
        assert sorted(map(str, jaccard_join.one_of_each(docs.repartition(n)).collect())) == sorted(map(str, jaccard_join.one_of_each(docs).collect()))
