"""Spelling variants against plain Python: every occurrence counted one by one, near words found by what is left after a deletion."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from wickflow.llm import spelling

SCHEMA = "doc_id long, text string"


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_words(words):
    by_rest = defaultdict(set)
    for w in words:
        for rest in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_rest[rest].add(w)
    near = defaultdict(set)
    for group in by_rest.values():
        for a in group:
            near[a] |= {b for b in group if distance_one(a, b)}
    return near


def brute(docs, least):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    near, form = near_words(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def result(spark, folder):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.op13_spelling_variants(spark, folder).collect()}


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs, 5)
    assert len(want) > 1000 and sum(x[2] is not None for x in want.values()) > 50
    assert result(spark, sf) == want


@pytest.mark.parametrize("few", [100_000, 100])
def test_words_alike_of_one_bigram_and_chains(spark, tmp_path, monkeypatch, few):
    """Words of two letters share almost all bigrams, and many places; forms lead on over several steps."""
    monkeypatch.setattr(spelling, "FEW_ROWS", few)
    monkeypatch.setattr(spelling, "HELD", 50)
    rng = random.Random(6)
    words = ["".join(rng.choice("aab") for _ in range(rng.randrange(6, 10))) for _ in range(400)] + ["aaaaaaa", "aaaaaa", "éÀÿàâä", "éÀÿàâ", "ABCdefg"]
    chain = ["ijklmnop"[:k] for k in (6, 7, 8)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(150)]
    docs += [(1000, " ".join(chain[0:1] * 5 + chain[1:2] * 30 + chain[2:3] * 200)), (1001, None), (None, "words words-words wordsx wordsy " * 9), (1002, ""), (1003, "x" * 100_000), (1001, "again " * 7)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(docs, 5)
    assert want["ijklmn"][4] == "ijklmnop" and result(spark, str(tmp_path)) == want


def test_keys_with_many_entries_are_salted(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FEW_ROWS", 10)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(10)) for _ in range(500)})
    got = {(r.a, r.b) for r in spelling.near(spark.createDataFrame([(w, 9) for w in words], "word string, n long"), share=10**6).collect()}
    near = near_words(words)
    assert {tuple(sorted(x)) for x in got} == {tuple(sorted((a, b))) for a in words for b in near[a]} and len(got) == len({tuple(sorted(x)) for x in got})


def test_odd_and_empty_tables(spark, odd, empty):
    assert spelling.counted(odd.drop("n_chars")).count() > 0
    assert spelling.grouped(spelling.counted(empty)).collect() == []
