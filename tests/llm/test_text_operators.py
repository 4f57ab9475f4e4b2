"""Mixing, fingerprints, packing, token counts, quality rules and license scans against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wickflow.llm import common, fingerprints, licenses, mixing, packing, quality, queries, token_counts
from wickflow.llm.encoding import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    with duckdb.connect() as db:
        for t in ("documents", "pages", "labels", "conversations"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = db.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    key = want.columns[0]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True), check_dtype=False)


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = random.Random(12)
    rows = [(i, "w " * int(1 + 1.01 ** rng.randrange(500)), "abc"[0 if i % 3 else i % 2 + 1]) for i in range(3000)] + [(9000 + i, "w " * 400, "few") for i in range(5)]
    docs = mixing.keyed(spark.createDataFrame(rows, "doc_id long, text string, source string"), "text")
    sizes = docs.select("doc_id", "source", "_key", "_unit", common.n_words(docs.text).alias("size"))
    out = sizes.join(mixing.copies(sizes, mixing.targets(sizes)), ["_key", "_unit"]).toPandas()
    again = mixing.copies(sizes.repartition(7), mixing.targets(sizes.repartition(3))).toPandas()
    assert dict(zip(out._unit, out._copies, strict=True)) == dict(zip(again._unit, again._copies, strict=True))
    by = out.assign(taken=out._copies * out["size"]).groupby("source").agg(size=("size", "sum"), target=("_target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 and (by.target <= 2 * by["size"] + 1e-9).all()
    assert (abs(by.taken - by.target) <= by.largest).all() and out._copies.max() <= 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_miss_their_targets_by_their_largest_document(spark, sf):
    docs = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "source"])
    out = mixing.op1_mix_sources(spark, f"/root/testdata/{sf}").toPandas().merge(docs, on="doc_id")
    by = out.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    assert (abs(by.taken - by.target) <= by.largest).all()


def test_mix_takes_each_document_by_its_rate(spark):
    """Over many seeds, a document is taken as often as its rate says, whatever its size."""
    sizes = spark.createDataFrame([("=a", str(i), "a", 1 + i * i) for i in range(10)] + [("=b", str(i), "b", 50) for i in range(10)], "_key string, _unit string, source string, size long")
    by_source = mixing.targets(sizes)
    rate = {r.source: r.rate for r in by_source.collect()}
    seen = Counter()
    for seed in range(60):
        for r in mixing.copies(sizes, by_source, f"seed-{seed}").collect():
            seen[r._key, r._unit] += r._copies
    assert all(abs(n / 60 - rate[key[1:]]) < 0.25 for (key, _), n in seen.items())


def test_mix_of_odd_rows(odd, empty):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and {r._key for r in out.collect()} == {"k"}
    assert mixing.mix(empty).count() == 0


def brute_measures(text):
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    more = [(100 + i, t) for i, t in enumerate(["a b c d e " * 4, "x\n\nx\n x\nx ", "a b c d e f a b c d e f g a b c d e", "1 2 3 4"])]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for r in quality.judged(docs).collect():
        assert (r._q_n_words, r._q_word_chars, r._q_n_symbols, r._q_n_dup_lines, r._q_n_repeat_words) == brute_measures(r.text or "")
        assert r._q_base_failed == (r._q_n_words < 10 or 100 * r._q_n_repeat_words > 20 * r._q_n_words) and not (r._q_base_failed and r._q_kept)


def test_quality_keeps_good_documents_and_rejects_bad_ones(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op7_quality_rules(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    good, bad = out[(out.quality == 1) & ~out.base_failed], out[out.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.15


def test_quality_filter_of_odd_rows(odd, empty):
    out = quality.filter_quality(odd)
    assert out.columns == odd.columns and {r._q_w for r in out.collect()} <= {"q"}
    assert quality.filter_quality(empty).count() == 0


def test_em_finds_the_accuracies():
    rng, rows = random.Random(5), Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        rows[tuple(0 if rng.random() < 0.2 else (1 if good else -1) * (1 if rng.random() < a else -1) for a in (0.95, 0.9, 0.85))] += 1
    prior, accuracy = quality.fit(list(rows.items()))
    assert abs(prior - 0.8) < 0.05 and all(abs(g - a) < 0.06 for (g, _), a in zip(accuracy, (0.95, 0.9, 0.85), strict=True))
    assert quality.fit([]) == (0.8, [])


def test_winnowing_is_rightmost_minimum_and_guarantees_matches():
    rng = random.Random(2)
    for n in (0, 1, 5, 15, 16, 17, 39, 40, 400):
        text = "".join(rng.choice("ab é😀") for _ in range(n))
        h = fingerprints.gram_hashes(text) >> np.uint64(32)
        w, chosen = min(fingerprints.W, len(h)), []
        for i in range(len(h) - w + 1 if len(h) else 0):
            j = max(range(i, i + w), key=lambda k: (-int(h[k]), k))
            if not chosen or chosen[-1] != j:
                chosen.append(j)
        assert fingerprints.fingerprint(text)[1].tolist() == chosen
    for _ in range(50):
        shared = "".join(rng.choice("abcdefgh ") for _ in range(fingerprints.K + fingerprints.W - 1))
        a, b = ("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) + shared + "z" * rng.randint(0, 40) for _ in range(2))
        assert set(fingerprints.fingerprint(a)[0]) & set(fingerprints.fingerprint(b)[0])


def plain_fingerprint(text, k=16, w=24):
    """Rolling hash, windows and rightmost minima in plain integers: the fingerprint as text, and its hashes."""
    m, base = 2**64, 0x9E3779B97F4A7C15
    codes = [ord(c) + 1 for c in text]
    if codes and len(codes) < k:
        codes += [0] * (k - len(codes))
    hashes = []
    for i in range(len(codes) - k + 1 if codes else 0):
        h = 0
        for c in codes[i : i + k]:
            h = (h * base + c) % m
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 % m
        hashes.append((h ^ (h >> 32)) >> 32)
    chosen = []
    for i in range(max(0, len(hashes) - w) + 1 if hashes else 0):
        j = min(range(i, min(i + w, len(hashes))), key=lambda p: (hashes[p], -p))
        if not chosen or chosen[-1] != j:
            chosen.append(j)
    return "".join(f"{hashes[j]:08x}{j:08x}" for j in chosen), {hashes[j] for j in chosen}


def test_fingerprint_query_equals_plain_python(spark):
    rng = random.Random(12)
    texts = ["", "short", "a" * 60, "été 😀 " * 9] + ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 160))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.with_next(docs, fingerprints.compare_edited, fingerprints.EDITED).collect()}
    alike = lambda a, b: len(a & b) / len(a | b) if a and b else float(not a and not b)
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        own, changed, follows = plain_fingerprint(text), plain_fingerprint(text[: len(text) - half] + after[:half]), plain_fingerprint(after)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (own[0], changed[0]) and abs(r.near_edited - alike(own[1], changed[1])) < 1e-12 and abs(r.near_next - alike(own[1], follows[1])) < 1e-12
        places = {p for j in range(0, len(own[0]), 16) if int(own[0][j : j + 8], 16) in changed[1] for p in range(int(own[0][j + 8 : j + 16], 16), int(own[0][j + 8 : j + 16], 16) + 16)}
        assert r.matched_chars == len({p for p in places if p < len(text)})


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edited_texts_follow_doc_id_order(spark, odd, parts):
    rows = [(int(i), f"text {i} " * (i % 13)) for i in np.random.default_rng(1).permutation(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text").where("doc_id is null or doc_id > 4"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = fingerprints.with_next(docs, fingerprints.compare_edited, fingerprints.EDITED).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = sorted(((r.doc_id if r.doc_id is not None else -(2**63), r.text or "") for r in docs.collect()))
    expect = Counter()
    for (i, a), (_, b) in zip(want, want[1:] + want[:1], strict=True):
        half = len(a) // 2
        expect[(None if i == -(2**63) else i, len(a), hashlib.sha256((a[: len(a) - half] + b[:half]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expect
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprints_of_an_empty_table(empty):
    assert fingerprints.with_next(empty, fingerprints.compare_edited, fingerprints.EDITED).count() == 0
    assert fingerprints.fingerprints(empty).count() == 0


ALPHABET = [" ", "  ", "\n", "\t", "\xa0", " ", "\x1c", "\x85", "'s", "'ll", "a", "B", "Σ", "é", "é", "́", "가", "ᄀ", "ᅡ", "1", "½", "!", "?!", "<|endoftext|>", "<|startoftext|>", "<|", ".", ",", "the", "İ", "ß", "ﬁ", "Å", "\0"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_cached_encoding_equals_the_library(sf, name):
    rng, path = random.Random(4), public_tokenizers.path(name)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + pd.read_parquet(f"{sf}/documents.parquet").text.tolist()
    if name.endswith(".model"):
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    else:
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    own = Encoder(path)
    for _ in range(2):
        assert [list(x) for x in own.encode(texts)] == want and own.count(texts) == [len(x) for x in want]


def test_token_cache_encodes_misses_once(spark, odd, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    for docs in (odd, odd, odd.unionByName(spark.createDataFrame([(99, "quite new")], "doc_id long, text string"), allowMissingColumns=True)):
        got = Counter(map(tuple, token_counts.count_tokens(docs, path, cache).collect()))
        assert got == Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r.text or "" for r in odd.collect()}) + 1


def test_token_counts_of_an_empty_table(empty, tmp_path):
    assert token_counts.count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "c")).count() == 0


def brute_cost(at, prices, window):
    best = {0: 0}
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= window and i in best:
                options.append(best[i] + (0 if n == window else packing.SHORT + (0 if n in (window // 2, window // 4) else window - n)) + prices[j])
        best[j] = min(options)
    return best[len(at) - 1]


def test_cuts_are_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.choice([16, 32, 12])
        at, prices = [0], [0]
        for _ in range(rng.randint(1, 25)):
            at.append(at[-1] + rng.randint(1, window))
            prices.append(rng.choice([0, 2, 24]))
        found = packing.cuts(at, prices, window)
        lengths = np.diff([0, *found])
        index = {p: i for i, p in enumerate(at)}
        cost = sum(prices[index[p]] + (0 if n == window else packing.SHORT + (0 if window & (window - 1) == 0 and n in (window // 2, window // 4) else window - n)) for p, n in zip(found, lengths, strict=True))
        if window != 12:
            assert cost == brute_cost(at, prices, window)
        assert found[-1] == at[-1] and lengths.max() <= window


def test_packing_covers_every_token_once(spark, sf, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 100000 AS doc_id", "text").where("doc_id <> 100004"))
    got = packing.pack(docs, path, keep_ids=True).toPandas()
    library = Tokenizer.from_file(path)
    for doc_id, own in got[got.doc_id.notna()].groupby("doc_id"):
        text = next(r.text for r in docs.where(f"doc_id = {int(doc_id)}").collect()) if doc_id >= 100000 else None
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == own.doc_tokens.iloc[0]
        if text is not None:
            assert [i for x in own.ids for i in x] == [*library.encode(text, add_special_tokens=False).ids, 2]
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    sequences = got.sort_values("offset").groupby("sequence_id")
    for _, own in sequences:
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
    total = sequences.length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in total)
    assert total.max() <= 4096 and padding < 0.02 * total.sum()


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def brute_base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_equals_brute_force(spark, sf, odd):
    texts = ["CC BY cc-by. cc by by", "All  rights\nRESERVED all rights reserved.", "acc by", "general public licenses", "GNU General Public License v3", "éall rights reserved", "cc by" * 3]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = Counter((r.doc_id, *brute_base(r.text or "")) for r in docs.collect())
    got = Counter()
    for r in licenses.scan(docs).collect():
        base = [x for x in r.spans if x.exact]
        starts = [x.first_word for x in base]
        got[(r.doc_id, r.n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x.label for x in base})))] += 1
    assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_notices_equal_brute_force_on_whole_words():
    """Several notices in a text, edited at random: every run of words within the bound that tells the license is found once, and nothing else."""
    rng = random.Random(8)
    for _ in range(150):
        notice = rng.choice(list(licenses.NOTICES))
        label, telling = licenses.NOTICES[notice]
        text = ""
        for _ in range(rng.randint(1, 3)):
            edited = list(notice)
            for _ in range(rng.choice([0, 1, licenses.edits(notice), licenses.edits(notice) + 2])):
                i = rng.randrange(len(edited))
                edited[i : i + 1] = rng.choice([[], [edited[i], "x"], ["y"]])
            text += rng.choice(["", "lorem ipsum dolor sit ", "un", "x "]) + "".join(edited) + rng.choice([" ", " ", "ware "])
        text = " ".join(text.split())
        k, found = licenses.edits(notice), []
        bounds = [(m.start(), m.end()) for m in re.finditer("[^ ]+", text)]
        for i, (begin, _) in enumerate(bounds):
            for _, end in bounds[i:]:
                if abs(end - begin - len(notice)) <= k and (e := distance(notice, text[begin:end])) <= k:
                    own = iter(text[begin:end].split())
                    if all(any(w == x for w in own) for x in telling.split()):
                        found.append((e, begin, end))
        places = []
        for e, begin, end in sorted(found):
            if all(begin >= b or end <= a for a, b, _ in places):
                places.append((begin, end, e))
        got = sorted((a, b, e) for _, a, b, e, _ in licenses.fuzzy_places(text, {notice: (label, telling)}))
        assert len(got) == len(places), (notice, text, got, places)
        assert all(min(b, d) - max(a, c) > len(notice) / 2 and abs(e - f) <= 1 for (a, b, e), (c, d, f) in zip(got, sorted(places), strict=True)), (text, got, places)


@pytest.mark.parametrize(("text", "want"), [
    ("licensed under CC BY-SA 4.0", ["cc-by-sa-4.0"]), ("licensed under CC BY-ND 4.0", ["cc-by-nd-4.0"]), ("licensed under CC BY-NC 3.0", []), ("Licensed under the Apache License, Version 1.1", ["apache-1.1"]),
    ("licensed undr the GNU General Public License version 2", ["gpl-2.0"]), ("released under the bsd license", []), ("unlicensed under the mit licenseware", []), ("Licensed under the Apache License 2.0", ["apache-2.0"]), ("GNU General Public License v3", ["gpl-3.0"]),
    ("under GPLv3 or the MIT License", ["gpl-3.0", "mit"]), ("CC BY 3.0", ["cc-by-3.0"]), ("see Apache-2.0, not apache 2 01", ["apache-2.0"]), ("relesed under the mit license released under the mit license released undr the mit license", ["mit"] * 3),
])
def test_other_licenses_are_no_misspelt_ones(text, want):
    found = [x["label"] for x in licenses.spans(text.encode(), licenses.PHRASES, licenses.NOTICES)[1] if not x["exact"]]
    assert found == want


def test_license_search_is_linear(monkeypatch):
    """So many searches for so many notices, each in a window of bounded length."""
    seen, real = [], licenses.pattern

    class Counting:
        def __init__(self, notice):
            self.of = real(notice)

        def search(self, text):
            seen.append(len(text))
            return self.of.search(text)

    monkeypatch.setattr(licenses, "pattern", Counting)
    for n in (100, 400):
        seen.clear()
        assert len(licenses.fuzzy_places("released undr the mit license " * n, {"released under the mit license": ("mit", "mit")})) == n
        assert len(seen) <= 4 * n and max(seen) <= 36


def test_license_scan_of_an_empty_table(empty):
    assert licenses.scan(empty).count() == 0
