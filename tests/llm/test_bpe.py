"""Speculative BPE against the library, and against merging every word step by step."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wickflow.llm import bpe, encoding

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaa", "don't I'LL it's", "<|endoftext|>x<|startoftext|> <|endoftext|", "İstanbul ﬁ naïve é", "\U0001f600\U0001f468‍\U0001f469", "tab\tnew\nline  two   ", "日本語のテキスト", "12345 6.7", "x" * 5000, "ha" * 3000, "\x00�​", "word " * 3000]


@pytest.mark.parametrize("name", FILES)
def test_round_trip_equals_the_library(spark, name):
    path = public_tokenizers.path(name)
    model = Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "etaoinshrdlu .,'-éßж漢\n"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(300)]
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] + [(-1, None, None), (5, texts[5], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    want = []
    for i, t, _ in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, model.decode(ids, skip_special_tokens=False)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", FILES)
def test_most_words_need_no_merging_and_all_equal_it(name):
    own = bpe.Speculative(public_tokenizers.path(name))
    rng = random.Random(4)
    tokens = [x for x in own.merges.vocab if x.removesuffix("</w>").isalpha()]
    words = list({"".join(rng.choice(tokens).removesuffix("</w>") for _ in range(rng.randrange(1, 4))) for _ in range(4000)})
    calls, exact = [], own.merges.merged
    own.merges.merged = lambda x: calls.append(x) or exact(x)
    got = own.merges.encode(words)
    assert got == [exact(x) for x in words] and 0 < len(calls) < len(words) / 2


def test_pairs_are_kept_apart_only_if_merging_does():
    """A small vocabulary with ties and tokens that their own text doesn't make."""
    merges = [["a", "a"], ["b", "a"], ["a", "b"], ["aa", "b"], ["ab", "c"], ["b", "c"], ["aa", "aa"], ["a", "bc"]]
    vocab = {x: i for i, x in enumerate(["a", "b", "c", *(a + b for a, b in merges if a + b != "abc"), "abc"])}
    kept = [x for x in merges if x != ["a", "bc"]]
    own = bpe.Merges({"type": "BPE", "vocab": vocab, "merges": kept})
    rng = random.Random(5)
    words = ["".join(rng.choice("aabc") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    model = Tokenizer.from_str('{"version":"1.0","truncation":null,"padding":null,"added_tokens":[],"normalizer":null,"pre_tokenizer":null,"post_processor":null,"decoder":null,"model":' + __import__("json").dumps({"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": kept}) + "}")
    assert own.encode(words) == [own.merged(x) for x in words] == [model.encode(x).ids for x in words]
    with pytest.raises(ValueError, match="two ways"):
        bpe.Merges({"type": "BPE", "vocab": vocab, "merges": merges})


def test_whole_table_equals_the_library(spark, sf):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op12_bpe_round_trip(spark, sf).collect():
        ids = model.encode(texts.pop(r.doc_id), add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False)))
    assert not texts


def test_odd_and_empty_tables(odd, odd_rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.encode(odd, path).count() == len(odd_rows) and bpe.encode(empty, path).count() == 0


def test_a_task_keeps_one_python_process(spark, sf, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    plan = bpe.op12_bpe_round_trip(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.ids)
    assert sorted(bpe.round_trip(odd, path).collect(), key=key) == sorted(bpe.decode(bpe.encode(odd, path), path).collect(), key=key)


@pytest.mark.parametrize("kind", [encoding.Encoder, bpe.Speculative])
def test_long_pieces_are_forgotten_by_their_bytes(monkeypatch, kind):
    monkeypatch.setattr(encoding, "CACHE_BYTES", 50_000, raising=False)
    own, rng, model = kind(public_tokenizers.path(FILES[0])), random.Random(6), Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    for _ in range(40):
        texts = ["".join(rng.choice("etaoin123") for _ in range(2000)) for _ in range(4)]
        assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
        assert sum(map(len, own.first)) + own.ids.nbytes < 50_000 + 4 * 2000 * 5
