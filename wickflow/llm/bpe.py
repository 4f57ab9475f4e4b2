"""Byte-pair encoding by speculation, and decoding.

An automaton over the vocabulary proposes the longest token at each place of a word, many words in one string. A proposal is right if
every token is what merging makes of its own text, and no merge ever joins two neighbours: merges inside a token don't depend on what stands
beside it until one crosses the bound. Both are tested on arrays, for all pairs of a batch at once, by undoing merges from the latest on:
each pair of symbols that meets at the bound must have no merge that comes before one of the two is merged further. Words with a pair
that fails, or that the proposal doesn't cover, are merged step by step.

Normalisation and word bounds are those of the tokenizer's file, applied by its library to each distinct piece of text once
(see encoding). Strings of added tokens inside texts become those tokens, as is the library's default.

Cases: null and empty texts have no ids; rows that repeat each come back; null ids too; texts of any length are whole; an empty table
gives no rows; other columns are not read; a file that isn't plain BPE is an error.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import read, sole_cache
from .encoding import Encoder
from .token_counts import text_batches

#: Ends each word of a batch's string; no symbol of a byte-level vocabulary.
END = "\n"
NEVER = 2**62
#: Symbols of a word that is merged without a heap.
SHORT = 40
#: Ids that a task decodes at once.
BATCH_IDS = 1_000_000


class Merges:
    """A BPE vocabulary: the tokens of words, which two each is merged from, and in which order."""

    def __init__(self, model: dict) -> None:
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(x) for x in odd):
            raise ValueError("not a plain BPE model")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        n = max(self.vocab.values()) + 1
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.n, self.orders = n, {}
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        for order, (a, b) in enumerate(pairs):
            parts = self.vocab[a], self.vocab[b]
            made = self.vocab[a + b]
            if self.rank[made] >= 0:
                raise ValueError("a token is merged in two ways")
            self.rank[made], self.left[made], self.right[made] = order, *parts
            self.orders[parts] = order, made
        made = np.flatnonzero(self.rank >= 0)
        if (np.maximum(self.rank[self.left[made]], self.rank[self.right[made]]) >= self.rank[made]).any():
            raise ValueError("a token is merged before its parts")
        keys = np.array([a * n + b for a, b in self.orders], np.int64)
        by_key = np.argsort(keys)
        self.keys, self.key_orders = keys[by_key], by_key.astype(np.int64)
        self.whole = self.self_made()
        self.words = self.automaton()

    def order_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """When the two are merged: the number of their merge, NEVER if there is none."""
        if not len(self.keys):
            return np.full(len(left), NEVER)
        keys = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_orders[at], NEVER)

    def apart(self, left: np.ndarray, right: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether merging keeps the bound between each left and right token up to a merge (its number, exclusive)."""
        out, todo = np.ones(len(left), bool), np.arange(len(left))
        while len(todo):
            joined = self.order_of(left, right) < until
            out[todo[joined]] = False
            a, b = self.rank[left], self.rank[right]
            on = ~joined & ((a >= 0) | (b >= 0))
            todo, left, right, a, b = todo[on], left[on], right[on], a[on], b[on]
            # The later of the two is undone. Of equal merges the left one comes first, so one with the same number
            # at the bound would have come before that of the right token, not before that of the left.
            undo = a > b
            until = np.where(undo, a, b + 1)
            left, right = np.where(undo, self.right[left], left), np.where(undo, right, self.left[right])
        return out

    def self_made(self) -> np.ndarray:
        """Which tokens are what merging makes of their own text."""
        made = np.flatnonzero(self.rank >= 0)
        whole = np.ones(self.n, bool)
        whole[made] = self.apart(self.left[made], self.right[made], self.rank[made])
        before = -1
        while (now := int(whole.sum())) != before:
            before = now
            whole[made] &= whole[self.left[made]] & whole[self.right[made]]
        return whole

    def automaton(self):  # noqa: ANN201
        import ahocorasick

        out = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            if self.whole[i]:
                plain = token.removesuffix(self.suffix) if self.suffix else token
                out.add_word(plain + END if plain != token else token, (i, len(plain) + (plain != token)))
        out.make_automaton()
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        text = END.join(words) + END
        found = list(self.words.iter_long(text))
        ids = np.fromiter((x[0] for _, x in found), np.int64, len(found))
        sizes = np.fromiter((x[1] for _, x in found), np.int64, len(found))
        ends = np.fromiter((e for e, _ in found), np.int64, len(found)) + 1
        bounds = np.cumsum([len(x) + 1 for x in words])  # after each word's END
        word = np.searchsorted(bounds, ends - 1, side="right")
        covered = np.bincount(word, sizes, len(words)) == np.diff(bounds, prepend=0) - (not self.suffix)
        pairs = np.flatnonzero(word[1:] == word[:-1])
        apart = self.apart(ids[pairs], ids[pairs + 1], np.full(len(pairs), NEVER))
        right = covered.copy()
        right[word[pairs[~apart]]] = False
        starts = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        ids = ids.tolist()
        return [ids[starts[i] : starts[i + 1]] if ok else self.merged(words[i]) for i, ok in enumerate(right.tolist())]

    def merged(self, word: str) -> list[int]:
        """The ids of one word by its merges in order: of those at hand the first by number, then by place."""
        symbols: list[int | None] = [self.vocab[x] for x in [*word[:-1], word[-1] + self.suffix]] if word else []
        n = len(symbols)
        if n <= SHORT:
            return self.merged_short(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.orders[a, b][0], i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (a, b) in self.orders]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.orders[a, b][1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (own := self.orders.get((symbols[x], symbols[y]))):
                    heapq.heappush(heap, (own[0], x, symbols[x], symbols[y]))
        return [x for x in symbols if x is not None]

    def merged_short(self, symbols: list[int]) -> list[int]:
        """The same by looking at all pairs each time, which few symbols make faster than a heap."""
        none = (NEVER, None)
        found = [self.orders.get(x, none) for x in zip(symbols, symbols[1:], strict=False)]
        while found and (best := min(found))[1] is not None:
            i = found.index(best)
            symbols[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = self.orders.get((symbols[i - 1], best[1]), none)
            if i < len(found):
                found[i] = self.orders.get((best[1], symbols[i + 1]), none)
        return symbols


class Speculative(Encoder):
    """An encoder whose pieces are encoded here; the library normalises and finds the words."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        file = json.loads(model.to_str())
        self.merges, self.normalizer, self.splitter = Merges(file["model"]), model.normalizer, model.pre_tokenizer
        added = sorted(file["added_tokens"], key=lambda x: -len(x["content"]))
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added):
            raise ValueError("added tokens of a kind that isn't known here")
        self.added = {x["content"]: x["id"] for x in added}
        self.cuts = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if added else None
        self.decoder = file["decoder"]["type"] if file["decoder"] else None
        if self.decoder not in (None, "ByteLevel"):
            raise ValueError("a decoder that isn't known here")
        tokens = {i: x for x, i in (self.merges.vocab | self.added).items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.library = self.speculate
        self.known_ids = np.array([x != "" for x in self.tokens])
        self.parts = pa.array(self.tokens, pa.string()) if self.decoder is None else pa.array([self.raw(x) for x in self.tokens], pa.binary())

    def words_of(self, text: str) -> list[str | int]:
        """The words of a text in the vocabulary's symbols, and ids of added tokens."""
        out: list = []
        for part in self.cuts.split(text) if self.cuts else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif self.kind == "dropped" and part.isascii() and part.islower() and part.replace(" ", "").isalpha():
                out += part.split()  # letters that normalisation leaves alone, and words that are their own symbols
            elif part:
                plain = self.normalizer.normalize_str(part) if self.normalizer else part
                out += [x for x, _ in self.splitter.pre_tokenize_str(plain) if x] if self.splitter else [plain]
        return out

    def speculate(self, texts: list[str]) -> list[list[int]]:
        split = [self.words_of(x) for x in texts]
        distinct = list(dict.fromkeys(w for words in split for w in words if isinstance(w, str)))
        known = dict(zip(distinct, self.merges.encode(distinct), strict=True)) if distinct else {}
        return [[i for w in words for i in (known[w] if isinstance(w, str) else (w,))] for words in split]

    @staticmethod
    def raw(token: str) -> bytes:
        """The bytes that a byte-level token stands for; one with other characters stands for itself."""
        try:
            return bytes(SYMBOLS[x] for x in token)
        except KeyError:
            return token.encode()

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Each list's text as the library's decode with skip_special_tokens=False; ids that it doesn't know are left out, null has none."""
        sizes, flat = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        known = (flat >= 0) & (flat < len(self.tokens))
        known[known] = self.known_ids[flat[known]]
        ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes)])]
        parts = self.parts.take(pa.array(flat[known]))
        each = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
        if self.decoder is None:
            return pc.binary_join(each, " ")
        return pa.array([x.decode("utf-8", "replace") for x in pc.binary_join(each, b"").to_pylist()], pa.string())


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of byte-level vocabularies stands for: itself if printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [x for x in range(256) if x not in printable]
    return {chr(x): x for x in printable} | {chr(0x100 + i): x for i, x in enumerate(others)}


SYMBOLS = byte_symbols()
_coders: dict[str, Speculative] = {}
_forget = _coders.clear


def coder(path: str) -> Speculative:
    sole_cache(_forget)
    if path not in _coders:
        _coders.clear()
        _coders[path] = Speculative(path)
    return _coders[path]


def encoded(own: Speculative, whole: pa.RecordBatch, id: str):
    """Batches of id and ids for a batch of id and text."""
    for b in text_batches(whole, 1):
        found = own.encode(b.column(1).to_pylist())
        ends = np.cumsum([0, *map(len, found)])
        values = pa.array(np.concatenate(found).astype(np.int32) if len(found) else [], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[id, "ids"])


def decoded(own: Speculative, whole: pa.RecordBatch, ids: str):
    """The batch in parts of about BATCH_IDS ids, with the column decoded."""
    at = whole.schema.get_field_index(ids)
    sizes = np.cumsum(whole.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(sizes // BATCH_IDS)) + 1).tolist(), whole.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = whole.slice(a, b - a)
        yield part.append_column("decoded", own.decode(part.column(at)))


def mapped(docs: DataFrame, id: str, text: str, run, more: str = "") -> DataFrame:  # noqa: ANN001
    rows = docs.select(F.col(id), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"{id} {docs.schema[id].dataType.simpleString()}, ids array<int>{more}")


def encode(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, and ids: the tokens of each row's whole text."""

    def run(batches):
        own = coder(tokenizer)
        for whole in batches:
            yield from encoded(own, whole, id)

    return mapped(docs, id, text, run)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """rows with the column decoded: the text of ids (null: no ids)."""

    def run(batches):
        own = coder(tokenizer)
        for whole in batches:
            yield from decoded(own, whole, ids)

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("decoded", StringType()))


def round_trip(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass: a task keeps one Python process, with one coder, for both ways."""

    def run(batches):
        own = coder(tokenizer)
        for whole in batches:
            for b in encoded(own, whole, id):
                yield from decoded(own, b, "ids")

    return mapped(docs, id, text, run, ", decoded string")


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
