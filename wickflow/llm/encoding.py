"""Token ids as the tokenizer's own library gives them, from a cache of pieces that tokenizers never look across.

Two families are cut into pieces, if their file says exactly that they normalise and pre-tokenize as named here:
"dropped": white space ends every token and is dropped, so pieces are what stands between spaces;
"leading": a space before a word belongs to it, so a piece begins at each space that follows something else than white space.
Any other tokenizer gets whole texts. Each distinct piece goes through the library once while the cache lasts.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import sys
from itertools import chain

import numpy as np

from .common import sole_cache

#: Pieces that a cache holds before it starts anew; about 200 bytes each.
CACHE_PIECES = 1_000_000
#: Bytes of their text and ids, which long pieces reach first.
CACHE_BYTES = 100_000_000
#: Pieces of letters that are encoded at once.
JOINED = 500
#: Marks that are tokens of their own after letters, in both families; last characters of a sentence.
MARKS = frozenset(",.;:!?")
CLOSING = frozenset("\n.!?。！？")
#: The two pre-tokenizers, as their files describe them.
DROPPED = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPACE_AFTER_SPACE = re.compile(r"\s ")


class Pieces(dict):
    """From a piece to its number. A new one is put on the encoder's list; letters and a mark after them are two known parts."""

    def __init__(self, lead: str, owner: Encoder) -> None:
        self.lead, self.owner = lead, owner

    def __missing__(self, piece: str) -> int:
        owner = self.owner
        if piece.isalpha():
            if piece.isascii():
                if owner.kind == "dropped" and not piece.islower():
                    self[piece] = number = self[piece.lower()]  # the tokenizer lower-cases
                    return number
                owner.letters[self.lead].append(len(owner.new))
            elif piece.lower().isalpha():  # dotted capital I gets a mark in lower case
                owner.letters[self.lead].append(len(owner.new))
        elif piece[-1:] in MARKS:
            core = piece[:-1]
            if core.isalpha() and (core.isascii() or core.lower().isalpha()):
                parts = self[core], owner.first[piece[-1]]
                owner.joint[len(owner.new)] = parts
        self[piece] = number = owner.known + len(owner.new)
        owner.new.append(self.lead + piece)
        return number


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kind = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.library = lambda texts: [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            self.kind = family(json.loads(model.to_str()))
            # In either family, what marks a word of letters among the tokens of many: its last token, or its first.
            mark = {"dropped": lambda x: x.endswith("</w>"), "leading": lambda x: x.startswith("\u0120")}.get(self.kind)
            self.bounds = mark and np.array([mark(model.id_to_token(i) or "") for i in range(model.get_vocab_size())])
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces. Of the new ones, letters has the places of those of letters alone, joint the two parts of others."""
        self.known, self.held, self.new, self.letters, self.joint = 0, 0, [], {"": [], " ": []}, {}
        self.first, self.inner = Pieces("", self), Pieces(" ", self)
        self.ids, self.starts, self.closes = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, bool)

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's pieces."""
        if self.kind == "dropped":
            found = text.replace("\n", "\n ").split(" ")
            return np.fromiter(map(self.first.__getitem__, found), np.int64, len(found))
        found = text.split(" ")
        if SPACE_AFTER_SPACE.search(text):
            joined = found[:1]
            for x in found[1:]:
                if len(joined) > 1 and not joined[-1] or joined[-1][-1:].isspace():
                    joined[-1] += " " + x
                else:
                    joined.append(x)
            found = joined
        out = np.fromiter(map(self.inner.__getitem__, found[1:]), np.int64, len(found) - 1)
        return np.concatenate([[self.first[found[0]]], out])

    def learn(self) -> None:
        """Encodes the pieces that are new, and notes which end a sentence."""
        if not self.new:
            return
        found, before = self.encoded_letters(), self.known
        rest = [i for i, x in enumerate(found) if x is None and i not in self.joint]
        for i, ids in zip(rest, self.library([self.new[i] for i in rest]), strict=True):
            found[i] = ids
        own = lambda n: found[n - before] if n >= before else self.ids[self.starts[n] : self.starts[n + 1]].tolist()
        for i, (a, b) in self.joint.items():
            found[i] = own(a) + own(b)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        self.closes = np.concatenate([self.closes, np.fromiter((x[-1:] in CLOSING for x in self.new), bool, len(self.new))])
        self.known += len(self.new)
        self.held += sum(map(sys.getsizeof, self.new))
        self.new, self.letters, self.joint = [], {"": [], " ": []}, {}

    def encoded_letters(self) -> list[list[int] | None]:
        """The ids of the new pieces of letters, which are encoded many in one text and told apart by their bounds."""
        out: list = [None] * len(self.new)
        leading = self.kind == "leading"
        own = self.letters[" " if leading else ""]
        groups = [own[i : i + JOINED] for i in range(0, len(own), JOINED)]
        for group, ids in zip(groups, self.library([("" if leading else " ").join([self.new[i] for i in g]) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.bounds[ids])
            cuts = [*cuts.tolist(), len(ids)] if leading else [0, *(cuts + 1).tolist()]
            if len(cuts) == len(group) + 1:  # else this Python's letters aren't the tokenizer's; each is encoded by itself
                for i, a, b in zip(group, cuts, cuts[1:], strict=False):
                    out[i] = ids[a:b]
        return out

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The piece numbers of each text; they hold until the next batch."""
        if len(self.first) + len(self.inner) > CACHE_PIECES or self.held + self.ids.nbytes > CACHE_BYTES:
            self.clear()
        gc.disable()  # many lists live for a moment, and none in cycles
        try:
            out = [self.numbers(x) for x in texts]
            self.learn()
        finally:
            gc.enable()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.kind:
            return [np.array(x, np.uint32) for x in self.library(texts)]
        return [self.expand(x) for x in self.batch(texts)]

    def expand(self, numbers: np.ndarray) -> np.ndarray:
        starts, lengths = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.kind:
            return [len(x) for x in self.library(texts)]
        return [int((self.starts[x + 1] - self.starts[x]).sum()) for x in self.batch(texts)]


def family(file: dict) -> str | None:
    """dropped, leading or None, by the tokenizer's own description."""
    plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or re.search(r"\s", x["content"])) for x in file["added_tokens"])
    pre = file["pre_tokenizer"] or {}
    if not plain or file["model"].get("dropout") or file["model"]["type"] != "BPE":
        return None
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not file["normalizer"]:
        return "leading"
    steps = pre.get("pretokenizers", [])
    if (file["normalizer"] or {}).get("normalizers") == NORMALIZERS and len(steps) == 2 and steps[0].get("pattern") == {"Regex": DROPPED} and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]:
        return "dropped"
    return None


_encoders: dict[str, Encoder] = {}
_forget = _encoders.clear


def encoder(path: str) -> Encoder:
    """This process's encoder for a file; Spark's workers live on between tasks, and so does the cache."""
    sole_cache(_forget)
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def version(path: str) -> str:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
