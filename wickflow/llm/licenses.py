"""License scans: exact phrases, and fuzzy search for short notices.

A text becomes its lower-case words joined by one space. A notice with at most k edits holds one of k + 1 pieces of it
unchanged (pigeonhole), so an Aho-Corasick automaton of all pieces locates places where a notice could stand, and the regex
library's bounded-error matching decides at each of them, by itself, and gives the span. A window is hardly longer than its
notice, so the best match in it is the one that its seed belongs to, and the work grows with the number of seeds. A place begins and ends with
a word: "unlicensed" doesn't begin a notice. Of places
of one label that overlap, that of the longest notice stays, and of one notice that of fewest edits. Edits must leave a notice's telling words (the license's name, its
variant and its version) as they are, in order: another license is not a misspelt one.

Cases: null and empty texts have no words and score 0; equal places of one label are reported once for each place; rows
that repeat are scanned one by one; very long texts are read whole, in batches of few bytes or one text; columns besides the
id and the text are never read; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .token_counts import text_batches

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices, as words: their labels, and the words that tell them from other licenses.
NOTICES = {
    "licensed under the apache license version 2 0": ("apache-2.0", "apache 2 0"),
    "licensed under the apache license 2 0": ("apache-2.0", "apache 2 0"),
    "apache license version 2 0": ("apache-2.0", "apache 2 0"),
    "apache license 2 0": ("apache-2.0", "apache 2 0"),
    "apache 2 0": ("apache-2.0", "apache 2 0"),
    "licensed under the apache license version 1 1": ("apache-1.1", "apache 1 1"),
    "released under the mit license": ("mit", "mit"),
    "licensed under the mit license": ("mit", "mit"),
    "the mit license": ("mit", "the mit license"),
    "mit license": ("mit", "mit license"),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", "granted free copy"),
    "licensed under the gnu general public license version 3": ("gpl-3.0", "general 3"),
    "gnu general public license version 3": ("gpl-3.0", "general 3"),
    "gnu general public license v3": ("gpl-3.0", "general v3"),
    "gpl v3": ("gpl-3.0", "gpl v3"),
    "gplv3": ("gpl-3.0", "gplv3"),
    "licensed under the gnu general public license version 2": ("gpl-2.0", "general 2"),
    "gnu general public license version 2": ("gpl-2.0", "general 2"),
    "gnu general public license v2": ("gpl-2.0", "general v2"),
    "gpl v2": ("gpl-2.0", "gpl v2"),
    "gplv2": ("gpl-2.0", "gplv2"),
    "licensed under the gnu lesser general public license": ("lgpl", "lesser"),
    "licensed under the gnu affero general public license": ("agpl", "affero"),
    "licensed under cc by 4 0": ("cc-by-4.0", "by 4 0"),
    "cc by 4 0": ("cc-by-4.0", "cc by 4 0"),
    "licensed under cc by 3 0": ("cc-by-3.0", "by 3 0"),
    "cc by 3 0": ("cc-by-3.0", "cc by 3 0"),
    "licensed under cc by sa 4 0": ("cc-by-sa-4.0", "by sa 4 0"),
    "cc by sa 4 0": ("cc-by-sa-4.0", "cc by sa 4 0"),
    "licensed under cc by sa 3 0": ("cc-by-sa-3.0", "by sa 3 0"),
    "cc by sa 3 0": ("cc-by-sa-3.0", "cc by sa 3 0"),
    "licensed under cc by nd 4 0": ("cc-by-nd-4.0", "by nd 4 0"),
    "licensed under cc by nc 4 0": ("cc-by-nc-4.0", "by nc 4 0"),
    "licensed under cc by nc sa 4 0": ("cc-by-nc-sa-4.0", "by nc sa 4 0"),
    "licensed under cc by nc nd 4 0": ("cc-by-nc-nd-4.0", "by nc nd 4 0"),
    "licensed under a creative commons attribution license": ("cc", "creative commons attribution license"),
    "redistribution and use in source and binary forms with or without modification": ("bsd", "source binary"),
    "subject to the terms of the mozilla public license": ("mpl", "mozilla"),
}
#: One edit is allowed for so many characters of a notice.
CHARS_AN_EDIT = 12
#: Bytes of UTF-8 that words consist of, once A-Z are lower-cased: digits, letters and all beyond ASCII.
TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SPAN = "struct<label:string,exact:boolean,first_word:long,last_word:long,begin:long,end:long,edits:int,likeness:double>"


def normal(data: bytes) -> tuple[str, int]:
    """The words of UTF-8 text joined by one space, a character for each byte; their number."""
    found = data.lower().translate(TO_WORDS).split()
    return b" ".join(found).decode("latin-1"), len(found)


def edits(notice: str) -> int:
    return len(notice) // CHARS_AN_EDIT


@cache
def automaton(notices: tuple[str, ...]) -> ahocorasick.Automaton:
    """Values: (notice's number, where the piece starts in it, the piece's length)."""
    pieces: dict[str, list] = {}
    for n, notice in enumerate(notices):
        k = edits(notice) + 1
        cuts = [len(notice) * i // k for i in range(k + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            pieces.setdefault(notice[a:b], []).append((n, a, b - a))
    out = ahocorasick.Automaton()
    for piece, at in pieces.items():
        out.add_word(piece, at)
    out.make_automaton()
    return out


@cache
def pattern(notice: str) -> regex.Pattern:
    return regex.compile(f"(?b)(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits(notice)}}}(?= )")


def exact_places(text: str, phrases: dict[str, str]) -> list[tuple[str, int, int]]:
    """(label, begin, end) of each place of a phrase as whole words."""
    found, padded = [], f" {text} "
    for phrase, label in phrases.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            found.append((label, at, at + len(phrase)))
            at = padded.find(f" {phrase} ", at + 1)
    return found


def tells(words: str, telling: str) -> bool:
    """Whether words have the telling ones, in order."""
    own = iter(words.split())
    return all(any(w == x for w in own) for x in telling.split())


def fuzzy_places(text: str, notices: dict[str, tuple[str, str]]) -> list[tuple[str, int, int, int, float]]:
    """(label, begin, end, edits, likeness) of each place of a notice, which begins and ends with a word."""
    names, windows, padded = tuple(notices), {}, f" {text} "
    for end, at in automaton(names).iter(text):
        for n, start, length in at:
            windows.setdefault(n, {})[end - length + 1 - start] = None  # where the notice would begin if nothing before the seed were edited
    own: dict[str, set] = {}
    for n, begins in windows.items():
        notice, k = names[n], edits(names[n])
        label, telling = notices[notice]
        for begin in begins:
            start = max(0, begin - k)  # in text; in padded the character before it
            m = pattern(notice).search(padded[start : begin + len(notice) + k + 2])
            if m and tells(m[0], telling):
                own.setdefault(label, set()).add((-len(notice), sum(m.fuzzy_counts), start + m.start() - 1, start + m.end() - 1))
    found = []
    for label, at in own.items():
        taken: list[tuple[int, int]] = []  # sorted, apart from each other
        for size, e, a, b in sorted(at):
            i = bisect(taken, (a, b))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                taken.insert(i, (a, b))
                found.append((label, a, b, e, 1 + e / size))
    return sorted(found)


def spans(data: bytes, phrases: dict[str, str], notices: dict[str, tuple[str, str]]) -> tuple[int, list[dict]]:
    """Number of words, and all places; begin and end are offsets in the joined words, in bytes of UTF-8."""
    text, n = normal(data)
    found = [(label, True, a, b, 0, 1.0) for label, a, b in exact_places(text, phrases)] + [(label, False, a, b, e, s) for label, a, b, e, s in fuzzy_places(text, notices)]
    out, at, words = [], 0, 0
    for label, exact, a, b, e, s in sorted(found, key=lambda x: x[2]):
        words, at = words + text.count(" ", at, a), a
        out.append({"label": label, "exact": exact, "first_word": words, "last_word": words + text.count(" ", a, b), "begin": a, "end": b, "edits": e, "likeness": s})
    return n, out


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, str]] = NOTICES) -> DataFrame:
    """A row for each row of docs: id, n_words, spans."""
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("likeness", pa.float64())])))])

    def run(batches):
        for batch in (b for whole in batches for b in text_batches(whole, 1)):
            counts, found = [], []
            for data in batch.column(1).cast(pa.binary()):
                n, own = spans(data.as_py() or b"", phrases, notices)
                counts.append(n)
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, schema.field(2).type)], schema=schema)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id long, n_words long, spans array<{SPAN}>").withColumnRenamed("id", id)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["exact"])
    starts = F.transform(base, lambda x: x["first_word"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["likeness"])), F.lit(0.0)).alias("score"))
