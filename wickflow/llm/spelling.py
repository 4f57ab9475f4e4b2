"""Groups spelling variants: words at one edit from a far more frequent one.

Words are counted where the texts are: a task sums its own counts before they are shuffled. Two words at one edit share one of their three
rarest bigrams, at places that differ by one at most: an edit destroys two bigrams at most, so of three one is left, and in words that are
sorted by one global order of bigrams (rare first, then the place) one that is left must be among the first three of both. So each word
goes under three keys, of the bigram, its place and the word's length, and looks under those of its own length at the same place and of
the next length at the same place and the next. The letters' bits and then the edit distance are tested inside the join, so that only pairs
of near words leave it. Keys with more than a share of all entries are salted: their entries are dealt over blocks, and lookups
are sent to each.

Cases: null and empty texts have no words; a null id is empty in checksums; rows that repeat count again; words without near ones
come back with a null form; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW_ROWS, join_hot, read, scratch, written
from .token_counts import text_batches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {x: x + 32 for x in range(ord("A"), ord("Z") + 1)}
#: The shortest word in code points: the filter needs three bigrams that differ by place.
SHORTEST, RAREST_COUNT, TIMES, EVERY = 6, 5, 5, 199
#: Bigrams that one edit destroys at most, and one.
RAREST = 3
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def damaged_words(text: str, doc_id: int | None) -> Counter:
    """The words of a text; one in EVERY of its distinct words, by checksum, has lost a letter."""
    seed, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for word, n in Counter(RUN.findall(text.translate(LOWER))).items():
        if (h := zlib.crc32(word.encode(), seed)) % EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= SHORTEST:
            out[word] += n
    return out


def counted(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: how often each word of at least SHORTEST letters stands in all texts."""

    def run(batches):
        held: Counter = Counter()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for whole in batches:
            for b in text_batches(whole, 1):
                for doc_id, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    held.update(damaged_words(found, doc_id))
                    if len(held) >= HELD:
                        yield batch()
                        held.clear()
        yield batch()

    rows = docs.select(F.col(id).cast("long"), F.col(text)).where(F.col(text).isNotNull())
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(word: Column) -> Column:
    """A bit for each of 64 classes of letters; one edit changes two at most."""
    bits = F.transform(F.split(word, ""), lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(x) % 64))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def entries(words: DataFrame) -> DataFrame:
    """Each word of words (word, n) under the keys of its three rarest bigrams: word, n, size, bits, gram, at.

    Words are of the letters of RUN without A-Z, which are 90, so there are 8100 bigrams at most, and their counts are sent around.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = F.transform(places, lambda i: F.struct(F.substring("word", i, F.lit(2)).alias("gram"), i.cast("int").alias("at")))
    each = words.select("word", "n", F.length("word").alias("size"), F.explode(grams).alias("_g")).select("word", "n", "size", "_g.*")
    often = each.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = each.join(F.broadcast(often), "gram")
    first = F.slice(F.sort_array(F.collect_list(F.struct("often", "gram", "at"))), 1, RAREST)
    kept = ranked.groupBy("word", "n", "size").agg(first.alias("_g")).withColumn("bits", letters(F.col("word")))
    return kept.select("word", "n", "size", "bits", F.explode("_g").alias("_g")).select("word", "n", "size", "bits", "_g.gram", "_g.at")


def near(words: DataFrame, share: int = 256) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of words at one edit, each once; words: word, n."""
    with scratch(words.sparkSession) as keep:
        found = written(entries(words), "entries")
        total = found.count()
        # Fewer than share keys have more than their share of the entries.
        bound = max(FEW_ROWS // 10, total // share)
        sizes = found.groupBy("gram", "at", "size").agg(F.count("*").alias("_n")).where(F.col("_n") > bound)
        hot = [(r.gram, r["at"], r["size"], -(-r["_n"] // bound)) for r in sizes.collect()]
        right = found.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("bits").alias("b_bits"), "gram", "at", "size")
        # A word looks for those of its own length, each pair from its lesser word, and for those that are longer by one.
        asks = F.array(*(F.struct((F.col("at") + i).alias("at"), (F.col("size") + j).alias("size")) for i, j in ((0, 0), (0, 1), (1, 1))))
        left = found.select("word", "n", "bits", "gram", F.col("size").alias("own"), F.explode(asks).alias("_k")).select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("bits").alias("a_bits"), "own", "gram", "_k.at", "_k.size")
        if hot:
            blocks = F.coalesce(*(F.when((F.col("gram") == g) & (F.col("at") == at) & (F.col("size") == size), k) for g, at, size, k in hot), F.lit(1))
            right = right.withColumn("_block", F.pmod(F.xxhash64("b"), blocks.cast("long")))
            left = left.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
        else:
            right, left = right.withColumn("_block", F.lit(0).cast("long")), left.withColumn("_block", F.lit(0).cast("long"))
        alike = (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2) & ((F.col("own") < F.col("l.size")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
        left, right = left.alias("l"), right.alias("r")
        on = [F.col(f"l.{x}") == F.col(f"r.{x}") for x in ("gram", "at", "size", "_block")]
        pairs = left.join(right, [*on, alike]).select("a", "a_n", "b", "b_n").distinct()
        return keep(written(pairs, "near"))


def forms(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n of all words (word, n)."""
    pairs = near(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("_best"))
    out = words.join(best, "word", "left").withColumn("form_n", -F.col("_best.less"))
    is_form = F.col("form_n") >= TIMES * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("_best.form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))


def grouped(words: DataFrame) -> DataFrame:
    """forms() with root: where the forms of a word lead. Each step is TIMES as frequent, and each round doubles the steps that are followed."""
    with scratch(words.sparkSession) as keep:
        found = keep(written(forms(words), "forms"))
        links = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
        while True:
            ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
            after = written(join_hot(links, ahead, "root", "left"), "links")
            if after.where("_next IS NOT NULL").isEmpty():
                break
            links = after.select("word", F.coalesce("_next", "root").alias("root"))
        keep(after)
    return found.join(after.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as keep:
        words = keep(written(counted(read(spark, sf_dir, "documents")).where(F.col("n") >= RAREST_COUNT), "words"))
        out = keep(written(grouped(words), "variants"))
    return out.select("word", "n", "n_near", "form", "form_n", "root")
