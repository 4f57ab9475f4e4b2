"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Everything that touches rows is a DataFrame expression. The votes of all rows are counted by vote pattern (at most
3 to the number of rules patterns, whatever the corpus's size); EM runs over those counts.

Cases: null text counts as empty and fails the base rule; empty tables give no rows; repeated rows are judged alike, one
by one; other columns, also ones named like a measure, stay untouched in `filter_quality`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, read, scratch, words, written

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = [
    "the", "of", "and", "to", "in", "is", "was", "for", "with", "that", "by", "on", "it", "as", "at", "this", "be", "are", "or", "not",
    "der", "die", "das", "und", "den", "von", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "zu",
    "le", "la", "les", "et", "des", "en", "un", "une", "du", "que", "dans", "pour", "qui", "est", "sur", "par", "pas", "de",
    "el", "los", "las", "y", "por", "con", "para", "del", "se", "una", "al", "lo", "como", "su",
]
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
EM_ROUNDS = 30
#: A rule's votes are right in at most, and on good and on bad rows in at least, these shares.
ACCURACY, ACCURACY_LEAST = (0.0, 0.995), (0.6, 0.1)


def measures(docs: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """docs with the measures that the rules read, as columns of that prefix."""
    p, t = prefix, F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(f"{p}w", words(F.col(text)))
    w, n = f"{p}w", F.size(f"{p}w")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col(w), i + k) for k in range(WINDOW))))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    out = out.withColumns({f"{p}g": F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")), f"{p}l": lines})
    # Positions of windows found twice, in order; each adds the words that the one before has not covered.
    covered = F.expr(f"""
        transform(array(sort_array(transform({p}g, (h, i) -> struct(h AS h, i AS i)))), s ->
          aggregate(sort_array(transform(filter(s, (e, j) -> (j > 0 AND s[greatest(j - 1, 0)].h = e.h) OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = e.h)), e -> e.i)),
            named_struct('last', -{WINDOW}, 'n', 0), (a, i) -> named_struct('last', i, 'n', a.n + least({WINDOW}, i - a.last)), a -> a.n))[0]""")
    less = lambda of: F.length(t) - F.length(F.regexp_replace(t, of, ""))
    return out.withColumns({
        f"{p}n_words": n.cast("long"),
        f"{p}word_chars": F.length(F.regexp_replace(t, SPACE_RUN, "")).cast("long"),
        f"{p}n_symbols": less(SYMBOLS).cast("long"),
        f"{p}n_lines": F.size(f"{p}l").cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
        f"{p}n_repeat_words": F.when(F.size(F.array_distinct(f"{p}g")) < F.size(f"{p}g"), covered).otherwise(0).cast("long"),
        f"{p}n_ends": less("[.!?]").cast("long"),
        f"{p}n_function": F.size(F.array_intersect(F.col(w), F.lit(FUNCTION_WORDS))).cast("long"),
    }).drop(w, f"{p}g", f"{p}l")


def rules(prefix: str = "_q_") -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains."""
    c = lambda k: F.col(f"{prefix}{k}")
    n = c("n_words")
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": vote(n < 10, n >= 40),
        "symbols": vote(c("n_symbols") * 100 > n * 10, c("n_symbols") * 100 <= n * 3),
        "lines": vote((c("n_lines") >= 3) & (c("n_dup_lines") * 100 > c("n_lines") * 30), F.lit(False)),
        "repeats": vote(c("n_repeat_words") * 100 > n * 20, F.lit(False)),
        "word_length": vote((c("word_chars") > n * 12) | (c("word_chars") < n * 2), F.lit(False)),
        "symbol_share": vote(c("n_symbols") * 100 > c("word_chars") * 5, F.lit(False)),
        "function_words": vote((n >= 20) & (c("n_function") == 0), c("n_function") * 10 >= F.least(n, F.lit(30))),
        "sentences": vote((n >= 40) & (c("n_ends") * 100 < n), (n >= 10) & (c("n_ends") * 40 >= n) & (c("n_ends") * 3 <= n)),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Share of good rows, and for each rule how often its votes on good and on bad rows are right, by EM over (votes, count).

    Rules are independent given the class; abstaining says nothing. It starts from rows with any bad vote as likely bad.
    """
    k = len(patterns[0][0]) if patterns else 0
    patterns = sorted(patterns)
    belief = [0.1 if min(votes) < 0 else 0.95 for votes, _ in patterns]
    total = sum(n for _, n in patterns)
    prior, accuracy = 0.8, [(0.8, 0.8)] * k
    for _ in range(rounds if total else 0):
        good = 1.0
        right, cast = [[1.8, 1.2] for _ in range(k)], [[2.0, 2.0] for _ in range(k)]
        for (votes, n), p in zip(patterns, belief, strict=True):
            good += n * p
            for i, v in enumerate(votes):
                if v:
                    cast[i][0] += n * p
                    cast[i][1] += n * (1 - p)
                    right[i][v < 0] += n * (p if v > 0 else 1 - p)
        prior = min(max(good / (total + 2), 0.5), 0.98)
        accuracy = [tuple(min(max(r / c, low), ACCURACY[1]) for r, c, low in zip(right[i], cast[i], ACCURACY_LEAST, strict=True)) for i in range(k)]
        belief = [posterior(votes, prior, accuracy) for votes, _ in patterns]
    return prior, accuracy


def weights(accuracy: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """What a good and a bad vote of each rule add to the log odds of good quality; a vote never speaks for the other class."""
    return [(max(0.0, math.log(g / (1 - b))), min(0.0, math.log((1 - g) / b))) for g, b in accuracy]


def posterior(votes: tuple[int, ...], prior: float, accuracy: list[tuple[float, float]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(w[v < 0] for v, w in zip(votes, weights(accuracy), strict=True) if v)
    return 1 / (1 + math.exp(-odds))


def judged(docs: DataFrame, text: str = "text", prefix: str = "_q_", threshold: float = 0.5) -> DataFrame:
    """docs with the measures, base_failed, posterior (probability of good quality) and kept, as columns of that prefix."""
    return decided(measures(docs, text, prefix), measures(docs.select(text), text, prefix), prefix, threshold)


def decided(measured: DataFrame, corpus: DataFrame, prefix: str = "_q_", threshold: float = 0.5) -> DataFrame:
    """measured with base_failed, posterior and kept, by the votes counted over the measured rows of corpus."""
    votes = rules(prefix)
    counted = corpus.select(*(v.cast("int").alias(k) for k, v in votes.items())).groupBy(*votes).count()
    prior, accuracy = fit([(tuple(r[:-1]), r[-1]) for r in counted.collect()])
    accuracy = accuracy or [(0.8, 0.8)] * len(votes)  # an empty table has no pattern
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, (good, bad) in zip(votes.values(), weights(accuracy), strict=True):
        odds = odds + F.when(v > 0, good).when(v < 0, bad).otherwise(0.0)
    n, rep = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    out = measured.withColumn(f"{prefix}base_failed", (n < 10) | (rep * 100 > n * 20)).withColumn(f"{prefix}posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}posterior") >= threshold))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs. Each row is measured once: rows and measures are written and read twice."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"))  # so no column of docs can clash with a measure
    with scratch(docs.sparkSession) as keep:
        measured = keep(written(measures(whole, f"_row.{text}"), "measured"))
    return decided(measured, measured).where("_q_kept").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures are small beside the texts, so they are written once and read twice."""
    measured = written(measures(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "op7")
    out = decided(measured, measured)
    return out.select("doc_id", *(F.col(f"_q_{k}").alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")))
