"""Toxicity: a convolutional text classifier in numpy, with a threshold for each language.

A word's embedding is the sum of the hashed embeddings of itself and of its character n-grams, by the root of their number. Filters of one, two and three
words slide over the whole text; the greatest value of each goes through a linear layer to a logit. It is trained on all
labelled rows but those set aside: a sample of them (SAMPLE of each class, whole texts) gives the model that tasks start from, each task
goes over its own rows, and what they change is averaged. All rows set aside set a threshold for
each language, and the score is the logistic function of the logit less its language's threshold, so 0.5 is the cut.
The language is guessed from the text's own function words; no column but the text enters a score.

Cases: null and empty texts are scored as text without words; without labels of both classes every score is 0; labels
that are null, or of ids that documents lacks, teach nothing; an id labelled twice counts as toxic if either says so;
of an id with several texts the least one teaches; rows that repeat are scored alike, one by one; very long texts are scored whole,
in batches of few bytes or one text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import deque
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, sole_cache, written
from .token_counts import text_batches

#: Labelled rows of each class that the first model is trained on, and bytes of their texts, at most; chosen by a hash of doc_id. All others teach it after that.
SAMPLE, SAMPLE_BYTES = {1: 3000, 0: 5000}, {1: 12_000_000, 0: 20_000_000}
BUCKETS, DIM, FILTERS, WIDTHS, GRAMS = 1 << 15, 16, 8, (1, 2, 3), (3, 4, 5, 6)
COLUMNS = FILTERS * sum(WIDTHS)
STEPS, BATCH, SEED = 700, 32, 7
#: Adagrad: rates, and sums of squares to start from. A large one keeps rare n-grams from being learned by heart.
RATE = {"table": 0.5, "filters": 0.05, "bias": 0.05, "out": 0.05}
START = {"table": 1e-2, "filters": 1e-2, "bias": 1e-2, "out": 1e-2}
#: Words a worker's cache holds before it starts anew; about 400 bytes each.
CACHE_WORDS = 80_000
WORD = re.compile(r"[^\W\d_]+")
#: Function words that tell languages apart.
LANGUAGES = {
    "en": "the of and is was that with this are for it be on by".split(),
    "de": "der das und ist nicht mit den von ein eine zu auf sich".split(),
    "fr": "le et est dans pour une du pas qui sur les par au".split(),
    "es": "el los y que por con una para del se lo su como".split(),
}
OTHER = "other"


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word (with its bounds) and of the words; where each word's begin, and the end of all."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(7)
    lengths = np.array([len(x) for x in marked])
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the word's end
    found, owner = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(left >= n)
            found.append(mixed(h[at] + np.uint64(n)))
            owner.append(word[at])
    power = np.cumprod(np.full(lengths.max() if len(words) else 1, 0x9E3779B97F4A7C15, np.uint64))
    place = lengths[word] - left
    found.append(mixed(np.add.reduceat(codes * power[place], ends - lengths)))
    owner.append(np.arange(len(words)))
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return found[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def means(table: np.ndarray, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table.take(buckets, 0), starts[:-1]) / np.sqrt(np.diff(starts))[:, None]


@dataclass
class Model:
    """table: embeddings; filters: from an embedding to each filter's value at each of its places; thresholds: logits."""

    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: dict = field(default_factory=dict)
    speed: dict = field(default_factory=dict)  # Adagrad's sums of squares, while it learns
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


def pooled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value of each filter over the places of a text (zeros stand for words that a short text lacks), and where."""
    best, where, column = [], [], 0
    if len(values) < max(WIDTHS):
        values = np.concatenate([values, np.zeros((max(WIDTHS) - len(values), COLUMNS), values.dtype)])
    for w in WIDTHS:
        n = len(values) - w + 1
        own = values[:n, column : column + FILTERS]
        for k in range(1, w):
            own = own + values[k : n + k, column + k * FILTERS : column + (k + 1) * FILTERS]
        at = own.argmax(0)
        best.append(own[at, np.arange(FILTERS)])
        where.append(at)
        column += w * FILTERS
    return np.concatenate(best), np.concatenate(where)


class Words(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n


class Scorer:
    """Logits and languages of texts; what a distinct word adds is computed once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.words, self.values, self.tongue, self.size = Words(), np.zeros((1024, COLUMNS), np.float32), np.zeros((1024, len(LANGUAGES)), np.uint8), 0

    def learn(self) -> None:
        if not self.words.new:
            return
        n = self.size + len(self.words.new)
        while n > len(self.values):
            self.values, self.tongue = (np.concatenate([x, np.zeros_like(x)]) for x in (self.values, self.tongue))
        self.values[self.size : n] = means(self.model.table, *gram_buckets(self.words.new)) @ self.model.filters
        for i, own in enumerate(LANGUAGES.values()):
            for w in {*own} & {*self.words.new}:
                self.tongue[self.words[w], i] = 1
        self.size = n
        self.words.new.clear()

    def logits(self, texts: list[str]) -> tuple[list[float], list[str]]:
        if len(self.words) > CACHE_WORDS:
            self.clear()
        found = [WORD.findall(x.lower()) for x in texts]
        numbers = [np.fromiter(map(self.words.__getitem__, x), np.int64, len(x)) for x in found]
        self.learn()
        m, names, out, languages = self.model, list(LANGUAGES), [], []
        for x in numbers:
            best = np.maximum(pooled(self.values[x])[0] + m.bias, 0)
            out.append(float(best @ m.out + m.out_bias))
            votes = self.tongue[x].sum(0, dtype=np.int64)
            languages.append(names[int(votes.argmax())] if votes.any() else OTHER)
        return out, languages

    def scores(self, texts: list[str]) -> list[float]:
        logits, languages = self.logits(texts)
        t = self.model.thresholds
        return [float(1 / (1 + np.exp(-min(max(z - t.get(lang, t[None]), -30), 30)))) for z, lang in zip(logits, languages, strict=True)]


#: For each filter of each width: the columns of its weights, one for each place.
FIRST = np.cumsum([0, *(w * FILTERS for w in WIDTHS)])
PLACES = [(k, w, FIRST[k] + np.arange(w) * FILTERS + np.arange(FILTERS)[:, None]) for k, w in enumerate(WIDTHS)]


def gradients(m: Model, e: np.ndarray, texts: list[np.ndarray], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss of texts, given as rows of the embeddings e, and its derivatives by e and by what the model learns."""
    values = e @ m.filters
    d_values, d = np.zeros_like(values), {"out": np.zeros_like(m.out), "bias": np.zeros_like(m.bias), "out_bias": 0.0}
    loss, rows, columns, amounts = 0.0, [], [], []
    for own, label in zip(texts, y, strict=True):
        best, where = pooled(values[own])
        hidden = np.maximum(best + m.bias, 0)
        z = min(max(float(hidden @ m.out + m.out_bias), -30), 30)
        loss += (np.log1p(np.exp(z)) - label * z) / len(texts)
        g = (1 / (1 + np.exp(-z)) - label) / len(texts)
        d["out"] += g * hidden
        d["out_bias"] += g
        d_hidden = g * m.out * (hidden > 0)
        d["bias"] += d_hidden
        for k, w, at in PLACES:
            place = where[k * FILTERS : (k + 1) * FILTERS, None] + np.arange(w)
            real = (place < len(own)) & (d_hidden[k * FILTERS : (k + 1) * FILTERS, None] != 0)
            rows.append(own[place[real]])
            columns.append(at[real])
            amounts.append(np.broadcast_to(d_hidden[k * FILTERS : (k + 1) * FILTERS, None], place.shape)[real])
    at = np.concatenate(rows) * COLUMNS + np.concatenate(columns)
    d_values += np.bincount(at, np.concatenate(amounts), d_values.size).reshape(d_values.shape)
    return loss, d | {"filters": e.T @ d_values, "e": d_values @ m.filters.T}


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """gram_buckets of many words."""
    buckets, starts = [], [np.zeros(1, np.int64)]
    for i in range(0, len(words), 20_000):
        b, s = gram_buckets(words[i : i + 20_000])
        buckets.append(b.astype(np.int32))
        starts.append(s[1:] + starts[-1][-1])
    return np.concatenate([np.zeros(0, np.int32), *buckets]), np.concatenate(starts)


def descend(m: Model, docs: list[np.ndarray], y: np.ndarray, buckets: np.ndarray, starts: np.ndarray) -> None:
    """A step of Adagrad over texts, given as numbers of the words that buckets and starts have."""

    def step(name: str, gradient: np.ndarray, rows=slice(None)) -> None:
        s = m.speed[name]
        s[rows] += gradient * gradient
        getattr(m, name)[rows] -= RATE[name] * gradient / np.sqrt(s[rows])

    used, inverse = np.unique(np.concatenate(docs), return_inverse=True)
    if not len(used):
        return
    lengths = starts[used + 1] - starts[used]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    own_buckets = buckets[np.repeat(starts[used] - bounds[:-1], lengths) + np.arange(bounds[-1])]
    _, d = gradients(m, means(m.table, own_buckets, bounds), np.split(inverse, np.cumsum([len(x) for x in docs])[:-1]), y)
    touched = np.flatnonzero(d["e"].any(1))
    for name in ("filters", "out", "bias"):
        step(name, d[name])
    m.out_bias -= 0.3 * d["out_bias"]
    if len(touched):
        n = lengths[touched]
        rows = own_buckets[np.repeat(bounds[touched] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        spread = np.repeat(d["e"][touched] / np.sqrt(n)[:, None], n, axis=0)
        unique, back = np.unique(rows, return_inverse=True)
        step("table", np.stack([np.bincount(back, c, len(unique)) for c in spread.T], 1).astype(np.float32), unique)


def train(texts: list[str], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Model:
    """Adagrad over batches with as many texts of either class."""
    rng = np.random.default_rng(seed)
    words = Words()
    docs = [np.fromiter(map(words.__getitem__, x), np.int32, len(x)) for x in (WORD.findall(t.lower()) for t in texts)]
    buckets, starts = bags(words.new)
    m = Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, COLUMNS)).astype(np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32))
    m.speed = {k: np.full_like(getattr(m, k), START[k]) for k in LEARNED}
    y = np.array(labels)
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    queues = [[], []]
    for _ in range(steps):
        chosen = []
        for q, own in zip(queues, classes, strict=True):
            while len(q) < BATCH // 2:
                q.extend(rng.permutation(own).tolist())
            chosen += q[: BATCH // 2]
            del q[: BATCH // 2]
        descend(m, [docs[i] for i in chosen], y[chosen], buckets, starts)
    return m


#: What is learned; with out_bias the whole model, in rows of DIM numbers.
LEARNED = ("table", "filters", "bias", "out")


def flat(m: Model) -> np.ndarray:
    rest = np.concatenate([*(getattr(m, k).ravel() for k in LEARNED[1:]), [m.out_bias]]).astype(np.float64)
    return np.concatenate([m.table.astype(np.float64), np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])


def moved(m: Model, by: np.ndarray) -> Model:
    """m with by (rows of flat) added."""
    table, rest, parts = by[:BUCKETS], by[BUCKETS:].ravel(), {}
    for k in LEARNED[1:]:
        own = getattr(m, k)
        parts[k], rest = own + rest[: own.size].reshape(own.shape).astype(own.dtype), rest[own.size :]
    return replace(m, table=m.table + table.astype(m.table.dtype), out_bias=m.out_bias + float(rest[0]), **parts)


class Lesson:
    """Goes over texts in their order from a model of its own. A batch has as many of either class: what is missing is taken from texts seen before."""

    def __init__(self, model: Model, seen: dict[int, list[str]]) -> None:
        self.model = replace(model, **{k: getattr(model, k).copy() for k in LEARNED}, speed={k: v.copy() for k, v in model.speed.items()})
        self.seen, self.new, self.taught = {c: deque(seen[c], BATCH // 2) for c in (0, 1)}, {0: deque(), 1: deque()}, 0

    def add(self, text: str, label: int) -> None:
        self.new[label].append(text)
        if len(self.new[label]) == BATCH // 2:
            self.step()

    def step(self) -> None:
        texts, y = [], []
        for c, queue in self.new.items():
            again = list(self.seen[c])[: BATCH // 2 - len(queue)]
            texts += [*queue, *again]
            y += [c] * (len(queue) + len(again))
            self.taught += len(queue)
            self.seen[c].extend(queue)
            queue.clear()
        words = Words()
        docs = [np.fromiter(map(words.__getitem__, WORD.findall(t.lower())), np.int32) for t in texts]
        descend(self.model, docs, np.array(y), *bags(words.new))

    def end(self) -> Model:
        if any(self.new.values()):
            self.step()
        return self.model


def taught_by_all(model: Model, texts: DataFrame, seen: dict[int, list[str]]) -> Model:
    """model after a pass over all rows of (toxic, text): each task goes over its own; what they change is averaged by their rows."""
    shared = texts.sparkSession.sparkContext.broadcast((model, seen))

    def run(batches):
        start, seen = shared.value
        lesson = Lesson(start, seen)
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                lesson.add(text.as_py(), label)
        by = flat(lesson.end()) - flat(start)
        some = np.flatnonzero(by.any(1))
        n = lesson.taught
        slots = pa.array(np.append(some, -1))
        yield pa.RecordBatch.from_arrays([slots, *(pa.array(np.append(by[some, i] * n, n)) for i in range(DIM))], names=["slot", *(f"v{i}" for i in range(DIM))])

    rows = texts.select("toxic", "text").mapInArrow(run, "slot long, " + ", ".join(f"v{i} double" for i in range(DIM)))
    sums = {r[0]: r[1:] for r in rows.groupBy("slot").agg(*(F.sum(f"v{i}") for i in range(DIM))).collect()}  # a row for each of the model's
    by, n = np.zeros_like(flat(model)), sums.pop(-1)[0]
    for slot, values in sums.items():
        by[slot] = np.array(values) / max(n, 1)
    return moved(model, by)


def best_cut(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The logit, halfway between two, that gives the greatest F1."""
    order = np.argsort(-logits)
    z, y, w = logits[order], labels[order], weights[order]
    hits, taken = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hits / (taken + (w * y).sum())
    f1[:-1][z[:-1] == z[1:]] = 0
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2 if i + 1 < len(z) else z[i] - 1)


def calibrate(model: Model, texts: list[str], labels: list[int], weights: list[float], least: int = 8) -> None:
    """Thresholds for all texts (None) and for each language with at least so many texts of either class."""
    logits, languages, scorer = [], [], Scorer(model)
    for i in range(0, len(texts), 100):
        for own, new in zip((logits, languages), scorer.logits(texts[i : i + 100]), strict=True):
            own += new
    set_thresholds(model, np.array(logits), np.array(labels), np.array(weights), np.array(languages), np.ones(len(logits)), least)


def set_thresholds(model: Model, z: np.ndarray, y: np.ndarray, w: np.ndarray, lang: np.ndarray, n: np.ndarray, least: int = 8) -> None:
    """n: the texts that an entry stands for."""
    model.thresholds = {None: best_cut(z, y, w) if 0 < y.sum() < len(y) else 0.0}
    for name in sorted({*lang.tolist()}):
        own = lang == name
        if min((n * y)[own].sum(), (n * (1 - y))[own].sum()) >= least:
            model.thresholds[name] = best_cut(z[own], y[own], w[own])


#: Logits that set thresholds are counted by parts of one.
PARTS = 1000


def calibrate_by_all(model: Model, texts: DataFrame) -> None:
    """Thresholds by all rows of (toxic, text), counted by language and logit: their number is bounded, and no row is left out."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for whole in batches:
            for b in text_batches(whole, 1, 1_000_000):
                logits, languages = scorer.logits(b.column(1).to_pylist())
                z = np.round(np.clip(logits, -30, 30) * PARTS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z), pa.array(languages, pa.string())], names=["toxic", "z", "lang"])

    found = texts.select("toxic", "text").mapInArrow(run, "toxic int, z long, lang string").groupBy("toxic", "z", "lang").count().orderBy("z", "toxic", "lang").collect()
    if len({r[0] for r in found}) == 2:
        y, z, n = (np.array([r[i] for r in found]) for i in (0, 1, 3))
        set_thresholds(model, z / PARTS, y, n.astype(float), np.array([r[2] for r in found]), n)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(1))


def within(ids: list[tuple[int, int]], sizes: dict[int, int]) -> list[tuple[int]]:
    """Of ids with labels, in order, those whose texts fit into what SAMPLE_BYTES leaves of their label.

    A text that doesn't fit takes nothing from those after it. If none of a label fits, its smallest is taken.
    """
    left, taken = dict(SAMPLE_BYTES), {label: [] for label in SAMPLE_BYTES}
    for doc_id, label in ids:
        if sizes[doc_id] <= left[label]:
            left[label] -= sizes[doc_id]
            taken[label].append((doc_id,))
    for label, own in taken.items():
        if not own:
            own += [(x,) for x in sorted((x for x, y in ids if y == label), key=lambda x: (sizes[x], x))[:1]]
    return [x for own in taken.values() for x in own]


def learned(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from all labelled rows whose fold isn't 0; fold 1 sets the thresholds."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    with scratch(docs.sparkSession):
        texts = docs.where(fold(F.col("doc_id")) != 0).join(own, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        texts = written(texts.withColumn("aside", fold(F.col("doc_id")) == 1), "labelled")  # a row for each id
        sizes = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
        if len(sizes) < 2:
            return None
        sample = None
        for label, most in SAMPLE.items():
            part = texts.where(F.col("toxic") == label).select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            sample = part if sample is None else sample.unionByName(part)
        ids = [tuple(r) for r in sample.collect()]  # at most the sum of SAMPLE, in the order of the hash
        of = lambda rows, schema: texts.join(F.broadcast(docs.sparkSession.createDataFrame(rows, schema)), "doc_id")
        sizes_of = {r[0]: r[1] for r in of([(x,) for x, _ in ids], "doc_id long").select("doc_id", F.octet_length("text")).collect()}
        rows = of(within(ids, sizes_of), "doc_id long").orderBy("doc_id").collect()
        taught = [r for r in rows if not r.aside] or rows
        aside = [r for r in rows if r.aside] or rows
        if len({r.toxic for r in taught}) < 2:
            return None
        model = train([r.text for r in taught], [r.toxic for r in taught])
        share = {k: n / max(1, sum(r.toxic == k for r in rows)) for k, n in sizes.items()}
        calibrate(model, [r.text for r in aside], [r.toxic for r in aside], [share[r.toxic] for r in aside])
        if model and sum(sizes.values()) > len(rows):  # the sample isn't all
            first = {c: [r.text for r in taught if r.toxic == c][: BATCH // 2] for c in (0, 1)}
            model = taught_by_all(model, texts.where("NOT aside"), first)
            model.speed = {}
            calibrate_by_all(model, texts.where("aside"))
    if model:
        model.speed = {}
    return model


_scorers: dict[str, Scorer] = {}
_forget = _scorers.clear


def scored(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score between 0 and 1; 0 without a model."""
    if model is None:
        return docs.withColumn(score, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 2 MB, whatever the input
    at = docs.columns.index(text)
    schema = docs.withColumn(score, F.lit(0.0)).schema

    def run(batches):
        m = shared.value
        sole_cache(_forget)
        if m.name not in _scorers:
            _scorers.clear()
            _scorers[m.name] = Scorer(m)
        for whole in batches:
            for b in text_batches(whole, at, 1_000_000):
                found = _scorers[m.name].scores([x or "" for x in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, score])

    return docs.mapInArrow(run, schema)


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score under 0.5, with the columns of docs."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, learned(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")), score=name).where(F.col(name) < 0.5).select(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, learned(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
