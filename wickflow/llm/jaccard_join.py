"""N-gram Jaccard join with a token-group matrix: which texts are linked, directly or through others.

Two texts link when the Jaccard similarity of their sets of word shingles reaches a threshold. The join loses no link:

1. Texts with equal sets are one class, found by digest; its least id stands for it.
2. Neighbourhoods. If two sets differ in at most d tokens and tokens fall by hash into d + 1 + s parts, then more than s
   parts are equal. So two linked texts share the digest of a part, or, if the only equal parts are ones that say little
   (empty, or of common shingles alone), more than s of those, which a prefix filter finds. d follows from the sizes,
   which are taken in classes of neighbouring sizes. Texts that share a digest fall into one neighbourhood, whose members
   are found by passing on the least id. Which shingles are common changes the size of neighbourhoods only, never a result.
   By chance alone texts share digests in proportion to the square of their number, so that neighbourhoods grow together.
   Those of over LOOSE texts are taken apart: of texts with a digest in common, only those stay neighbours whose sketches
   (parities of hashed tokens) differ in no more places than sets that link may differ in tokens. That loses no link.
3. In a neighbourhood the token-group matrix decides. Texts of similar sets are partitioned into groups of at most GROUP;
   a group's tokens are united. A text's overlap with the union bounds its overlap with each member, so only groups whose
   bound reaches the threshold are opened, and of those none that the text is already linked with through others.
4. A neighbourhood of over MOST texts is split over tasks. Each part first links its own texts and some that all parts
   hold; texts that are still outside the largest component are then asked of every part.

Cases: null and empty texts, and texts without words, have an empty set (n_shingles 0) and link with nothing, not even each
other; a text of fewer words than a shingle has one, of all its words; rows with a null id link with nothing, and their
component is null; rows that repeat an id are one document, linked with all that any of them links with; an empty table gives
no rows; other columns are not read. Sets hold 64-bit hashes of shingles in place of the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_by_count, join_hot, partitions, read, scratch, sole_cache, written
from .token_counts import text_batches

#: Shingles of the library's near-duplicate stages, and the least similarity, in hundredths.
SHINGLE, PERCENT = 5, 80
GROUP, SHARED = 32, 16
#: Texts, and shingles of all of them, that a task compares with each other at once.
MOST, MOST_TOKENS = 1000, 3_000_000
#: A shingle is common if a COMMON_IN-th of all texts have it, and COMMON_LEAST of a block; tokens of a block.
#: There are at most 2 * COMMON_IN times as many as a text has on average, whatever the number of texts.
COMMON_IN, COMMON_LEAST, BLOCK_TOKENS = 1500, 5, 1_500_000
#: Neighbourhoods of more texts are taken apart by sketches.
LOOSE = 200
#: Signatures are of one text of each class if over one in so many rows is a copy: that moves all texts once.
COPIES_IN = 4
#: Signatures that a task holds at once, about 40 bytes each.
BLOCK_SIGNATURES = 1_000_000
CACHE_WORDS = 250_000
B1 = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()
_forget = _hashes.clear


def shingles(data: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of UTF-8 text; A-Z are lower-cased, and words end at ASCII white space."""
    found = data.lower().split()
    sole_cache(_forget)
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    out, n = np.full(max(1, len(h) - k + 1), min(len(h), k), np.uint64), min(len(h), k)
    for i in range(n):
        out = mixed(out * B1 + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def size_classes(percent: int, top: int) -> np.ndarray:
    """Least sizes of the classes up to top and two beyond: linked sizes are in the same or in neighbouring classes."""
    out = [1]
    while out[-1] <= top or len(out) < 3:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1])


def differing(percent: int, largest: np.ndarray) -> np.ndarray:
    """The most tokens in which two linked sets differ, of at most so many tokens each."""
    return 2 * largest * (100 - percent) // (100 + percent)


def spare(d: np.ndarray, percent: int) -> np.ndarray:
    """More parts than differences, so many that a set has as many empty ones with a chance of about 1 in 10 000.

    The smallest set of a size class has percent squared of its largest size, which gives the share of empty parts.
    """
    t = percent / 100
    fill, out = t * t * (1 + t) / max(2 * (1 - t), 1e-9) * d, np.zeros(len(d))
    for _ in range(8):  # spare parts are parts too
        parts = d + 1 + out
        empty = parts * np.exp(-fill / parts)
        out = np.ceil(empty + 4 * np.sqrt(empty) + 1)
    return out.astype(np.int64)


def signatures(sets: list[np.ndarray], percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which set, signature) of all sets, each as a member of its own size class and as a smaller partner in the next.

    A part with a token that isn't common gives a signature. Of n other parts, more than s must be equal if no such part is:
    then the first n - s of them, in an order that all sets share, have one in common (prefix filter).
    """
    keep = [i for i, x in enumerate(sets) if len(x)]
    if not keep:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = np.array([len(sets[i]) for i in keep])
    tokens = np.concatenate([sets[i] for i in keep])
    rare = ~inside(tokens, common) if len(common) else np.ones(len(tokens), bool)
    bounds = size_classes(percent, int(sizes.max()))
    owners, found, inner = [], [], mixed(tokens ^ B1)
    for step in (0, 1):
        cls = np.searchsorted(bounds, sizes, "right") - 1 + step
        d = differing(percent, bounds[cls + 1] - 1)
        more = spare(d, percent)
        parts = np.where(d > 0, d + 1 + more, 0)  # no difference is allowed: equal sets are one class anyway
        base = np.concatenate([[0], np.cumsum(parts)])
        live = np.repeat(parts > 0, sizes)
        who = np.repeat(np.arange(len(keep)), sizes)[live]
        slot = base[who] + (tokens[live] % parts[who].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, slot, inner[live])
        telling = np.bincount(slot[rare[live]], minlength=base[-1]) > 0
        owner = np.repeat(np.arange(len(keep)), parts)
        own = mixed(sums ^ mixed(cls[owner].astype(np.uint64) * np.uint64(1 << 32) + (np.arange(base[-1]) - base[owner]).astype(np.uint64)))
        owners.append(owner[telling])
        found.append(own[telling])
        others = np.bincount(owner[~telling], minlength=len(keep))
        for i in np.flatnonzero(others > more):
            part = slice(base[i], base[i + 1])
            first = np.sort(own[part][~telling[part]])[: others[i] - more[i]]
            owners.append(np.full(len(first), i))
            found.append(first)
    return np.array(keep)[np.concatenate(owners)], np.concatenate(found)


# ------------------------------------------------------------------ sketches


def sketch(tokens: np.ndarray) -> bytes:
    """For each of 2 to 4 bits a token, whether an odd number of tokens falls on it. A token more or less changes one bit."""
    n = 1 << max(6, int(2 * len(tokens) - 1).bit_length())
    at = (mixed(tokens + B1) & np.uint64(n - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=n).astype(np.uint8) & 1).tobytes()


def folded(bits: np.ndarray, n: int) -> np.ndarray:
    """A sketch of n words in place of more: the parities of bits that fall together."""
    while len(bits) > n:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def neighbours(sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """A label for each set: linked sets have one label, and so have others only if a chain of sets that may link lies between them."""
    found = [np.frombuffer(x, np.uint64) for x in sketches]
    n = min(len(x) for x in found)
    rows, labels = np.stack([folded(x, n) for x in found]), np.arange(len(found))
    for q in range(len(found) - 1):
        later = q + 1 + np.flatnonzero(labels[q + 1 :] != labels[q])
        for part in np.split(later, range(10_000, len(later), 10_000)):
            apart = np.bitwise_count(rows[part] ^ rows[q]).sum(1, dtype=np.int64)
            near = np.unique(labels[part[apart * (100 + percent) <= (sizes[part] + sizes[q]) * (100 - percent)]])
            if len(near):
                labels[np.isin(labels, near)] = labels[q]
    return labels


# ------------------------------------------------------------------ the matrix


def inside(tokens: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which tokens are in the sorted array of."""
    at = np.searchsorted(of, tokens)
    at[at == len(of)] = 0
    return of[at] == tokens


def overlaps(tokens: np.ndarray, starts: np.ndarray, query: np.ndarray) -> np.ndarray:
    """How many of the tokens of each run (starts, and the end of all) are in query, 1 for each token's number that it has."""
    return np.add.reduceat(query[tokens], starts[:-1], dtype=np.int64)


def linked(a: int, b: int, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def runs(groups: np.ndarray, bounds: list[int]) -> list[tuple[int, int]]:
    """The rows of groups, neighbouring ones together."""
    if not len(groups):
        return []
    breaks = np.flatnonzero(np.diff(groups) > 1)
    return [(bounds[groups[i]], bounds[groups[j] + 1]) for i, j in zip([0, *(breaks + 1)], [*breaks, len(groups) - 1], strict=True)]


class Unions:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def components(sets: list[np.ndarray], percent: int, asked: np.ndarray | None = None, known: list[int] | None = None, group: int = GROUP) -> list[int]:
    """The least index linked with each set. asked: ask only for the links of these; known: components known before.

    Sets come in an order that puts similar ones together, so that groups' unions stay small.
    """
    n, unions = len(sets), Unions(len(sets))
    if known:
        first: dict[int, int] = {}
        for i, c in enumerate(known):
            unions.join(i, first.setdefault(c, i))
    sizes = np.array([len(x) for x in sets])
    order = np.array(sorted(range(n), key=lambda i: (unions.find(i), sizes[i], int(sets[i][0]))))
    starts = np.concatenate([[0], np.cumsum(sizes[order])])
    tokens = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]  # numbers in place of hashes
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    query = np.zeros(tokens.max() + 1, np.int8)
    bounds = [*range(0, n, group), n]
    united = [np.unique(tokens[starts[a] : starts[b]]) if b - a > 1 else tokens[starts[a] : starts[b]] for a, b in zip(bounds, bounds[1:], strict=False)]
    matrix, heads = np.concatenate(united), np.concatenate([[0], np.cumsum([len(x) for x in united])])
    least = np.array([sizes[order[a:b]].min() for a, b in zip(bounds, bounds[1:], strict=False)])
    most = np.array([sizes[order[a:b]].max() for a, b in zip(bounds, bounds[1:], strict=False)])
    labels = np.array([unions.find(i) for i in order])
    for q in range(n) if asked is None else np.flatnonzero(asked).tolist():
        size, own = int(sizes[q]), unions.find(q)
        other = labels != own
        if not other.any():
            if asked is None:
                break
            continue
        fits = (most * 100 >= size * percent) & (least * percent <= size * 100) & np.logical_or.reduceat(other, bounds[:-1])
        if not fits.any():
            continue
        mine = tokens[starts[place[q]] : starts[place[q] + 1]]
        query[mine] = 1
        bound = overlaps(matrix, heads, query)
        open_ = np.flatnonzero(fits & (100 * bound >= percent * np.maximum(size, least)))
        changed = False
        for a, b in runs(open_, bounds):
            both = overlaps(tokens[starts[a] : starts[b]], starts[a : b + 1] - starts[a], query)
            hits = np.flatnonzero(linked(size, sizes[order[a:b]], both, percent) & (labels[a:b] != own)) + a
            for j in hits.tolist():
                if unions.find(q) != unions.find(int(order[j])):
                    unions.join(q, int(order[j]))
                    changed = True
        query[mine] = 0
        if changed:
            labels = np.array([unions.find(i) for i in order])
    return [unions.find(i) for i in range(n)]


# ------------------------------------------------------------------ in Spark


def sizes_and_digests(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles and the digest of the set of each row of (doc_id, text).

    Rows without a digest are counts instead: of a shingle (in doc_id's place) that at least a COMMON_IN-th of a block's
    texts have, counting texts with the same least shingle once. A shingle that a COMMON_IN-th of all such texts have does
    so in some block.
    """

    def run(batches):
        firsts, held, size = set(), [], 0

        def counts():
            found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= max(COMMON_LEAST, len(held) / COMMON_IN)
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often], pa.int64()), pa.nulls(int(often.sum()), pa.binary())], names=["doc_id", "n_shingles", "digest"])

        for whole in batches:
            for b in text_batches(whole, 1):
                sets = [shingles(x.as_py() or b"", k) for x in b.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())], names=["doc_id", "n_shingles", "digest"])
                for x in sets:
                    if len(x) and x[0] not in firsts:
                        firsts.add(x[0])
                        held.append(x)
                        size += len(x)
                if size > BLOCK_TOKENS:
                    yield counts()
                    firsts, held, size = set(), [], 0
        yield counts()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary")


def hubs(docs: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id and hub, the least id that shares a signature with it, for each signature that documents share.

    A task finds the least id of each signature among its own texts, a block of them at a time. Only that id's row goes on to
    meet other blocks under the signature, so even one that all texts share has few rows there; the block's other ids
    are given their hub at once, in rows with a key of their own.
    """

    def run(batches):
        held, size = [], 0

        def block():
            found, ids = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.lexsort((ids, found))
            found, ids = found[order], ids[order]
            first = np.concatenate([[True], found[1:] != found[:-1]])
            own = ids[first][np.cumsum(first) - 1]
            a, b = ids[ids > own], own[ids > own]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            a, b = a[new], b[new]
            keys = mixed(mixed(a.view(np.uint64) + B1) ^ b.view(np.uint64))
            hub = pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(b)])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([found[first], keys]).view(np.int64)), pa.array(np.concatenate([ids[first], a])), hub], names=["signature", "doc_id", "hub"])

        for whole in batches:
            for b in text_batches(whole, 1):
                who, found = signatures([shingles(x.as_py() or b"", k) for x in b.column(1).cast(pa.binary())], percent, common)
                held.append((found, b.column(0).to_numpy(zero_copy_only=False)[who]))
                size += len(found)
                if size > BLOCK_SIGNATURES:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    rows = docs.mapInArrow(run, "signature long, doc_id long, hub long")
    least = F.first("doc_id").over(Window.partitionBy("signature").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("hub", F.coalesce("hub", least))
    return rows.where("hub < doc_id").groupBy("doc_id", "hub").count().drop("count")


def contracted(near: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect what pairs (doc_id, hub) connect: an id with its least hub, and its other hubs with that.

    Many ids of a large neighbourhood have the same hubs, so the second kind collapses, and about a pair for each id is left.
    """
    near = written(near.withColumn("least", F.min("hub").over(Window.partitionBy("doc_id"))), "hubs")
    pairs = near.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).unionByName(near.where("hub <> least").select(F.col("hub").alias("a"), F.col("least").alias("b")))
    return pairs.groupBy("a", "b").count().drop("count")


def least_reachable(links: DataFrame) -> DataFrame:
    """id and label (the least id reachable) of each id in links (a, b) of any type that has an order.

    Each round every id points to its least neighbour, pointers are followed twice, and what points to one id becomes one:
    the links that are left lie between different ids, and are few after a round. Labels are put together backwards.
    An id that many others point to, or have links with, is a hot key of these joins.
    """
    spark = links.sparkSession
    ordered = lambda d, x, y: d.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").groupBy("a", "b").count().drop("count")
    ahead = lambda d: d.select(F.col("id").alias("label"), F.col("label").alias("_ahead"))
    followed = lambda d, to: written(join_hot(d, ahead(to), "label", "left").select("id", F.coalesce("_ahead", "label").alias("label")), "labels")
    with scratch(spark) as keep:
        edges, levels = written(ordered(links, "a", "b"), "links"), []
        while edges.limit(1).count():
            both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other")))
            own = written(both.groupBy("id").agg(F.least("id", F.min("other")).alias("label")), "labels")
            own = followed(own, own)
            own = followed(own, own)
            levels.append(own)
            edges = join_hot(edges, own.select(F.col("id").alias("a"), F.col("label").alias("_a")), "a")
            edges = join_hot(edges, own.select(F.col("id").alias("b"), F.col("label").alias("_b")), "b")
            edges = written(ordered(edges, "_a", "_b"), "links")
        if not levels:
            return spark.createDataFrame([], edges.select(F.col("a").alias("id"), F.col("b").alias("label")).schema)
        labels = levels.pop()
        while levels:
            labels = followed(levels.pop(), labels)
        return keep(labels)


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(flock, id): the ids that a signature of (signature, id) is shared by, once for all signatures of the same ids."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 2

        def done(keys, ids):
            new = np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
            keys, ids = keys[new], ids[new]
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
            lengths = np.diff(np.append(starts, len(keys)))
            sums = mixed(np.add.reduceat(mixed(ids.view(np.uint64) + B1), starts) + lengths.astype(np.uint64)) if len(keys) else np.zeros(0, np.uint64)
            keep = np.repeat(lengths > 1, lengths)
            flock, ids = np.repeat(sums, lengths)[keep], ids[keep]
            order = np.lexsort((ids, flock))
            flock, ids = flock[order], ids[order]
            new = np.concatenate([np.ones(min(1, len(ids)), bool), (flock[1:] != flock[:-1]) | (ids[1:] != ids[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(flock[new].view(np.int64)), pa.array(ids[new])], names=["flock", "id"])

        for b in batches:
            if not b.num_rows:
                continue
            keys, ids = (np.concatenate([x, b.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate(held))
            last = int(np.searchsorted(keys, keys[-1]))  # the last signature may go on in the next batch
            yield done(keys[:last], ids[:last])
            held = [keys[last:], ids[last:]]
        yield done(*held)

    dealt = rows.repartition(partitions(rows.sparkSession), "signature").sortWithinPartitions("signature", "id")
    return dealt.mapInArrow(run, "flock long, id long").distinct()


def taken_apart(texts: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """(a, b) of (id, text): pairs that connect all linked ids, and others only by sets that share a signature and have close sketches."""

    def signed(batches):
        for whole in batches:
            for b in text_batches(whole, 1):
                sets = [shingles(x.as_py() or b"", k) for x in b.column(1).cast(pa.binary())]
                ids = b.column(0).to_numpy(zero_copy_only=False)
                who, found = signatures(sets, percent, common)
                some = np.flatnonzero([len(x) > 0 for x in sets])
                keys = pa.concat_arrays([pa.array(found.view(np.int64)), pa.nulls(len(some), pa.int64())])
                sizes = pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array([len(sets[i]) for i in some], pa.int64())])
                bits = pa.concat_arrays([pa.nulls(len(found), pa.binary()), pa.array([sketch(sets[i]) for i in some], pa.binary())])
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([ids[who], ids[some]])), sizes, bits], names=["signature", "id", "n", "bits"])

    def near(batches):
        now, ids, sizes, bits = None, [], [], []

        def done():
            labels = neighbours(np.array(sizes), bits, percent)
            least = np.full(len(ids), np.iinfo(np.int64).max)
            own = np.array(ids)
            np.minimum.at(least, labels, own)
            out = least[labels] < own
            return pa.RecordBatch.from_arrays([pa.array(own[out]), pa.array(least[labels][out])], names=["a", "b"])

        for batch in batches:
            for flock, id_, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if flock != now:
                    if ids:
                        yield done()
                    now, ids, sizes, bits = flock, [], [], []
                ids.append(id_)
                sizes.append(n)
                bits.append(x)
        if ids:
            yield done()

    rows = written(texts.select("id", "text").mapInArrow(signed, "signature long, id long, n long, bits binary"), "signed")
    flocks = shared_signatures(rows.where("signature IS NOT NULL").select("signature", "id"))
    flocks = flocks.join(rows.where("signature IS NULL").select("id", "n", "bits"), "id").select("flock", "id", "n", "bits")
    dealt = flocks.repartition(partitions(texts.sparkSession), "flock").sortWithinPartitions("flock", "id")
    return dealt.mapInArrow(near, "a long, b long").distinct()


UNIT = "id long, label long"


def resolve(units: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (id, label) that hold within each unit of (unit, id, asked, known, text); known: component so far, or null."""

    def run(batches):
        now, ids, asked, known, sets = None, [], [], [], []

        def done():
            if len(ids) < 2:
                return pa.RecordBatch.from_pylist([], schema=schema)
            found = components(sets, percent, None if all(asked) else np.array(asked), known)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[c] for c in found], pa.int64())], schema=schema)

        for whole in batches:
            for b in text_batches(whole, 5):
                data = b.column(5).cast(pa.binary())
                for i, (pod, block, id_, ask, comp) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)):
                    if (pod, block) != now:
                        if ids:
                            yield done()
                        now, ids, asked, known, sets = (pod, block), [], [], [], []
                    own = shingles(data[i].as_py() or b"", k)
                    if not len(own):  # of an id that has another text too
                        continue
                    ids.append(id_)
                    asked.append(ask)
                    known.append(id_ if comp is None else comp)
                    sets.append(own)
        if ids:
            yield done()

    schema = pa.schema([("id", pa.int64()), ("label", pa.int64())])
    dealt = units.select("pod", "block", "id", "asked", "known", "text").repartition(partitions(units.sparkSession), "pod", "block")
    return dealt.sortWithinPartitions("pod", "block").mapInArrow(run, UNIT).where("id <> label")


def with_text(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (id and more columns) with the texts of their documents."""
    return texts.join(ids.hint("shuffle_hash"), "id")


def join_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """A row for each row of docs: id, n_shingles, component_id (the least id reachable by links, itself included)."""
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as keep:
        counted = keep(written(sizes_and_digests(docs, k), "sized"))
        sized = counted.where("digest IS NOT NULL")
        often = counted.where("digest IS NULL").groupBy("doc_id").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= sized.count() / (2 * COMMON_IN))
        common = np.sort(np.array([r[0] for r in often.select("doc_id").collect()], np.int64).view(np.uint64))
        labels = keep(written(linked_ids(docs.where("doc_id IS NOT NULL"), sized, k, percent, common, most), "components"))
    # How many of sized's rows an id has is known only of ids that repeat, so no key is hot but those.
    repeats = sized.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n"))
    labels = labels.join(repeats, "doc_id")
    out = join_by_count(sized, labels, "doc_id", "_n")
    return out.select(F.col("doc_id").alias(id), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def linked_ids(docs: DataFrame, sized: DataFrame, k: int, percent: int, common: np.ndarray, most: int) -> DataFrame:
    """doc_id and component_id of each id that is linked with another one."""
    own = sized.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(own.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n"), F.max("n_shingles").alias("_tokens")), "classes")
    copies = join_by_count(own.select("digest", "doc_id"), classes.where("_n > 1").drop("_tokens"), "digest", "_n", "inner").where("doc_id <> rep")
    copies = written(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "copies")
    # Ids of copies give way to those that stand for them, so each set is compared once; ids with other sets too stay.
    sole = own.groupBy("doc_id").agg(F.min("digest").alias("_d"), F.max("digest").alias("_e")).where("_d = _e").select(F.col("doc_id").alias("id"))
    stands = written(copies.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("rep")).join(sole, "id", "left_semi"), "stands")
    seen = docs
    if stands.count() * COPIES_IN > sized.count():
        seen = docs.join(stands.select(F.col("id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_anti")
    near = written(contracted(hubs(seen, k, percent, common)), "near")
    for side in ("a", "b"):
        near = join_hot(near, stands.withColumnRenamed("id", side), side, "left").withColumn(side, F.coalesce("rep", side)).drop("rep")
    near = near.where("a <> b").distinct()
    pods = least_reachable(near).withColumnRenamed("label", "pod")
    counts = written(pods.groupBy("pod").count(), "counts")
    if counts.where(F.col("count") > LOOSE).limit(1).count():
        pods = written(join_hot(pods, counts, "pod"), "loose")
        loose = with_text(docs.withColumnRenamed("doc_id", "id"), pods.where(F.col("count") > LOOSE).select("id"))
        apart = least_reachable(taken_apart(loose, k, percent, common)).withColumnRenamed("label", "pod")
        pods = pods.where(F.col("count") <= LOOSE).select("id", "pod").unionByName(apart)
    pods = pods.join(classes.groupBy(F.col("rep").alias("id")).agg(F.sum("_tokens").alias("_tokens")), "id")
    blocks = F.ceil(F.greatest(F.count("*") / most, F.sum("_tokens") / MOST_TOKENS)).cast("int")
    pods = written(join_hot(pods, pods.groupBy("pod").agg(blocks.alias("_blocks")), "pod"), "pods")
    # The texts of neighbourhoods are set aside: all that follows reads these alone.
    texts = written(with_text(docs.withColumnRenamed("doc_id", "id"), pods.select("id")), "texts")
    block = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col("_blocks")).cast("int")
    unasked = [F.lit(True).alias("asked"), F.lit(None).cast("long").alias("known")]
    at = pods.withColumn("block", block(1)).select("pod", "block", "id", *unasked)
    large = pods.where("_blocks > 1")
    blocks = large.select("pod", "_blocks").distinct()
    some = Window.partitionBy("pod").orderBy(F.xxhash64("id", F.lit(2)), "id")
    shared = large.select("pod", "id").withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= SHARED).join(blocks, "pod")
    shared = shared.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select("pod", "block", "id", *unasked)
    links = written(resolve(with_text(texts, at.unionByName(shared).distinct()), k, percent), "links")
    if large.limit(1).count():
        links = links.unionByName(across(texts, large, blocks, links, block(1), k, percent, most))
    every = links.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(copies)
    return least_reachable(every).select(F.col("id").alias("doc_id"), F.col("label").alias("component_id"))


def across(texts: DataFrame, large: DataFrame, blocks: DataFrame, links: DataFrame, block, k: int, percent: int, most: int) -> DataFrame:
    """Links between the parts of large neighbourhoods: of every text outside its neighbourhood's largest component."""
    labels = least_reachable(links.select(F.col("id").alias("a"), F.col("label").alias("b")))
    state = written(large.join(labels, "id", "left").withColumn("known", F.coalesce("label", "id")).withColumn("block", block).select("pod", "id", "block", "known", "_tokens"), "state")
    largest = state.groupBy("pod", "known").count().groupBy("pod").agg(F.max_by("known", F.struct("count", "known")).alias("main"))
    outside = state.join(largest, "pod").where("known <> main").select("pod", "id", "known", "_tokens", F.floor(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30))).alias("_h"))
    chunks = outside.groupBy("pod").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("_tokens") / MOST_TOKENS)).cast("int").alias("_chunks")).join(blocks, "pod")
    # A unit is a part with all its texts, and a chunk of the texts that are asked.
    unit = lambda b, c: (b * F.lit(1 << 16).cast("long") + c).alias("block")
    asked = outside.join(chunks, "pod").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    asked = asked.select("pod", unit(F.col("_b").cast("long"), F.col("_h") % F.col("_chunks")), "id", F.lit(True).alias("asked"), "known")
    there = state.join(chunks, "pod").withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    there = there.select("pod", unit(F.col("block").cast("long"), F.col("_c")), "id", F.lit(False).alias("asked"), "known")
    units = asked.unionByName(there).groupBy("pod", "block", "id").agg(F.max("asked").alias("asked"), F.first("known").alias("known"))
    return resolve(with_text(texts, units), k, percent).unionByName(labels.where("id <> label"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without those that another one stands for: of each component the document of least id stays, as one row.

    Rows with a null id stay, and so do texts without words. Where an id repeats, each of its differing texts is a document of its own, ordered by
    the id and then the text's hash; of rows with one id and text the one of least hash of all columns stays, whatever task is run again.
    """
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        with scratch(docs.sparkSession) as keep:
            gone = keep(written(stood_for(join_components(docs, k, percent)), "gone"))
        return docs.join(gone.withColumnRenamed("id", "doc_id").hint("shuffle_hash"), "doc_id", "left_anti")
    with scratch(docs.sparkSession) as keep:
        own = keep(written(texts_apart(docs), "apart"))
        gone = keep(written(stood_for(join_components(own, k, percent, "_sid", "_text")), "gone"))
    left = own.join(gone.withColumnRenamed("id", "_sid").hint("shuffle_hash"), "_sid", "left_anti")
    several = own.where("_sid IS NOT NULL").groupBy("_sid").count().where("count > 1").select("_sid")
    kept = left.join(several, "_sid", "left_semi").groupBy("_sid").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    return left.join(several, "_sid", "left_anti").select("_row").unionByName(kept).select("_row.*")


def stood_for(components: DataFrame) -> DataFrame:
    """The ids that a lesser one stands for."""
    id = components.columns[0]
    return components.where(F.col("component_id") != F.col(id)).select(F.col(id).alias("id")).distinct()


def texts_apart(docs: DataFrame) -> DataFrame:
    """docs as rows of _sid, _text and _row: a number for each id and differing text, in their order (null for null ids)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), F.col("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    slim = rows.where("_id IS NOT NULL").select("_id", "_hash").distinct()
    dealt = slim.repartitionByRange(partitions(docs.sparkSession), "_id", "_hash").withColumn("_pid", F.spark_partition_id())
    placed = written(dealt.withColumn("_pos", F.row_number().over(Window.partitionBy("_pid").orderBy("_id", "_hash"))), "numbered")
    before = placed.groupBy("_pid").count().select("_pid", F.coalesce(F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    numbers = placed.join(F.broadcast(before), "_pid").select("_id", "_hash", (F.col("_before") + F.col("_pos")).alias("_sid"))
    return rows.join(numbers.hint("shuffle_hash"), ["_id", "_hash"], "left").select("_sid", "_text", "_row")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read(spark, sf_dir, "documents"), k=4, percent=85)
