"""Token counts from a cache of digests.

The cache is a Parquet table of (tokenizer, digest, n_tokens), in a folder for each tokenizer, which is its file's SHA-256;
the digest is that of the text's UTF-8 (null is the empty text). Texts whose digest it lacks are encoded once for each distinct
digest, and the counts appended. Only digests are gathered by key. If a tenth of them at most is missing, and no more than
BROADCAST_MISSES, those are sent to the texts, which stay where they are; else each text moves once, to join its digest.

Cases: null and empty texts share a digest; rows that repeat an id, a text or both each come back; null ids too; a cache that holds a digest
twice (two runs at once) gives one count; an empty table appends nothing; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_count, read, scratch, shared_path, written
from .encoding import encoder, version

CACHE = "tokenizer string, digest binary, n_tokens long"
LIMIT = 512
#: Missing digests that are sent to all tasks, at most (about 60 bytes each).
BROADCAST_MISSES = 50_000
#: Texts that a worker holds as Python strings at once, in bytes.
BATCH_BYTES = 4_000_000


def text_batches(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES):
    """Slices of a batch, each of few bytes of text or of one row."""
    texts, start, size = batch.column(column), 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n or 0
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def cached(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    try:
        found = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:  # nothing is stored yet
        found = spark.createDataFrame([], CACHE)
    return found.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_tokens. tokenizer: a file's path; cache: a table's path."""
    spark, tokenizer_digest = docs.sparkSession, version(tokenizer)
    docs = docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs = docs.withColumn("digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))

    def run(batches):
        own = encoder(tokenizer)
        for whole in batches:
            for b in text_batches(whole, 1):
                texts = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))  # rows that repeat id and text
                yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.binary()), pa.array(own.count(list(texts.values())), pa.int64())], names=["digest", "n_tokens"])

    with scratch(spark) as keep:
        keyed = keep(written(docs.select("_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "digests"))
        groups = keyed.groupBy("digest").agg(F.count("*").alias("_n"), F.min(F.coalesce("_id", F.lit(-(2**63)))).alias("_id"))
        groups = keep(written(groups.join(cached(spark, cache, tokenizer_digest), "digest", "left"), "groups"))
        misses = groups.where("n_tokens IS NULL").select("_id", "digest")
        distinct, missing = groups.agg(F.count("*"), F.count_if(F.col("n_tokens").isNull())).first()
        few = missing <= min(BROADCAST_MISSES, distinct // 10)
        # Of the texts with one digest, the one with the least id.
        chosen = docs.withColumn("_id", F.coalesce("_id", F.lit(-(2**63)))).join(F.broadcast(misses) if few else misses.hint("shuffle_hash"), ["_id", "digest"], "left_semi")
        counted = chosen.select("digest", "_text").mapInArrow(run, "digest binary, n_tokens long")
        counted = keep(written(counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counted"))
    counted.select(F.lit(tokenizer_digest).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    hits = groups.where("n_tokens IS NOT NULL").select("digest", "_n", "n_tokens")
    counts = hits.unionByName(groups.where("n_tokens IS NULL").select("digest", "_n").join(counted, "digest"))
    return join_by_count(keyed, counts, "digest", "_n").select(F.col("_id").alias(id), "n_bytes", "n_tokens")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is new, so that each run encodes all its distinct texts."""
    import public_tokenizers

    cache = shared_path(spark, "token-counts")
    out = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
