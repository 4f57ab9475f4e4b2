"""Mixing sources to target weights.

Sizes (words) are summed by source; a target for each source gives a repetition rate, and a document is emitted
floor(rate) times, and once more by a coin of the fraction. The coins of a source aren't thrown one by one, but by one hash-seeded
throw for all of them (systematic sampling), in the order of size and hash: each document has its probability, and a source misses
its target by about the size of its largest document. No coin depends on partitioning or on a generator's state, so reruns agree.
Sources stay a table throughout: their number may grow with the corpus.

Cases: null or empty text has size 0 and is emitted like any other document of its source (a source of size 0 has target
and rate 0, so its documents are not emitted); null is a source of its own, last in order; rows of a source that repeat a
doc_id share its coin; rows with a null id have coins by their texts; an empty table gives no rows; columns of docs are never read but for doc_id, source and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_by_count, n_words, partitions, read, scratch, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix's size as a share of all sizes; the most that a source's target may be of its size.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df, which has distinct keys, with rank (from 0, nulls last), without gathering it in one task."""
    spark, pid = df.sparkSession, F.spark_partition_id()
    df = df.repartitionByRange(partitions(spark), F.col(key).asc_nulls_last()).withColumn("_pid", pid)
    df = written(df.withColumn("_pos", F.row_number().over(Window.partitionBy("_pid").orderBy(F.col(key).asc_nulls_last()))), "ranked")
    before, offsets = 0, []
    for p, n in sorted(map(tuple, df.groupBy("_pid").count().collect())):  # a row for each partition
        offsets.append((p, before))
        before += n
    offsets = spark.createDataFrame(offsets, "_pid int, _before long")
    return df.join(F.broadcast(offsets), "_pid").withColumn("rank", F.col("_before") + F.col("_pos") - 1).drop("_pid", "_pos", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From rows of (source, size): a row for each source with source_size, n_docs, target and rate.

    A target is the source's weight times a level, or most times its size if that is less; the level is raised until all
    is shared out. Each round settles the sources that the level of the round before would overfill.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_source = ranked(by_source, "source")
    weight = F.get(F.lit(list(weights)), (F.col("rank") % len(weights)).cast("int")).cast("double")
    by_source = written(by_source.withColumns({"weight": weight, "full": F.col("source_size") * most}), "sources")
    total = float(by_source.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        over = F.col("full") <= F.col("weight") * level
        settled, open_weight = by_source.agg(F.sum(F.when(over, F.col("full")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        found = (total - settled) / open_weight if open_weight else level
        if not open_weight or found <= level:
            break
        level = found
    target = F.least(F.col("full"), F.col("weight") * level)
    return by_source.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).drop("weight", "full", "rank")


def coin(value: Column, seed: str = SEED) -> Column:
    """In [0, 1), from 48 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), value)), 1, 12), 16, 10).cast("double") / float(1 << 48)


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """docs with _key, of the source, and _unit, of the id, or the text where that is null."""
    return docs.withColumns({"_key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")), "_unit": F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.xxhash64(text).cast("string")))})


def copies(sizes: DataFrame, by_source: DataFrame, seed: str = SEED) -> DataFrame:
    """_key, _unit, _source_size, _target and _copies of each unit of sizes (_key, _unit, size).

    Rows of a source and unit are one draw. In the order of size and hash, the fractions of a source's units are added up from an offset that
    is a hash of the seed and source, and a unit whose sum passes a whole number has one copy more.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    rates = by_source.select(key.alias("_key"), "n_docs", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    units = sizes.groupBy("_key", "_unit").agg(F.sum("size").alias("size")).withColumn("_coin", coin(F.col("_unit"), seed))
    order = ["size", "_coin", "_unit"]
    dealt = units.repartitionByRange(partitions(sizes.sparkSession), "_key", *order).withColumn("_pid", F.spark_partition_id())
    placed = written(dealt.withColumn("_pos", F.row_number().over(Window.partitionBy("_pid", "_key").orderBy(*order))), "placed")
    so_far = Window.partitionBy("_key").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_pid", "_key").count().select("_pid", "_key", F.coalesce(F.sum("count").over(so_far), F.lit(0)).alias("_before"))  # as many as partitions and sources
    out = join_by_count(placed.join(before, ["_pid", "_key"]), rates, "_key", "n_docs")
    rank, whole, offset = F.col("_before") + F.col("_pos") - 1, F.floor("_rate"), coin(F.concat(F.lit("source:"), F.col("_key")), seed)
    passed = lambda n: F.floor((F.col("_rate") - whole) * n + offset)
    return out.select("_key", "_unit", "_source_size", "_target", (whole + passed(rank + 1) - passed(rank)).alias("_copies"))


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document as often as the mix takes it, with the columns of docs."""
    rows = keyed(docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row")), f"_row.{text}")  # so no column of docs can clash
    with scratch(docs.sparkSession) as keep:
        sizes = written(keyed(docs.select("doc_id", "source", text), text).select("source", "_key", "_unit", n_words(F.col(text)).alias("size")), "sizes")
        taken = keep(written(copies(sizes, targets(sizes)).where("_copies > 0").select("_key", "_unit", "_copies"), "taken"))
    out = rows.join(taken.hint("shuffle_hash"), ["_key", "_unit"])  # it grows with docs, and at no size is sent around
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    with scratch(spark) as keep:
        sizes = keep(written(docs.select("doc_id", "source", "_key", "_unit", n_words(F.col("text")).alias("size")), "sizes"))
        taken = keep(written(copies(sizes, targets(sizes)), "taken"))
    out = sizes.join(taken, ["_key", "_unit"])
    return out.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).alias("taken"))


ORACLE = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) * 1.5::DOUBLE - coalesce(sum(cap) OVER earlier, 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         cap / weight AS fills
  FROM weighed WINDOW earlier AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT coalesce(arg_min(level, fills) FILTER (level < fills), 0.0::DOUBLE) AS level FROM levels),
rates AS (
  SELECT source, source_size, least(cap, weight * chosen.level) AS target,
         CASE WHEN source_size > 0 THEN least(cap, weight * chosen.level) / source_size ELSE 0.0::DOUBLE END AS rate
  FROM weighed, chosen),
units AS (SELECT source, coalesce(CAST(doc_id AS VARCHAR), 'null') AS unit, sum(size) AS size FROM sizes GROUP BY ALL),
placed AS (
  SELECT source, unit, row_number() OVER (PARTITION BY source ORDER BY size, CAST('0x' || substr(md5('mix-1:' || unit), 1, 12) AS BIGINT), encode(unit)) - 1 AS place,
         CAST('0x' || substr(md5('mix-1:source:' || coalesce('=' || source, '-')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS begin
  FROM units)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + floor((rate - floor(rate)) * (place + 1) + begin) - floor((rate - floor(rate)) * place + begin)) AS BIGINT) AS taken
FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source
JOIN placed ON placed.source IS NOT DISTINCT FROM sizes.source AND placed.unit = coalesce(CAST(doc_id AS VARCHAR), 'null')
"""
