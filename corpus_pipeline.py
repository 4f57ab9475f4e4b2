"""The corpus pipeline: stages that each apply one operator to what the stage before it kept.

Every stage but the last returns the columns of documents. run() writes each stage's rows as a table in the shared folder, and
the next stage reads them, so a lost executor costs no more than the stage at hand.

Cases, for every stage: an empty table gives no rows; rows that repeat are handled one by one, but for near duplicates; columns
that documents lacks, or that have names of an operator's own, are handed on untouched; texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wickflow.llm import jaccard_join, mixing, packing, quality, toxicity
from wickflow.llm.common import scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and very short texts among them; null ids and sources stay."""
    return quality.filter_quality(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go; it learns from the labels of those that are left.

    Null and empty texts are scored like texts without words; without labels of both classes all documents stay.
    """
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the least doc_id stays.

    Rows with a null id and texts without words stay; of rows that repeat an id one stays.
    """
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; copies are equal rows.

    Null is a source of its own; documents of a source without words are not taken.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens; a copy is packed like any other document.

    A null or empty text has the end id alone; null ids are packed like others.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", near_duplicates),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]
#: SQL can't train the classifier or run the tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
    return docs
