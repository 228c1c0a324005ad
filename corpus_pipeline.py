"""From raw documents to packed training sequences: five stages, each one operator over all that the last one kept.

Every stage but the last returns the columns of `documents`.  `run` writes each stage as
Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import blocks, decontamination, language_id, near_dedup, packing, substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language (`und`: null texts and texts without a letter); a missing label becomes the language found.

    Where no row has a label there is no language to find, and texts with a letter stay.
    """
    found = language_id.identify(docs, language_id.teaching(), carry=tuple(COLUMNS))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) | F.col("text").rlike(r"\p{L}"))
    known = F.when(F.col("lang_pred") != language_id.UNKNOWN, F.col("lang_pred"))
    return kept.withColumn("lang", F.coalesce("lang", known)).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the least doc_id stays; documents without an id stay."""
    copies = near_dedup.near_duplicate_classes(docs).where("class_id <> doc_id").select("doc_id")
    return blocks.without(docs, copies).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words of repeated windows; untouched texts stay as they are, and emptied documents go."""
    return substring_dedup.rewrite(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's passage go; another text of the same doc_id stays."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    versions = docs.withColumn("version", F.xxhash64("text"))
    return blocks.without(versions, found.select("doc_id", "version")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Language models, sampled similarity and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = blocks.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
