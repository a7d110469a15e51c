"""The training-data pipeline over `documents`: quality, near copies, repeated passages, benchmark leaks, packing.

Each stage takes all that its predecessor kept. All but the last return the columns of `documents`; the last returns where each piece
of each document that is left goes. Part of the optional subpackage hushframe.llm, without which it doesn't import.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import decontaminate, near_dup, packing, quality, repeats
from hushframe.llm.common import cut, discard, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a repeated string: about 40 words, so that passages of over 50 words are found wherever their words are short.
REPEAT_BYTES = 200


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score of 0.5 or more). It learns from all labels of documents it gets."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id. A row that repeats is there once. Ids may
    repeat or be null: rows of one id with different texts are told apart by the texts' hashes, as near_dup does."""
    kept = near_dup.hashed_classes(docs).filter("kept").select(row_hash("doc_id", "h1", "h2").alias("rh"), "h1", "h2")
    h1, h2 = near_dup.text_hash(F.col("text"))
    rows = docs.select(*COLUMNS, h1.alias("h1"), h2.alias("h2")).withColumn("rh", row_hash("doc_id", "h1", "h2"))
    return rows.join(kept, ["rh", "h1", "h2"], "left_semi").dropDuplicates(["rh", "h1", "h2"]).select(*COLUMNS)


def row_hash(*columns: str) -> Column:
    """Rows of one id and text have the same one; a null id counts as one."""
    return F.xxhash64(F.lit(2), *columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that also start elsewhere; a document of which nothing but white space is left goes."""
    found = repeats.remove_repeats(docs.select(*COLUMNS), length=REPEAT_BYTES)
    # cutting at bytes may leave parts of a character, which become replacement characters and go; texts that were whole stay as they are
    kept = F.when(F.col("n_removed") == 0, F.coalesce("text", F.lit(""))).otherwise(F.translate(F.make_valid_utf8(F.col("kept").cast("string")), "�", ""))
    left = found.withColumn("text", kept).filter((F.col("n_removed") == 0) | (F.trim(F.col("text")) != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.find_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter(F.size("leaks") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", keep_unleaked),
    ("best-fit packing", pack),
]

#: SQL can't express the stages; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next one reads it; what a stage read goes once it is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{k}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
