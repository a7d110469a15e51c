"""The queries of the training-data operators over the driver's tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import chat, decontaminate, fingerprints, lm_scoring, near_dup, packing, quality, repeats, sql, token_counts, url_filter
from hushframe.llm.common import table


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; a null id has none (-1)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(-1))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs.filter(remainder(3) != 1), labels.filter(remainder(3) != 1))
    return quality.score(docs.withColumn("held_out", remainder(3) == 1), model).drop("text")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lm_scoring.score(docs, docs.filter(remainder(7) != 2))
    return found.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


#: A conversation whose texts are control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat_digests(chat.rows_to_turns(rows.unionByName(added), "conv_id"))


def chat_digests(conversations: DataFrame, *more: str) -> DataFrame:
    """Conversations (conv_id, turns) formatted, and what is read back from the output."""
    chats = chat.format_chats(conversations).select("conv_id", *more, "formatted", "loss_spans")
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = chats.withColumns({"turns": turns, "loss": loss})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", *more, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same conversations as JSON records of four layouts, with fields that no layout names, recognised and formatted."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    whole = chat.rows_to_turns(rows, "conv_id")
    other = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    of = lambda name, a, b, role=lambda r: r: F.to_json(F.struct(F.transform("turns", lambda t: F.struct(role(t["role"]).alias(a), t["text"].alias(b))).alias(name), F.lit("x").alias("origin"), F.lit(None).cast("string").alias("prompt")), {"ignoreNullFields": "false"})
    k = F.pmod("conv_id", F.lit(4))
    record = F.when(k == 0, of("messages", "role", "content")).when(k == 1, of("conversations", "from", "value", other)).when(k == 2, of("turns", "role", "text")).otherwise(of("messages", "role", "text"))
    return chat_digests(chat.canonical(whole.select("conv_id", record.alias("record"))), "layout")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that it leaks."""
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.n_equal", "leak.n_window", "leak.word")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and text are those of strings of 400 bytes; passages_removed and passages_text of strings of
    PASSAGE_BYTES, as the contract's 400 bytes are more than a passage of over 50 words may have."""
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=repeats.PASSAGE_BYTES)
    readable = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), readable("kept").alias("text"), "passages_removed", readable("passages_kept").alias("passages_text"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_url_filter": op3_url_filter,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op7_chat_formatting": op7_chat_formatting,
    "chat_mixed_layouts": chat_mixed_layouts,
    "op6_token_counts": op6_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {**sql.ORACLE_SQL}
