"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import alignment, bpe, chat, fertility, maxent, mixing, ordinal, packed, parity, phrases, pii, substring, topk
from loam.llm.common import table

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    counts = ("n_email", "n_ip", "n_card", "n_phone", "n_added")
    return found.select("doc_id", *counts, sum(map(F.col, counts)).alias("n_spans"), F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(BYTE_RANKS)
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ordinal.score(docs, ordinal.fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("kept", F.col("p_good") >= 0.5)


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.apply_rules(table(spark, sf_dir, "documents"), fertility.Rules(PIECE_MODEL, BYTE_RANKS, public_tokenizers.PATTERN))


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.jaccard_components(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_MODEL, digest=True)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed.pack(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_formatting, op2_maxent_lm, op3_pii, op4_substring_dedup, op5_byte_bpe, op6_ordinal_quality, op7_exact_topk, op8_mixing, op9_tokeniser_fertility, op10_parity_join, op11_tokenizer_alignment, op12_phrase_collocations, op13_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.ORACLE, "op7_exact_topk": topk.ORACLE, "op8_mixing": mixing.ORACLE, "op12_phrase_collocations": phrases.ORACLE}
