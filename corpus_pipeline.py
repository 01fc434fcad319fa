"""The corpus pipeline: documents become token ids by five operators of the llm subpackage, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import bpe, mixing, ordinal, parity, pii
from loam.llm.common import table, written

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LEAST_GOOD = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the table labels, rejects go."""
    return ordinal.select_good(docs, ordinal.fit(docs, table(spark, sf_dir, "labels")), LEAST_GOOD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return parity.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind."""
    return pii.mask(docs, pii.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources give words up to their targets: some documents come again, some are cut, some go."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (of the text, little-endian unsigned 32-bit) and the sha256 of the bytes that they decode to.

    Repeated rows (the mix repeats documents), null ids and null texts: a row out for each row in.
    """
    ranks = bpe.read_ranks(BYTE_RANKS)
    decoded = bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("encode", encode),
]

#: No SQL expresses the fitted stages; tests/llm/test_pipeline.py tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, with every result but the last one's written in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
