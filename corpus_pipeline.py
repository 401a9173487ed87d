"""A corpus from raw documents to packed token sequences, in four stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from embspark.llm.byte_repeats import deduplicated_texts
from embspark.llm.common import checkpoint
from embspark.llm.packing import pack
from embspark.llm.quality import clean_texts
from embspark.llm.simhash import first_of_each_group

#: Bytes of a passage that may not repeat: below the length of 51 words in any of the languages.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above the limit."""
    return clean_texts(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return first_of_each_group(docs, shingle=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document, or an earlier place, has already."""
    return deduplicated_texts(docs, PASSAGE_BYTES)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: The stages hold suffix arrays, fingerprints and tokenizers; the tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's rows are written to the shared checkpoint folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
