"""A corpus pipeline over ``documents``: quality rules, near-duplicates,
personal data, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet below ``spark.checkpoint.dir`` and reads back for the next.
All stages but the last return the columns of ``documents``; the last returns
one row per document that the mix takes (copies repeat): doc_id,
n_tokens and ids (little-endian 32-bit numbers).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prefloom.llm import bpe_lexicon, fast_minhash, pareto_mix, pii_disclosure, quality_table
from prefloom.llm.common import saved
from prefloom.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_table.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8) stays."""
    return fast_minhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that disclose it, are generalised."""
    return pii_disclosure.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; documents taken twice repeat."""
    return pareto_mix.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe_lexicon.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("encoded", encoded),
]

#: SQL cannot express near-duplicate components and BPE at this size; the
#: pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
