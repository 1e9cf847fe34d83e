"""The corpus pipeline: documents through quality rules, language identification, near-dedup and secret masking into packed sequences.

A stage takes (spark, docs, sf_dir) and returns what the next one works on: the
columns of ``documents`` for all but the last, which returns packed pieces.
Every stage works on all rows that it is given, takes other columns along as
they are (the last drops them), and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.llm.common import staged
from tallgrass.llm.language_id import keep_language
from tallgrass.llm.near_dedup import keep_one
from tallgrass.llm.quality_rules import keep_quality
from tallgrass.llm.secrets_cnn import mask_secrets
from tallgrass.llm.tier_packing import tier_pack


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule. A null or empty text fails; rows that repeat stay or go together, whatever their ids."""
    return keep_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. A null text, or one without a letter, is in none; rows that repeat stay or go together; rows with a null id are not learnt from."""
    return keep_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group on five-word shingles at a similarity of 0.8 or more. Texts without words are no group; of rows that repeat an id one stays; rows with a null id stay."""
    return keep_one(docs, width=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts masked. Null texts stay null; rows that repeat are masked alike."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of several lengths. A null text is an empty one, which is its end mark; rows that repeat are packed as often."""
    return tier_pack(docs)


STAGES = [(f.__name__, f) for f in (quality_rules, language_id, near_dedup, secret_scans, packing)]

#: SQL cannot express the model stages; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it; what a written stage has read is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        docs = staged(kept, f"stage-{name}", docs) if k < len(STAGES) - 1 else kept
    return docs
