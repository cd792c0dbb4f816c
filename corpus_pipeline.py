"""The training-data pipeline: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schemawake.llm import kneser_ney, mixing, neardup, packing, secrets
from schemawake.llm.common import discard, saved, table
from schemawake.llm.queries import tokenizer_path


#: Positions in a shard of the quality stage: half of op3's, as what the other stages leave in the executors takes room beside them, for more bytes shuffled.
SHARD_WORDS = kneser_ney.SHARD_WORDS // 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text; the others go."""
    return kneser_ney.keep_good(docs, table(spark, sf_dir, "labels"), shard_words=SHARD_WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt into files in the mixed order."""
    return mixing.in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens and their sequences, numbered in the mixed order."""
    return packing.pack_documents(docs, tokenizer_path(), ordered=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix), ("packing", pack)]

#: Kneser-Ney scores, sampled signatures, token ids and local search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's table goes when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
