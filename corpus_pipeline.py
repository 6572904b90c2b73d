"""From `documents` to a training mixture, in five stages.

1. quality: documents that the compression classifier rejects go.
2. near_dup: of each group of near copies (five-word shingles, a similarity of 0.8 or more) the document
   of the smallest id stays.
3. substring_dup: words in passages of twenty words or more that stand in an earlier document go,
   and documents that have no word left.
4. decontaminate: documents that hold a window of ten words of a benchmark item go.
5. mixture: documents get the number of times they enter the mixture; those that enter at all stay.

Each stage works on the whole table that the stage before kept, read again from Parquet.
Labels and benchmark come from the data folder. Nulls, empty texts, repeated rows and further
columns are treated as the operators' docstrings say; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm import decontaminate, mixing, near_copies, quality, substring_dup
from tarnwick.session import materialise, release_since, scratch, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def stage_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def stage_substring_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dup.dedup(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs, max_repetition=mixing.MAX_REPETITION)


STAGES = [
    ("quality", stage_quality),
    ("near_dup", stage_near_dup),
    ("substring_dup", stage_substring_dup),
    ("decontaminate", stage_decontaminate),
    ("mixture", stage_mixture),
]

#: Dictionaries, fingerprints and hashed permutations are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = scratch()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        # the stage's own tables and the input it read are done with
        release_since(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
