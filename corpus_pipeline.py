"""Corpus pipeline: quality, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  Stages are written to
the shared folder and read again, so a lost executor costs a re-read of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from soundalike.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality_classifier
from soundalike.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier accepts."""
    return quality_classifier.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and of the decoded text."""
    return byte_bpe.round_trip(docs, *byte_bpe.default_vocabulary(), carried=("doc_id", "lang", "source"),
                               with_ids=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixture", mixture),
          ("byte-level BPE", tokens)]

#: Fitted models and chance by hash are no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
