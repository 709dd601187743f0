"""From raw documents to a mixed, encoded training set, in five stages.

Every stage takes (spark, documents so far, folder of the tables) and returns a DataFrame; `run` writes each
result to the shared folder and reads it again as the next stage's documents, so a lost executor costs one stage
at most.  All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bourse.llm import bpe, exact_dedup, mixing, near_dedup, quality
from bourse.llm.common import documents, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among them."""
    return quality.scored(docs, quality.train(docs, documents(spark, sf_dir, "labels")), keep=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per text, white space aside."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per near-duplicate class."""
    return near_dedup.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, shared out by weight; a document may be taken up to three times."""
    return mixing.mixed(docs, share=(1, 1), epochs=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) per row of the mix."""
    # workers of the earlier stages are still alive: a smaller memory of chunks
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=200_000)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix), ("encode", encode)]

#: the classifier is no SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
