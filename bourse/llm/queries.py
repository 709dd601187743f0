"""Registered queries: every operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from bourse.llm import (
    bpe,
    exact_dedup,
    knn,
    maxent_lm,
    mixing,
    near_dedup,
    prefix_trie,
    quality,
    secrets,
    sharding,
    shared_ranking,
    token_counts,
    warc,
)
from bourse.llm.common import documents, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query; without `sql` it is held against a brute-force version in tests/llm."""
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn
    return add


@query("op1_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scored(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


@query("op2_mix_sources", mixing.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).drop("text")


@query("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


@query("op4_bpe_codec")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query("op5_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_exact_dedup", exact_dedup.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.index(documents(spark, sf_dir))


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


@query("op9_top_k", knn.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(documents(spark, sf_dir, "embeddings"))


@query("op10_warc", warc.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_archives(documents(spark, sf_dir, "pages")), "warc")
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_shared_ranking", shared_ranking.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_ranking.search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op12_conversation_trie", prefix_trie.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(documents(spark, sf_dir, "conversations"))


@query("op13_lm_scores")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_scores(documents(spark, sf_dir))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
