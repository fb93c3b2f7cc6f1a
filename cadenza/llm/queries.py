"""The contract queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import bpe as _bpe
from cadenza.llm import line_dedup as _lines
from cadenza.llm import ngram_join as _near
from cadenza.llm import packing as _packing
from cadenza.llm import quality_model as _quality
from cadenza.llm import quality_rules as _rules
from cadenza.llm import sharding as _sharding
from cadenza.llm import substring_dedup as _substring
from cadenza.llm import toxicity as _toxicity
from cadenza.llm import vector_search as _vectors

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules.digest(_rules.quality_rules(documents(spark, sf_dir)))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.ngram_join(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharding.digest(_sharding.shard_documents(documents(spark, sf_dir)))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring.digest(_substring.substring_dedup(documents(spark, sf_dir)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.digest(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines.digest(_lines.line_dedup(documents(spark, sf_dir)))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.digest(documents(spark, sf_dir), labels(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_bpe": op2_bpe,
        "op3_ngram_join": op3_ngram_join,
        "op4_packing": op4_packing,
        "op5_sharding": op5_sharding,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_line_dedup": op8_line_dedup,
        "op9_vector_search": op9_vector_search,
        "op10_quality_model": op10_quality_model,
    }
