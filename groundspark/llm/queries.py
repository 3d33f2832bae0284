"""The operators bound to the tables of a data folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .oracle import ORACLE_SQL  # noqa: F401


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("byte_bpe_50k.json"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_digests

    return token_file_digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer("word_bpe_49k.json"), end_id=2)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_dedup import vector_groups

    return vector_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents, train

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import minhash_groups

    return minhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80)


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import suffix_dedup

    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_files, op3_mixing, op4_sharding, op5_vectors, op6_toxicity, op7_minhash, op8_suffix, op9_substring, op10_quality_rules)}
