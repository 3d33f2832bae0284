"""The corpus pipeline: stages applied to the documents table, each written and read again.

A stage is a function (spark, docs, sf_dir) -> DataFrame that works on every row its
predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm import bpe, minhash, mixing, suffix, toxicity
from groundspark.llm.common import divided, every, numbered, scratch, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go.

    Null and empty texts stay; rows are judged by their texts, whatever their doc_id; an
    empty table gives an empty table; without labels of both kinds nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: of the smallest doc_id, null last.

    Rows are told apart by a number, so rows that repeat a doc_id or have none are judged by
    their texts like all others; of equal rows one stays. Rows without a word, null texts
    included, stay. An empty table gives an empty table.
    """
    row, group = unused(docs.columns, "row_number"), unused(docs.columns, "group_number")
    rows = numbered(docs, row)
    groups = minhash.minhash_groups(rows.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80)
    groups = groups.where("n_shingles > 0").select(F.col("doc_id").alias(row), F.col("component_id").alias(group))
    several = groups.groupBy(group).agg(F.count("*").alias("n")).where("n > 1").select(group)
    members = rows.select(row, "doc_id").join(scratch(groups.join(several, group), "members"), row)
    members = scratch(members, "ids")
    first = members.groupBy(group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", row))[row].alias(row))
    gone = unused(rows.columns, "gone")
    dropped = members.select(row).join(first.select(row), row, "left_anti").withColumn(gone, F.lit(True))
    apart, maybe = divided(rows, scratch(dropped, "dropped"), row)
    return apart.select(every(docs.columns)).unionByName(maybe.where(F.col(gone).isNull()).select(every(docs.columns)))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that repeat leave the texts; documents stay.

    Each row is a text of its own; null and empty texts stay as they are; an empty table
    gives an empty table.
    """
    return suffix.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it.

    Null sources are one source, null doc_ids one id; rows without a word are not taken; an
    empty table gives an empty table.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with the digests of ids and decoded text.

    One row a row, repeats and null doc_ids included; a null text has no tokens.
    """
    import public_tokenizers

    return bpe.encode_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL: training, signatures and merges are beyond it; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows go to the shared folder as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch(docs, name)
    return docs
