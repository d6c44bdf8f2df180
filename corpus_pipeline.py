"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing; each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import mixing, near_dedup, packing, quality, toxicity
from cairn.llm.shared import read, shared_folder
from cairn.operators.staging import remove


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't judged toxic."""
    return toxicity.keep_civil(docs, toxicity.learn_split(read(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix serves."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_good),
    ("toxicity", keep_civil),
    ("simhash_near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashed n-grams, fitted segments and a tokenizer's ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on `documents`; a stage's rows are written as Parquet and reread by the next.

    The rows lie in a new folder of the cluster's shared one; a stage's are removed when the next has been written. Those
    of the last but one stay, for the result reads them.
    """
    docs, folder = read(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}_{name}")
            docs = spark.read.parquet(f"{folder}/{number}_{name}")
            if number:
                remove(spark, f"{folder}/{number - 1}_{STAGES[number - 1][0]}")
    return docs
