"""Cleaning of a corpus in stages: each takes the documents that its predecessor kept.

run() gives the packed pieces of what is left. The stages train a model, compare sketches and evolve groupings, which
SQL cannot express; ORACLE_SQL is None. The tests hold line dedup and near duplicates here against brute force, the others as operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.llm import line_dedup, minhash_dedup, packing, quality_rules, toxicity
from rulespan.llm.shared import cut

ORACLE_SQL = None


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``docs`` with another text and its length."""
    return docs.withColumns({"text": F.col(text), "n_chars": F.length(text).cast("long")}).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model is fitted on the labelled ones of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    labelled = docs.select("doc_id", "text").join(labels, "doc_id")
    scored = toxicity.fit(labelled).score(docs.withColumn("__text", F.col("text")), "__text")
    return scored.where("predicted = 0").select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    judged = quality_rules.quality(docs).where("kept")
    return _with_text(judged, docs.columns, "clean_text")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of a line that ten or more of them share only the first occurrence stays, and so one copy of a text."""
    return _with_text(line_dedup.dedup_lines(docs, keep_first=True), docs.columns, "kept_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    gone = minhash_dedup.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality rules", apply_quality_rules), ("line dedup", drop_shared_lines), ("near duplicates", drop_near_duplicates), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
