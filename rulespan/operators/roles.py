"""The engine's inputs as views of the tables: samples from documents, rules from benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TYPES = ["units", "calculation", "modeling", "concept", "logic"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, question (the first line), prediction (the whole text), context."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("question"), F.col("text").alias("prediction"), F.concat_ws(" ", "lang", "source").alias("context"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule_no, rule_id, domain, topic, title, trigger, check_logic, error_type, support, is_meta."""
    words = F.split(T.norm_text(F.col("text")), " ")
    part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    no = F.col("item_id")
    kind = F.element_at(F.array(*(F.lit(t) for t in TYPES)), (no % 5 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(
        no.alias("rule_no"), F.concat(F.lit("exp_"), no).alias("rule_id"), F.concat(F.lit("D"), no % 6).alias("domain"), F.concat(F.lit("T"), no % 12).alias("topic"),
        part(1, 5).alias("title"), part(1, 20).alias("trigger"), part(21, 1_000_000_000).alias("check_logic"), kind.alias("error_type"), (no % 7).alias("support"), (no % 9 == 0).alias("is_meta"),
    )


#: The same in DuckDB SQL.
SAMPLES_SQL = "samples AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS question, text AS prediction, lang || ' ' || source AS context FROM documents)"
RULES_SQL = r"""words AS (SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
rules AS (SELECT item_id AS rule_no, 'exp_' || item_id AS rule_id, 'D' || (item_id % 6) AS domain, 'T' || (item_id % 12) AS topic,
    array_to_string(w[1:5], ' ') AS title, array_to_string(w[1:20], ' ') AS "trigger", array_to_string(w[21:], ' ') AS check_logic,
    ['units', 'calculation', 'modeling', 'concept', 'logic'][item_id % 5 + 1] AS error_type, item_id % 7 AS support, item_id % 9 = 0 AS is_meta FROM words)"""
