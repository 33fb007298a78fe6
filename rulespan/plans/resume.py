"""Documents as a stream of work that fails at first for some and is taken up again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.operators.lineage import shared_folder
from rulespan.streaming import resume as R


def _counted(docs: DataFrame) -> DataFrame:
    """Words of each text; texts with a digit fail the first time."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", "attempt", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"), (text.rlike("[0-9]") & (F.col("attempt") == 0)).alias("failed"))


def resumed_counts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, attempt, n_words) of every document after as many runs as it takes."""
    at = f"{d}/documents.parquet"
    # as a pattern, since a stream takes a plain path for a folder
    work = spark.readStream.schema(spark.read.parquet(at).select("doc_id", "text").schema).parquet(f"{d}/[d]ocuments.parquet")
    done = R.drain(work, ["doc_id"], f"{shared_folder(spark)}/resumed-{uuid.uuid4().hex}", _counted, tries=2)
    return done.where("not failed").select("doc_id", "attempt", "n_words")


FUNCTIONS = [resumed_counts]
SQL = {
    "resumed_counts": r"""
        SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 1 ELSE 0 END::INTEGER AS attempt,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_words
        FROM documents""",
}
