"""Rollouts, id lists, registries and metric files as tables, and what is left to do after an interrupted run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def eval_rows(rollouts: DataFrame) -> DataFrame:
    """(id, rollout_id, index, question, prediction, answer, acc) of every sample of ``rollouts`` (rollout_id, samples of
    (index, prompt, response, label, reward, metadata)); question as :func:`question_of`, answer is the first label."""
    s = rollouts.select("rollout_id", F.explode("samples").alias("s")).select("rollout_id", "s.*")
    return s.select(F.concat_ws("_", "rollout_id", "index").alias("id"), "rollout_id", "index", question_of(F.col("metadata"), F.col("prompt")).alias("question"), F.coalesce("response", F.lit("")).alias("prediction"), F.get("label", F.lit(0)).alias("answer"), F.col("reward").getItem("acc").alias("acc"))


def question_of(metadata: Column, prompt: Column) -> Column:
    """The first filled one of question, stem and title of a map of metadata; else what stands between ``User:`` and the
    assistant's turn; else the whole prompt."""
    given = [F.nullif(F.trim(F.try_element_at(metadata, F.lit(k))), F.lit("")) for k in ("question", "stem", "title")]
    said = F.nullif(F.trim(F.regexp_extract(F.coalesce(prompt, F.lit("")), r"(?is)User:\s*(.*?)(?=\nAssistant:|<Assistant|\z)", 1)), F.lit(""))
    return F.coalesce(*given, said, F.trim(F.coalesce(prompt, F.lit(""))))


def count_samples(rollouts: DataFrame, most: int | None = None, **capped: int) -> DataFrame:
    """One row: n_rollouts and n_samples, each rollout's samples counted up to ``most``; in the same pass a column for each name
    of ``capped``, counted up to its number."""
    n = F.coalesce(F.size("samples"), F.lit(0))
    total = lambda cap: F.coalesce(F.sum(n if cap is None else F.least(n, F.lit(cap))), F.lit(0))
    return rollouts.agg(F.count("*").alias("n_rollouts"), total(most).alias("n_samples"), *(total(cap).alias(name) for name, cap in capped.items()))


def indexed(rollouts: DataFrame, order: str, width: int = 65_536) -> DataFrame:
    """(order, pos, global_index): the place of every sample when rollouts are in the order of a whole number.

    Sums run inside ranges of ``width`` numbers, and once over the totals of the ranges: no task sees all rollouts.
    """
    sizes = rollouts.select(F.col(order), F.size("samples").alias("n"), F.floor(F.col(order) / width).alias("__range")).where("n > 0")
    inside = F.sum("n").over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    above = sizes.groupBy("__range").agg(F.sum("n").alias("__n")).withColumn("__above", F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    before = sizes.withColumn("__in", inside).join(above, "__range").select(order, (F.coalesce("__in", F.lit(0)) + F.coalesce("__above", F.lit(0))).alias("__before"))
    return rollouts.select(order, F.posexplode("samples").alias("pos", "__s")).join(before, order).select(order, "pos", (F.col("__before") + F.col("pos")).alias("global_index"))


def id_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id): the ids of a text table, one a line, without what follows ``#``, blanks and repeats."""
    return lines.select(F.trim(F.split_part(F.col(column), F.lit("#"), F.lit(1))).alias("id")).where("id <> ''").distinct()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return id_list(spark.read.text(path))


def upserted(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of all ``tables`` by key; where several have one, the row of the first table that has it. A table's own repeats
    keep the row that is smallest by its other columns."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("__table", F.lit(i))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in key and c != "__table"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("__table", *rest))
    return every.withColumn("__r", first).where("__r = 1").drop("__r", "__table")


def pending(work: DataFrame, done: DataFrame, key: list[str], failed: Column | None = None) -> DataFrame:
    """Rows of ``work`` that ``done`` does not have; those that are ``failed`` there are to be done again."""
    kept = done if failed is None else done.where(~F.coalesce(failed, F.lit(False)))
    return work.join(kept.select(*key).distinct(), key, "left_anti")


def append_pending(work: DataFrame, key: list[str], path: str, step) -> int:
    """Run ``step`` (DataFrame to DataFrame with the columns of ``key``) on what the table at ``path`` lacks, append the
    result there and return how many rows were left to do. A run that was cut off goes on where it stopped."""
    spark = work.sparkSession
    try:
        left = pending(work, spark.read.parquet(path), key)
    except Exception as e:  # no run has written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        left = work
    left = left.persist()
    n = left.count()
    if n:
        step(left).write.mode("append").parquet(path)
    left.unpersist()
    return n


def checkpoint_size(summary: Column, path: Column) -> Column:
    """The size of a checkpoint: as a summary states it, else the number after ``ckpt_`` in a path, else 0."""
    return F.coalesce(summary.cast("int"), F.nullif(F.regexp_extract(path, r"ckpt_(\d+)", 1), F.lit("")).cast("int"), F.lit(0))


def metric_files(spark: SparkSession, glob: str) -> DataFrame:
    """(file, size, metrics…) of the JSON files of a glob, one row each, in order of size."""
    df = spark.read.option("multiLine", True).json(glob).withColumn("file", F.input_file_name())
    given = F.col("checkpoint_size") if "checkpoint_size" in df.columns else F.lit(None)
    return df.withColumn("size", checkpoint_size(given, F.col("file"))).orderBy("size", "file")


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
