"""Work that goes on where it stopped: a stream of work rows, a state of the keys that are done, and a sink that may be
written twice.

Each key passes once for each attempt; the state store keeps what has passed and grows with the keys, not with the rows
or results. Every micro-batch writes one folder of the results, named by its number. A run that is cut off between a
write and its commit does that batch again and replaces the folder, so that no result is lost or there twice. Rows that
failed are read from the results as a second source of work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def result_schema(work: DataFrame, step: Callable[[DataFrame], DataFrame]) -> StructType:
    """The columns of ``step``'s results for rows of ``work``, found on an empty table."""
    empty = work.sparkSession.createDataFrame([], work.schema).withColumn("attempt", F.lit(0))
    found = step(empty).schema
    lost = [c for c in (*work.columns, "attempt", "failed") if c not in found.names]
    if lost:
        raise ValueError(f"the step loses or lacks the columns {lost}")
    return found


def resume(work: DataFrame, key: list[str], path: str, step: Callable[[DataFrame], DataFrame], tries: int = 3) -> StreamingQuery:
    """Start ``step`` on the rows of the stream ``work`` that the results under ``path`` lack; it ends when what there was
    at the start is done, and another call goes on.

    ``step`` takes and returns DataFrames: it gets the columns of ``work`` and attempt (0 for new work), and returns them
    with its results and failed (boolean, null: not failed). A failed row is tried again in the next call, ``tries`` times
    in all. Rows that share a key are one piece of work, of which one is done; null is a key like any other. Without work
    nothing is written. ``path`` must be in a folder that driver and executors share. The state belongs to one ``step``
    and one ``key``: with others take another path.
    """
    spark = work.sparkSession
    schema = result_schema(work, step)
    at = f"{path}/results"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{at}/none")
    again = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(at).where(F.col("failed") & (F.col("attempt") + 1 < tries))
    todo = work.withColumn("attempt", F.lit(0)).unionByName(again.select(*work.columns, (F.col("attempt") + 1).alias("attempt")))

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{at}/batch-{number}")

    return todo.dropDuplicates([*key, "attempt"]).writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def drain(work: DataFrame, key: list[str], path: str, step: Callable[[DataFrame], DataFrame], tries: int = 3) -> DataFrame:
    """All that :func:`resume` can do, failed rows included, and its :func:`results`."""
    for _ in range(tries):
        resume(work, key, path, step, tries).awaitTermination()
    return results(work.sparkSession, path, result_schema(work, step))


def results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Every result under ``path``, failed ones included; a key has one row for each attempt."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/results")
