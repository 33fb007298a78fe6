"""A stream of work that is cut off at every place and goes on."""

import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rulespan.streaming import resume as R

SCHEMA = "id int, text string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def work(spark, tmp_path):
    folder = str(tmp_path / "work")
    for first in range(0, 12, 4):
        add(spark, folder, [(i, f"text {i}") for i in range(first, first + 4)])
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), folder


def step(rows, fails=()):
    return rows.withColumn("size", F.length("text")).withColumn("failed", F.col("id").isin(*fails) & (F.col("attempt") == 0) if fails else F.lit(None).cast("boolean"))


def done(spark, work, path):
    return sorted((r.id, r.attempt) for r in R.results(spark, path, R.result_schema(work, step)).collect())


def test_a_broken_run_goes_on(spark, work, tmp_path):
    stream, folder = work
    path, calls = str(tmp_path / "out"), []

    def breaks(rows):
        calls.append(1)
        if len(calls) == 3:  # the first is for the schema, the third the second batch
            raise RuntimeError("lost")
        return step(rows)

    with pytest.raises(StreamingQueryException, match="lost"):
        R.resume(stream, ["id"], path, breaks).awaitTermination()
    assert len(done(spark, stream, path)) == 4
    R.resume(stream, ["id"], path, step).awaitTermination()
    assert done(spark, stream, path) == [(i, 0) for i in range(12)]
    add(spark, folder, [(3, "text 3"), (12, "new"), (12, "new"), (None, None), (None, "null is a key")])
    for _ in range(2):
        R.resume(stream, ["id"], path, step).awaitTermination()
    rows = [r.id for r in R.results(spark, path, R.result_schema(stream, step)).collect()]
    assert sorted(rows, key=lambda i: -1 if i is None else i) == [None, *range(13)]


def test_a_batch_that_was_written_and_not_committed_is_replaced(spark, work, tmp_path):
    stream, _ = work
    path = str(tmp_path / "out")
    R.resume(stream, ["id"], path, step).awaitTermination()
    commits = os.path.join(path, "state", "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(commits, name)):
            os.remove(os.path.join(commits, name))
    R.resume(stream, ["id"], path, step).awaitTermination()
    assert done(spark, stream, path) == [(i, 0) for i in range(12)]


def test_failed_rows_are_tried_again(spark, work, tmp_path):
    stream, _ = work
    once = R.drain(stream, ["id"], str(tmp_path / "once"), lambda rows: step(rows, (2, 7)), tries=3)
    want = sorted([(i, 0) for i in range(12)] + [(2, 1), (7, 1)])
    assert sorted((r.id, r.attempt) for r in once.collect()) == want
    always = R.drain(stream, ["id"], str(tmp_path / "always"), lambda rows: step(rows).withColumn("failed", F.col("id") == 5), tries=3)
    assert sorted((r.id, r.attempt) for r in always.collect()) == sorted([(i, 0) for i in range(12)] + [(5, 1), (5, 2)])


def test_no_work_and_missing_columns(spark, tmp_path):
    folder = str(tmp_path / "work")
    add(spark, folder, [])
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    assert R.drain(stream, ["id"], str(tmp_path / "out"), step).count() == 0
    with pytest.raises(ValueError, match="failed"):
        R.resume(stream, ["id"], str(tmp_path / "out"), lambda rows: rows)
