"""Helpers that several operators share: lineage cuts, size-checked broadcasts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Characters that separate words in every contract of this subpackage.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset a folder of this machine is taken, which is right only for a local master; a cluster without
    the setting is an error.
    """
    ship(spark)
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("rulespan.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("rulespan.shared.dir", at)
    return at


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage ends there, and an executor that
    is lost later costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are within ``limit``; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list of longs, as (node, component): the smallest node reachable.

    Alternating large-star and small-star steps of the published MapReduce algorithm: every step is a partial aggregation and an
    equi-join, the number of steps grows with the logarithm of the longest path. Self loops and null ends are
    ignored; nodes without edges are not returned.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(low, "u")
        e = cut(step.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(step.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it and wherever the optimizer
    moves the expression: a lambda variable, unlike a column, is never replaced by its definition."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
