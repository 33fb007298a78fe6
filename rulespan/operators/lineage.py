"""Cutting of lineage by tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine for a local master, and an error on a cluster."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("rulespan.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("rulespan.shared.dir", at)
    return at


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written there and read again, so that what follows does not depend on what came before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
