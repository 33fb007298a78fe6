"""Session settings, and how the package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build(name: str = "rulespan", **conf: str) -> SparkSession:
    """A session with the settings that the engine is written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.parquet.filterPushdown": "true",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors of ``spark``, once per application, so that their Python workers find it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "rulespan.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        context.addPyFile(path)
        _SHIPPED.add(context.applicationId)
    return spark
