"""Evaluation sets of exact sizes from pools of samples, in proportion to their strata, and export by index.

Sizes are dealt to cells of pool and stratum first, from counts alone. A cell's rows are then taken in the order of a hash, as
a bottom-k sample: only rows below a bound that the quota implies are shuffled, whatever the cell's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A set: its name, its size, and the pools that it is taken from, the next one only for what the one before lacks.
Sets = list[tuple[str, int, list[str]]]


def place(key: Column, seed: int) -> Column:
    """The place of a key in the draw: the first 60 bits of a digest, so that any engine draws alike."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 15), 16, 10).cast("long")


def allocate(cells: DataFrame, sets: Sets) -> DataFrame:
    """``cells`` (pool, stratum, n) with draws, an array of (set, low, high): the ranks low < r <= high of a cell are the set's.

    A set takes what it still needs from its next pool in proportion to what its cells have left, rounded down, and the
    remainder by largest remainders, ties by stratum. Sets are served in order and never share a row. A set that its pools
    cannot fill is an error. Windows are over the cells of a pool, one row each.
    """
    per = Window.partitionBy("pool")
    df = cells.select("pool", "stratum", F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("taken"), F.array().cast("array<struct<set:string,low:bigint,high:bigint>>").alias("draws"))
    for name, size, pools in sets:
        if len(set(pools)) < len(pools):
            raise ValueError(f"set {name} names a pool twice")
        got = df.withColumn("left", F.col("n") - F.col("taken"))
        order = F.array_position(F.array(*map(F.lit, pools)), F.col("pool"))
        sums = got.where(order > 0).groupBy("pool").agg(F.sum("left").alias("room"), F.min(order).alias("order"))
        before = F.coalesce(F.sum("room").over(Window.orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a pool
        share = sums.select("pool", "room", F.greatest(F.lit(0), F.least(F.col("room"), F.lit(size) - before)).cast("long").alias("share"))
        got = got.join(F.broadcast(share.hint("broadcast")), "pool", "left").fillna(0, ["room", "share"])
        whole = F.col("share").cast("decimal(38,0)") * F.col("left")
        got = got.withColumns({"base": F.when(F.col("room") > 0, F.expr("CAST(share AS DECIMAL(20,0)) * left DIV room")).otherwise(0).cast("long"), "rest": F.when(F.col("room") > 0, whole % F.col("room")).otherwise(0)})
        spare = F.col("share") - F.sum("base").over(per)
        got = got.withColumn("k", F.col("base") + (F.row_number().over(per.orderBy(F.desc("rest"), "stratum")) <= spare).cast("long"))
        drawn = F.when(F.col("k") > 0, F.array(F.struct(F.lit(name).alias("set"), F.col("taken").alias("low"), (F.col("taken") + F.col("k")).alias("high")))).otherwise(F.array().cast("array<struct<set:string,low:bigint,high:bigint>>"))
        df = got.select("pool", "stratum", "n", (F.col("taken") + F.col("k")).alias("taken"), F.concat("draws", drawn).alias("draws"))
    return df


def assemble(rows: DataFrame, sets: Sets, seed: int = 0, key: str = "id") -> DataFrame:
    """(set, key, pool, stratum) of disjoint ``sets`` drawn from ``rows`` (key, pool, stratum; keys distinct and not null).

    Null pools and strata are cells of their own, but no set can name a null pool. Every set has exactly its size, or
    this is a ``ValueError``. The draw depends on keys and ``seed`` only.
    """
    cells = rows.groupBy("pool", "stratum").agg(F.count("*").alias("n"))
    dealt = allocate(cells, sets).where("taken > 0")
    filled = {r["set"]: r["k"] for r in dealt.select(F.explode("draws").alias("d")).groupBy("d.set").agg(F.sum(F.col("d.high") - F.col("d.low")).alias("k")).collect()}
    for name, size, pools in sets:
        if filled.get(name, 0) < size:
            raise ValueError(f"set {name} needs {size} rows, but {' and '.join(pools)} have {filled.get(name, 0)} left")
    hashed = rows.select(F.col(key), "pool", "stratum", place(F.col(key), seed).alias("h"))
    near = F.col("pool").eqNullSafe(F.col("__pool")) & F.col("stratum").eqNullSafe(F.col("__stratum"))
    width = 1
    while True:
        # about taken + 8 sqrt(taken) + 24 rows of a cell lie below the bound; should one have fewer than its quota, it is raised
        bound = F.least(F.lit(1.0), width * (F.col("taken") + 8 * F.sqrt("taken") + 24) / F.col("n")) * float(1 << 60)
        wanted = dealt.select(F.col("pool").alias("__pool"), F.col("stratum").alias("__stratum"), "taken", "draws", bound.alias("bound"))
        low = hashed.join(wanted, near & (F.col("h").cast("double") <= F.col("bound")))
        seen = low.groupBy("pool", "stratum").agg(F.count("*").alias("k"), F.first("taken").alias("taken"))
        if seen.where("k < taken").isEmpty():
            break
        width *= 8
    r = F.row_number().over(Window.partitionBy("pool", "stratum").orderBy("h", key))
    ranked = low.withColumn("r", r).where("r <= taken").select(key, "pool", "stratum", "r", F.explode("draws").alias("d"))
    return ranked.where("r > d.low AND r <= d.high").select(F.col("d.set").alias("set"), key, "pool", "stratum")


def collect_splits(rows: DataFrame, wanted: DataFrame, index: str = "global_index") -> DataFrame:
    """``rows`` at the indices of ``wanted`` (split, index) with their split.

    An index in two splits, or one that no row has, is a ``ValueError`` that names the smallest. The splits' rows are then
    written by ranges of the index: ``repartitionByRange(index)``, ``partitionBy("split")``.
    """
    asked = wanted.select("split", index).distinct()
    twice = asked.groupBy(index).agg(F.count("*").alias("n")).where("n > 1").agg(F.min(index)).first()[0]
    if twice is not None:
        raise ValueError(f"index {twice} stands in more than one split")
    lost = asked.join(rows.select(index), index, "left_anti").agg(F.min(index)).first()[0]
    if lost is not None:
        raise ValueError(f"no row has the index {lost}")
    return rows.join(asked, index)


def export_splits(rows: DataFrame, folder: str, index: str = "global_index", files: int = 8) -> None:
    """Write what :func:`collect_splits` gives as JSON lines, a folder for each split, in files by ranges of the index."""
    rows.repartitionByRange(files, index).sortWithinPartitions("split", index).write.partitionBy("split").json(folder)
