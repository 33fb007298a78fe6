"""Files that hold one JSON array of objects, of any size and layout, read in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _depth(value: Column, inside: Column) -> Column:
    """Brackets opened less brackets closed by a piece, strings left out; ``inside``: it begins within a string."""
    bare = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), F.regexp_replace(value, r"\\.", "")), r'"[^"]*+("|$)', "")
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"\]"))


def read_array(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = False) -> DataFrame:
    """The objects of top-level arrays, one row each.

    Files are cut at every ``}``, so that Spark splits them as it splits lines. Whether a piece begins within a string,
    and how deep, is a running sum inside each block of a file, and over one summary row per block across them; a
    record ends where the depth falls back to one. No task reads more than its blocks, nothing passes the driver.
    Elements that are no objects are left out; an object that is not JSON gives nulls. With ``strict`` a file that does
    not begin with an array, or ends before its array does, fails the query; otherwise its whole records are read.
    """
    rows = spark.read.option("lineSep", "}").text(path)
    at = F.col("_metadata")
    block = Window.partitionBy("file", "block").orderBy("i")
    so_far, before = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(Window.unboundedPreceding, -1)
    files = Window.partitionBy("file").orderBy("block")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))

    pieces = rows.select("value", at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("i"))
    pieces = pieces.withColumn("quotes", F.regexp_count(F.regexp_replace("value", r"\\.", ""), F.lit('"')))
    pieces = pieces.withColumns({"seen": zero(F.sum("quotes").over(before)), "final": F.lead("i").over(block).isNull()})
    odd = lambda c: c % 2 == 1
    # A block does not know whether it begins within a string: its pieces are measured for both cases.
    for case in (0, 1):
        inside = odd(F.col("seen") + case)
        shut = F.when(odd(F.col("seen") + F.col("quotes") + case), 0).otherwise(1)
        pieces = pieces.withColumns({f"d{case}": _depth(F.col("value"), inside), f"shut{case}": shut})
    net = lambda case: F.sum(F.col(f"d{case}") - F.col(f"shut{case}"))
    blocks = pieces.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), net(0).alias("n0"), net(1).alias("n1"), F.min_by("value", "i").alias("head"))
    blocks = blocks.withColumn("case", (zero(F.sum("quotes").over(earlier)) % 2).cast("int"))
    blocks = blocks.withColumn("net", F.when(F.col("case") == 1, F.col("n1")).otherwise(F.col("n0")))
    whole = Window.partitionBy("file")
    last = F.lead("block").over(files).isNull()
    # The piece after the last brace has none of its own, so that a whole array sums to minus one.
    broken = (F.sum("net").over(whole) != -1) | ~F.min_by("head", "block").over(whole).rlike(r"^\x{FEFF}?\s*\[")
    blocks = blocks.select("file", "block", "case", zero(F.sum("net").over(earlier)).alias("base"), last.alias("last"), broken.alias("broken"))

    both = pieces.join(blocks, ["file", "block"])
    pick = lambda name: F.when(F.col("case") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    both = both.withColumn("shut", F.when(F.col("final") & F.col("last"), 0).otherwise(pick("shut")))
    both = both.withColumn("depth", F.col("base") + F.sum(pick("d") - F.col("shut")).over(so_far))
    both = both.withColumn("done", ((F.col("depth") == 1) & (F.col("shut") == 1)).cast("int"))
    ends = both.groupBy("file", "block").agg(F.sum("done").alias("ends")).select("file", "block", zero(F.sum("ends").over(earlier)).alias("first"))
    numbered = both.withColumn("within", zero(F.sum("done").over(before))).join(ends, ["file", "block"])
    if strict:
        numbered = numbered.withColumn("value", F.when(F.col("broken"), F.raise_error(F.concat(F.lit("no whole array: "), "file"))).otherwise(F.col("value")))
    record = numbered.groupBy("file", (F.col("first") + F.col("within")).alias("n")).agg(F.max("done").alias("done"), F.array_sort(F.collect_list(F.struct("block", "i", "value"))).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    parsed = F.from_json(F.regexp_replace(text, r"^[^{]*+", ""), schema)
    # The text is looked at even where no record ends, so that a strict read fails there too.
    return record.where((F.col("done") == 1) | (F.length(text) == 0)).select(parsed.alias("r")).select("r.*")
