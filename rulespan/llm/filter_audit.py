"""How the filters of a corpus overlap: what each removes in every order of applying them.

Every document gets a mask of the filters that it fails. Four are rules of its own text. The fifth is identity with an
earlier document, found by partition refinement: documents are split by their length in code points, then by the hash of
one block of text after another, each block sixteen times the one before it; a class with one member is dropped as soon
as it arises. Only the survivors fetch their texts again, and these are compared in full, so that no result rests on a hash.
Counts of equal masks then give every order of the filters without another look at a document.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.phrase_index import bitmap, may_hold
from .shared import SPACE_CLASS, cut, let

FILTERS = "ABCDE"
#: Characters of the first block; every further block ends sixteen times further on.
FIRST_BLOCK, GROWTH = 64, 16
#: A class of more than one ``HOT``-th of all rows is hot: there are fewer than ``HOT`` of them, however many rows there are.
HOT = 2_000
#: Bits of the bitmap of surviving classes, two megabytes: texts whose bit is not set are not shuffled.
BITS = 1 << 24
#: Members of a class that meet one copy of its smallest text.
GROUP = 200


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: under 200 words (1), under half of the words distinct (2), more than
    2 % capitals A-Z (4), a character of ``[#$%&*|]`` (8)."""

    def judged(words: Column) -> Column:
        n = F.size(words)
        return F.when(n < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(words)) < 50 * n, 2).otherwise(0)

    words = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    capitals = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), 4).otherwise(0)
    return let(words, judged) + capitals + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def block_hashes(text: Column) -> Column:
    """Hashes of the blocks of a text, which together cover all of it: characters 0 to 64, to 1,024, to 16,384 and so on."""

    def ends(n: Column) -> Column:
        blocks = F.when(n <= FIRST_BLOCK, 0).otherwise(F.ceil(F.log(float(GROWTH), n / F.lit(FIRST_BLOCK))).cast("int"))
        return F.transform(F.sequence(F.lit(0), blocks), lambda k: F.least(F.lit(FIRST_BLOCK) * F.pow(F.lit(GROWTH), k), n.cast("double")).cast("int"))

    def hashed(bounds: Column) -> Column:
        return F.transform(bounds, lambda end, k: F.xxhash64(F.substring(text, F.when(k == 0, 1).otherwise(F.get(bounds, k - 1) + 1), end - F.when(k == 0, 0).otherwise(F.get(bounds, k - 1)))))

    return let(ends(F.length(text)), hashed)


def _class(hashes: Column) -> Column:
    """The class of a text by all of its blocks."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: F.xxhash64(a, h))


def _meet(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """``rows`` of the ``classes`` (n, c, m: members), without a hot class in one task: fewer than ``HOT`` classes can have
    more than 1 / ``HOT`` of the ``total`` rows, and these are broadcast."""
    cold, hot = F.col("m") * HOT <= total, F.col("m") * HOT > total
    hottest = F.broadcast(classes.where(hot).withColumnRenamed("m", "mh"))
    marked = rows.join(hottest, ["n", "c"], "left")
    warm = marked.where("mh IS NOT NULL").withColumnRenamed("mh", "m")
    return warm.unionByName(marked.where("mh IS NULL").drop("mh").join(classes.where(cold), ["n", "c"]))


def identical(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents whose text another document has too: doc_id, n, c and first, the smallest doc_id with this very text.

    ``docs`` has doc_id and text, ``blocks`` the same rows as doc_id, n (code points) and h (``block_hashes``); ids are
    not null but may repeat. Rows of one id, length and class of blocks (c) count as one document.
    """
    total = blocks.count()
    columns = ["doc_id", "n", "c", "h"]
    rest = blocks.select("doc_id", "n", F.lit(0).cast("long").alias("c"), "h")
    k = 0
    while True:  # the class of length and the first k blocks; there are about log16(longest / 64) blocks
        classes = rest.groupBy("n", "c").agg(F.count("*").alias("m")).where("m > 1")
        rest = cut(_meet(rest, classes, total).select(*columns, "m"), "audit-classes")
        more = rest.agg(F.max(F.size("h"))).first()[0]
        if more is None or more <= k:
            break
        rest = rest.select("doc_id", "n", F.when(F.size("h") > k, F.xxhash64("c", F.get("h", F.lit(k)))).otherwise(F.col("c")).alias("c"), "h")
        k += 1
    found = rest.groupBy("doc_id", "n", "c").agg(F.first("m").alias("m"))
    text = docs.select("doc_id", F.length("text").alias("n"), _class(block_hashes(F.col("text"))).alias("c"), "text")
    text = text.join(F.broadcast(bitmap(found, F.col("c"), BITS))).where(may_hold(F.col("bits"), F.col("c"), BITS)).drop("bits")
    left = cut(text.join(found.hint("merge"), ["doc_id", "n", "c"]).select("doc_id", "n", "c", "m", "text"), "audit-texts")
    done = []
    while True:  # one pass, and one more for each text that shares all hashes with another one
        spread = F.ceil(F.col("m") / GROUP)
        first = left.groupBy("n", "c", "m").agg(F.min(F.struct("doc_id", "text")).alias("f"))
        copies = first.select("n", "c", F.explode(F.sequence(F.lit(0).cast("long"), spread - 1)).alias("salt"), "f")
        salted = left.withColumn("salt", F.pmod(F.xxhash64("doc_id"), spread))
        same = F.col("text") == F.col("f.text")
        compared = salted.join(copies, ["n", "c", "salt"]).select("doc_id", "n", "c", "m", F.when(same, F.col("f.doc_id")).alias("first"), F.when(~same, F.col("text")).alias("text"))
        compared = cut(compared, "audit-compared")
        done.append(compared.where("first IS NOT NULL").select("doc_id", "n", "c", "first"))
        left = compared.where("first IS NULL").drop("first")
        if left.isEmpty():
            break
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out.groupBy("doc_id", "n", "c").agg(F.min("first").alias("first"))


def masks(docs: DataFrame, part_col: str = "source") -> DataFrame:
    """Every row of ``docs`` as doc_id, part (the value of ``part_col`` as a string, null: empty) and mask, the bits of the
    failed filters A (1) to E (16).

    A null text is an empty one. Rows without an id fail no E and make no other row fail it. Repeated rows stay; those of one
    id are no copies of each other. Other columns, whatever their names, are not read. No rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    hashes = block_hashes(F.col("text"))
    judged = cut(base.select("doc_id", "part", F.length("text").alias("n"), hashes.alias("h"), own_failures(F.col("text")).alias("own")), "audit-judged")
    copies = identical(base.where("doc_id IS NOT NULL").select("doc_id", "text"), judged.where("doc_id IS NOT NULL")).where("doc_id > first")
    marked = judged.withColumn("c", _class(F.col("h"))).join(copies, ["doc_id", "n", "c"], "left")
    return marked.select("doc_id", "part", (F.col("own") + F.when(F.col("first").isNotNull(), 16).otherwise(0)).cast("int").alias("mask"))


def _steps() -> Column:
    """All steps of all orders of the filters, as an array of 600 structs: order, step, bits before it and its own bit."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(bit).alias("bit")))
            before |= bit
    return F.array(*steps)


def interactions(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part of ``masked`` (doc_id, part, mask), order of the filters and step: how many documents are kept after
    it, removed by it, fail it but are gone before (redundant), fail nothing else (unique_fails), are removed though good
    (good_lost) or while toxic (toxic_lost), and the filter's removals over all orders (shapley).

    ``labels`` has doc_id, quality and toxic; a document is good or toxic if any of its label rows says so, and neither if
    it has none. Parts are those of ``masked``; a part's rows are added up before they meet, to 32 rows.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    one = masked.join(known, "doc_id", "left")
    counts = one.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    each = parts.select("part", "masks", F.explode(_steps()).alias("s")).select("part", "masks", "s.*")
    before, bit = F.col("before"), F.col("bit")

    def total(condition, value="n"):
        return F.aggregate("masks", F.lit(0).cast("long"), lambda a, x: a + F.when(condition(x["mask"]), x[value]).otherwise(0))

    removed = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(bit) != 0)
    fails = lambda m: m.bitwiseAND(bit) != 0
    orders = math.factorial(len(FILTERS))  # of these, a filter comes before all others that a mask holds in one of bit_count(mask)
    first = F.aggregate("masks", F.lit(0).cast("long"), lambda a, x: a + F.when(fails(x["mask"]), (x["n"] * F.lit(orders) / F.bit_count(x["mask"])).cast("long")).otherwise(0))
    return each.select(
        "part", "filter_order", "step",
        total(lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total(removed).alias("removed"),
        total(lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"), total(lambda m: m == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), first.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """``interactions`` of the ``masks`` of ``docs`` (doc_id, text, ``part_col``); an empty table gives no rows."""
    return interactions(masks(docs, part_col), labels)
