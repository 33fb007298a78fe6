"""Removal of lines that many documents share, in DataFrame functions only.

Lines become 96-bit hashes with document and position. The hashes are range-partitioned and sorted by document and
position inside each range; the sorted stream yields, per hash, its first occurrence and the number of its documents.
A hash is split over salts before it is dealt out, so that a line in a third of all documents fills no single range;
one row per hash and salt is merged afterwards. What comes back for a document is a compressed bitmap of the lines
that go: no text takes part in any of these shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, cut, small

#: Lines in a word of the bitmap, and salts of a hash.
BITS, SALTS = 32, 64


def line_key(line: Column) -> Column:
    """The line with white space stripped at both ends and A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(SPACE)), upper, upper.lower())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns({"__lines": F.split(text, "\n"), "__row": F.xxhash64(F.col(id_col), text)})


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(row, bitmap): for every document that loses lines, the lines that go.

    row is xxhash64 of id and text; bitmap is a list of (word, bits): bit b of word w stands for line 32 * w + b, and
    words without a bit are left out. A key of at least ``min_chars`` code points that occurs in at least ``min_docs``
    documents loses all its lines, or with ``keep_first`` all but the first by id and position. Rows with equal id
    and text are one document.
    """
    key = line_key(F.col("line"))
    lines = _keyed(docs, id_col, text_col).select(F.col("__row").alias("row"), F.col(id_col).alias("id"), F.posexplode("__lines").alias("pos", "line"))
    lines = lines.withColumn("key", key).where(F.length("key") >= min_chars)
    lines = cut(lines.select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "id", "row", "pos"), "lines")

    salted = lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).repartitionByRange("h", "g", "salt")
    stream = Window.partitionBy("h", "g", "salt").orderBy("id", "row", "pos")
    seen = F.lag("row").over(stream)
    streamed = salted.withColumn("new", (seen.isNull() | (seen != F.col("row"))).cast("long")).where("new = 1")
    per_salt = streamed.groupBy("h", "g", "salt").agg(F.sum("new").alias("n"), F.min(F.struct("id", "row", "pos")).alias("first"))
    keys = per_salt.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_docs)
    keys = cut(keys.select("h", "g", "first"), "shared-lines")
    keys = small(keys, keys.count(), 200_000)
    gone = lines.join(keys, ["h", "g"])
    if keep_first:
        gone = gone.where((F.col("first.row") != F.col("row")) | (F.col("first.pos") != F.col("pos")))
    words = gone.groupBy("row", F.floor(F.col("pos") / BITS).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("bits"))
    return words.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bitmap"))


def positions(bitmap: Column) -> Column:
    """The line numbers that a bitmap marks, in order."""
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    marked = lambda w: F.filter(F.transform(bits, lambda b: F.when(F.getbit(w["bits"], b) == 1, w["word"] * BITS + b)), lambda p: p.isNotNull())
    return F.flatten(F.transform(bitmap, marked))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``docs`` with n_lines, n_dropped (long) and kept_text, the lines that stay joined by a line feed.

    Texts are split at line feeds only; a null or empty text is one empty line. Columns of ``docs`` with these names
    are replaced. Ids may be null or repeated: decisions are per key, and rows find theirs by id and text.
    """
    made = ["n_lines", "n_dropped", "kept_text"]
    own = [c for c in docs.columns if c not in made]
    gone = dropped_lines(docs, id_col, text_col, min_docs, min_chars, keep_first)
    df = _keyed(docs.select(*own), id_col, text_col).join(gone.withColumnRenamed("row", "__row"), "__row", "left")
    df = df.withColumn("__gone", F.coalesce(positions(F.col("bitmap")), F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.size("__gone") == 0, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return df.select(*own, F.size("__lines").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_dropped"), kept.alias("kept_text"))
