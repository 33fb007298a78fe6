"""Document quality by line-first cleaning, in DataFrame functions only.

Lines are judged first (navigation, symbols, shouting, boilerplate, missing punctuation) and failing lines are removed;
a document is rejected if the removed lines hold more than half of its characters, if it has too few words or if too
many of its words stand in repeated five-word windows. Everything happens inside the row: nothing is shuffled, and a
very long text costs n log n of its own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, SPACE_CLASS, let

#: Signs counted as symbols, and phrases of short lines that carry no content.
SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&<>"
BOILERPLATE = "all rights reserved|cookie|click here|subscribe|sign up|log in|terms of (use|service)|privacy policy|javascript|lorem ipsum|read more|share this|back to top"
WINDOW = 5


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def line_fails(line: Column) -> Column:
    """Whether a line is navigation, symbol noise, shouting, boilerplate or a long row of words without punctuation."""
    words, chars = F.size(_words(line)), F.length(F.translate(line, SPACE, ""))
    pipes = _count(line, "|")
    navigation = (pipes >= 2) & (5 * pipes >= words)
    symbols = (10 * _count(line, LINE_SYMBOLS) >= chars) & (chars > 0)
    shouting = (words >= 3) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    boilerplate = (words <= 12) & F.lower(line).rlike(BOILERPLATE)
    unpunctuated = (words >= 10) & ~line.rlike("[.!?:;,…。！？]")
    return navigation | symbols | shouting | boilerplate | unpunctuated


def _repeated(words: Column) -> Column:
    """How many words stand in five-word windows that the text has at least twice; ``words`` are hashes."""
    first = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    windows = F.transform(first, lambda h, i: F.xxhash64(h, *(F.get(words, i + k) for k in range(1, WINDOW))))

    def twice(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        return F.filter(ordered, lambda x, j: ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))) | same(x, j + 1))

    def covered(w: Column) -> Column:
        places = F.sort_array(F.transform(let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))


def quality(docs: DataFrame, text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, max_lost_percent: int = 50) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars (all long), clean_text (the
    lines that pass, joined by a line feed), base_failed and kept.

    A null or empty text has no words, fails and has the clean text ''. Columns of ``docs`` with the names of
    results are replaced; rows are never merged or dropped, so repeated rows give repeated results.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "clean_text", "base_failed", "kept"]
    own = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(*own, text.alias("__text")).withColumn("__lines", F.split("__text", "\n"))
    df = df.withColumn("__words", let(F.transform(_words(F.col("__text")), lambda w: F.xxhash64(w)), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("repeated"))))
    df = df.withColumns({"n_words": F.col("__words.n"), "n_repeat_words": F.col("__words.repeated")})
    df = df.withColumn("__full", F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("__bad", F.filter("__lines", line_fails))
    long = lambda c: c.cast("long")
    df = df.withColumns({
        "word_chars": long(F.length(F.translate("__text", SPACE, ""))),
        "n_symbols": long(_count(F.col("__text"), SYMBOLS)),
        "n_dup_lines": long(F.size("__full") - F.size(F.array_distinct("__full"))),
        "lost_chars": F.aggregate("__bad", F.lit(0).cast("long"), lambda a, x: a + F.length(F.translate(x, SPACE, ""))),
        "clean_text": F.when(F.size("__bad") == 0, F.col("__text")).otherwise(F.array_join(F.filter("__lines", lambda x: ~line_fails(x)), "\n")),
    })
    df = df.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost_percent * F.col("word_chars")))
    return df.select(*own, *made)
