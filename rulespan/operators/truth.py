"""Ground truth of mixed age as one table of entries, and the locations of entries and findings made whole.

Rows carry their errors as JSON: a list of located errors, or the older list of error texts alone. Fields are resolved one by
one, each with the name that it was found under, and what a location lacks is filled from the quote, the span or the number of a
paragraph, with the source of what was filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import location as L
from .lineage import cut


def _get(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _text(v: Column, names: list[str]) -> tuple[Column, Column]:
    """The first field of these names with a text that is not blank, trimmed, and its name; else '' and null."""
    value, origin = F.lit(""), F.lit(None).cast("string")
    for name in reversed(names):
        own = F.trim(F.coalesce(_get(v, name, "string"), F.lit("")))
        value, origin = F.when(own != "", own).otherwise(value), F.when(own != "", F.lit(name)).otherwise(origin)
    return value, origin


def gt_entries(rows: DataFrame, current: str = "physics_error_gt", older: str = "physics_error_examples") -> DataFrame:
    """(sample, no, error_id, error_text, text_from, quote, quote_from, start, end, line, span_valid, span_source, paragraph,
    paragraph_start, paragraph_end, paragraph_valid, paragraph_source, locatable) of each error of ``rows`` (sample, json).

    The list ``current`` counts if there is one, however empty; else ``older``, whose errors have no location. Entries that are
    no objects or have no text are left out, but counted in no (from 1) and so in ids that are made. Numbers that are
    absent or no numbers are -1; a span is valid if its ends are, or if it says so. What is no JSON has no errors.
    """
    v = rows.select("sample", F.try_parse_json("json").alias("v"))
    kind = lambda name: F.schema_of_variant(_get(F.col("v"), name, "variant"))
    new = F.coalesce(kind(current).startswith("ARRAY"), F.lit(False))
    items = F.when(new, _get(F.col("v"), current, "array<variant>")).otherwise(_get(F.col("v"), older, "array<variant>"))
    e = v.select("sample", new.alias("new"), F.posexplode(items).alias("no", "e")).where(F.schema_of_variant("e").startswith("OBJECT"))
    error, text_from = _text(F.col("e"), ["error_text", "error"])
    older_error, _ = _text(F.col("e"), ["error"])
    quote, quote_from = _text(F.col("e"), ["answer_quote", "quote"])
    at = F.col("no") + 1
    made = F.concat(F.col("sample").cast("string"), F.when(F.col("new"), "_e").otherwise("_legacy_e"), at.cast("string"))
    number = lambda n: F.when(F.col("new"), _get(F.col("e"), n, "int"))
    says = lambda n: F.when(F.col("new"), F.coalesce(_get(F.col("e"), n, "boolean"), F.lit(False))).otherwise(False)
    some = lambda n: F.coalesce(F.when(number(n) != 0, number(n)), F.lit(-1))
    given = lambda n: F.when(F.col("new"), F.coalesce(_get(F.col("e"), n, "string"), F.lit(""))).otherwise("legacy_no_location")
    span = F.coalesce((number("start_char") >= 0) & (number("end_char") > number("start_char")), F.lit(False)) | says("span_valid")
    part = F.coalesce(number("paragraph_index") >= 1, F.lit(False)) | says("paragraph_valid")
    own_id = F.coalesce(F.when(F.col("new"), F.when(_get(F.col("e"), "error_id", "string") != "", _get(F.col("e"), "error_id", "string"))), made)
    out = e.select(
        "sample", at.alias("no"), own_id.alias("error_id"), F.when(F.col("new"), error).otherwise(older_error).alias("error_text"), F.when(F.col("new"), text_from).otherwise("error").alias("text_from"),
        F.when(F.col("new"), quote).otherwise("").alias("quote"), F.when(F.col("new"), quote_from).alias("quote_from"), F.coalesce(number("start_char"), F.lit(-1)).alias("start"), F.coalesce(number("end_char"), F.lit(-1)).alias("end"), some("line_index").alias("line"),
        span.alias("span_valid"), given("span_source").alias("span_source"), F.coalesce(number("paragraph_index"), F.lit(-1)).alias("paragraph"), some("paragraph_start_char").alias("paragraph_start"), some("paragraph_end_char").alias("paragraph_end"),
        part.alias("paragraph_valid"), given("paragraph_source").alias("paragraph_source"),
    )
    return out.where("error_text <> ''").withColumn("locatable", F.col("span_valid") | F.col("paragraph_valid"))


def filled(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """``entries`` (sample, no, quote, start, end, line, span_valid, span_source, paragraph, paragraph_start, paragraph_end,
    paragraph_valid, paragraph_source, …) with what their locations lack, from ``texts`` (sample, text).

    A quote without a valid span is looked for by the cascade of :func:`location.locate` (span_source: fallback_ and its step);
    a valid span gives its line (from 1) and, where no paragraph is valid, its paragraph and the context around it
    (from_span_context or from_quote_context); else the declared number of a paragraph that the text has gives its bounds
    (model_declared, unless a source is given). locatable follows. Samples without a text keep what they have.
    """
    c = F.col
    own = [x for x in entries.columns if x != "locatable"]
    both = entries.select(*own).join(texts.select("sample", F.coalesce("text", F.lit("")).alias("__text")), "sample", "left")
    lost = ~c("span_valid") & (F.trim(F.coalesce("quote", F.lit(""))) != "") & c("__text").isNotNull()
    found = L.locate(both.where(lost).select(F.struct("*").alias("__own"), "__text", "quote"), "__text", "quote").select("__own.*", "span")
    hit = c("span.start") >= 0
    found = found.withColumns({
        "start": F.when(hit, c("span.start")).otherwise(c("start")), "end": F.when(hit, c("span.end")).otherwise(c("end")), "span_valid": hit, "span_source": F.when(hit, F.concat(F.lit("fallback_"), c("span.how"))).otherwise(c("span_source")), "__found": hit, "line": F.when(hit, -1).otherwise(c("line")),
    }).drop("span")
    df = both.where(~lost).withColumn("__found", F.lit(False)).unionByName(found)
    before = F.expr("substring(__text, 1, start)")
    df = df.withColumn("line", F.when(c("span_valid") & (c("line") <= 0) & (c("start") >= 0) & c("__text").isNotNull(), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(c("line")))
    near_span = F.when(c("span_valid") & ~c("paragraph_valid"), L.context_window(c("__text"), c("start"), c("end")))
    df = cut(df.withColumn("__w", near_span).drop("__text"), "located")  # what follows needs no text
    bounds = cut(L.paragraphs(texts, "sample", "text"), "paragraphs")
    by_span = L.paragraph_of(df.where("span_valid AND NOT paragraph_valid").select("sample", "no", "start"), bounds).select("sample", "no", c("paragraph").alias("__p"))
    by_number = bounds.select(c("sample").alias("__k"), c("paragraph").alias("__n"), c("start").alias("__s"), c("end").alias("__e"))
    df = df.join(by_span, ["sample", "no"], "left")
    near = F.when(~c("paragraph_valid") & c("__p").isNull(), c("paragraph"))
    df = df.join(by_number, (c("sample") == c("__k")) & (near == c("__n")), "left")
    w = c("__w")
    spanned, declared = c("__p").isNotNull(), c("__n").isNotNull()
    out = df.withColumns({
        "paragraph": F.when(spanned, c("__p")).otherwise(c("paragraph")),
        "paragraph_start": F.when(spanned, w["start"]).when(declared, c("__s")).otherwise(c("paragraph_start")), "paragraph_end": F.when(spanned, w["end"]).when(declared, c("__e")).otherwise(c("paragraph_end")),
        "paragraph_source": F.when(spanned, F.when(c("__found"), "from_quote_context").otherwise("from_span_context")).when(declared & (F.coalesce("paragraph_source", F.lit("")) == ""), "model_declared").otherwise(c("paragraph_source")),
        "paragraph_valid": c("paragraph_valid") | spanned | declared,
    })
    return out.select(*own, (c("span_valid") | c("paragraph_valid")).alias("locatable"))
