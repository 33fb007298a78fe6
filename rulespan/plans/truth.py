"""Queries over ground truth of mixed age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import truth as G
from ..operators.roles import table


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """(sample, text, json): errors of documents in the shapes of five ages: with spans, with quotes, with numbers of
    paragraphs, older texts alone, and entries without a text or that are none."""
    no = F.col("doc_id")
    docs = table(spark, d, "documents").select(no.alias("sample"), F.coalesce("text", F.lit("")).alias("text"), (no % 37).cast("int").alias("at"))
    quote = F.expr("substring(text, at + 1, 40)")
    spanned = F.struct(F.lit(" wrong sign ").alias("error_text"), F.lit("given").alias("error_id"), F.col("at").alias("start_char"), (F.col("at") + 40).alias("end_char"), F.lit("model").alias("span_source"))
    quoted = F.struct(F.lit("").alias("error_text"), F.lit("no unit").alias("error"), F.translate(quote, "abcdefgh", "ABCDEFGH").alias("quote"), F.lit("x").alias("start_char"))
    numbered = F.struct(F.lit("bad step").alias("error"), (F.col("sample") % 4).alias("paragraph_index"), F.lit("absent words").alias("answer_quote"))
    blank = F.struct(F.lit(" ").alias("error"), F.lit(True).alias("span_valid"))
    new = F.concat(F.lit('{"physics_error_gt":[7,'), F.concat_ws(",", *(F.to_json(x) for x in (spanned, blank, quoted, numbered))), F.lit('],"physics_error_examples":[{"error":"not read"}]}'))
    old = F.concat(F.lit('{"physics_error_gt":null,"physics_error_examples":["no object",{"error":"old one"},{"error":null},{"error":" two "}]}'))
    json = F.when(F.col("sample") % 5 == 0, old).when(F.col("sample") % 5 == 1, '{"physics_error_gt":[],"physics_error_examples":[{"error":"not read"}]}').when(F.col("sample") % 5 == 2, "{").otherwise(new)
    return docs.select("sample", "text", "at", json.alias("json"))


def gt_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every error of every age with the fields that it has and where they were found."""
    return G.gt_entries(_rows(spark, d).select("sample", "json"))


def gt_filled(spark: SparkSession, d: str) -> DataFrame:
    """The same with locations filled from quotes, spans and numbers of paragraphs."""
    rows = _rows(spark, d)
    return G.filled(G.gt_entries(rows.select("sample", "json")), rows.select("sample", "text"))


_NONE = "-1 AS line, {v} AS span_valid, {s} AS span_source, {p} AS paragraph, -1 AS paragraph_start, -1 AS paragraph_end, {p} >= 1 AS paragraph_valid, {o} AS paragraph_source, {v} OR {p} >= 1 AS locatable"
FUNCTIONS = [gt_entries, gt_filled]
SQL = {
    "gt_entries": f"""WITH d AS (SELECT doc_id AS sample, coalesce(text, '') AS text, (doc_id % 37)::INT AS a0 FROM documents),
        n AS (SELECT * FROM d WHERE sample % 5 >= 3), o AS (SELECT * FROM d WHERE sample % 5 = 0)
        SELECT sample, 2 AS no, 'given' AS error_id, 'wrong sign' AS error_text, 'error_text' AS text_from, '' AS quote, NULL AS quote_from, a0 AS "start", a0 + 40 AS "end", {_NONE.format(v="true", s="'model'", p="-1", o="''")} FROM n
        UNION ALL SELECT sample, 4, sample || '_e4', 'no unit', 'error', trim(translate(substr(text, a0 + 1, 40), 'abcdefgh', 'ABCDEFGH'), ' '), CASE WHEN trim(substr(text, a0 + 1, 40), ' ') <> '' THEN 'quote' END, -1 AS "start", -1 AS "end", {_NONE.format(v="false", s="''", p="-1", o="''")} FROM n
        UNION ALL SELECT sample, 5, sample || '_e5', 'bad step', 'error', 'absent words', 'answer_quote', -1 AS "start", -1 AS "end", {_NONE.format(v="false", s="''", p="(sample % 4)::INT", o="''")} FROM n
        UNION ALL SELECT sample, 2, sample || '_legacy_e2', 'old one', 'error', '', NULL, -1 AS "start", -1 AS "end", {_NONE.format(v="false", s="'legacy_no_location'", p="-1", o="'legacy_no_location'")} FROM o
        UNION ALL SELECT sample, 4, sample || '_legacy_e4', 'two', 'error', '', NULL, -1 AS "start", -1 AS "end", {_NONE.format(v="false", s="'legacy_no_location'", p="-1", o="'legacy_no_location'")} FROM o""",
}
