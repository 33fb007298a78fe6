"""Queries over plugins and stand-in checks; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import plugins as U
from ..operators.roles import RULES_SQL, SAMPLES_SQL, rules, samples
from . import analysis as P


def _graph(s: DataFrame) -> DataFrame:
    f = A.formulas(s, "id", "text")
    return A.graph_findings(f, A.symbol_table(s, "id", "text", f), "id")


def _first_words(sample: dict) -> list[dict]:
    words = sample["text"].split(" ")
    if not words[0]:
        raise ValueError("no first word")
    return [{"severity": "error", "message": "repeated", "quote": words[0]}] if words[0] in words[1:9] else []


def plugin_findings(spark: SparkSession, d: str) -> DataFrame:
    """A column, a check in Python and the symbol graph over the same texts."""
    s = P._formula_texts(spark, d).withColumnRenamed("key", "id")
    long = F.array(F.struct(F.lit("warning").alias("severity"), F.lit("long").alias("message"), F.substring("text", 1, 10).alias("quote")))
    own = U.Registry(U.Plugin("long_text", column=lambda: F.when(F.length("text") > 2000, long)), U.Plugin("first_word", check=_first_words), U.graph_consistency(_graph))
    return own.run(s).select("id", "rule", "severity", "message", "quote", "failed")


def fallback_checks(spark: SparkSession, d: str) -> DataFrame:
    """The stand-in check of every rule on the samples whose id shares its number by 40."""
    s, r = samples(spark, d), rules(spark, d)
    pairs = s.select("id", (F.col("id") % 40).alias("k")).join(r.select("rule_id", (F.col("rule_no") % 40).alias("k")), "k")
    return U.fallback_checks(s, r, pairs)


FUNCTIONS = [plugin_findings, fallback_checks]
SQL = {
    "plugin_findings": f"""{P._G}, g AS ({P.SQL["symbol_graph"].removeprefix(P._G)}), fw AS (SELECT key, string_split(text, ' ') AS w FROM texts)
        SELECT key AS id, 'graph_consistency' AS rule, 'warning' AS severity, finding || ' of ' || symbol || ': ' || n AS message, symbol AS quote, false AS failed FROM g
        UNION ALL SELECT key, 'long_text', 'warning', 'long', substr(text, 1, 10), false FROM texts WHERE length(text) > 2000
        UNION ALL SELECT key, 'first_word', 'error', 'repeated', w[1], false FROM fw WHERE w[1] <> '' AND list_contains(w[2:9], w[1])
        UNION ALL SELECT key, 'first_word', 'info', 'ValueError', '', true FROM fw WHERE w[1] = ''""",
    "fallback_checks": f"""WITH {SAMPLES_SQL}, {RULES_SQL}, k AS (SELECT rule_no, rule_id, list_filter(regexp_split_to_array(lower(trim(title || ' ' || "trigger" || ' ' || check_logic)), '\\s+'), lambda w: length(w) >= 3)[1:6] AS keys FROM rules),
        h AS (SELECT id, lower(concat_ws(' ', question, prediction, context)) AS hay FROM samples), f AS (SELECT id, rule_id, list_filter(keys, lambda x: contains(hay, x))[1] AS evidence FROM h JOIN k ON id % 40 = rule_no % 40)
        SELECT id, rule_id, CASE WHEN evidence IS NULL THEN 'inconclusive' ELSE 'fail' END AS result, evidence FROM f""",
}
