"""Queries over what sets topics apart and over contexts under budgets; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analysis as A
from ..operators import hints as H
from ..operators.roles import RULES_SQL, rules
from . import analysis as P
from . import retrieval as R

#: Words put into rules by their number, so that every class occurs.
_ADDED = ["sin and cos of it", "tan in a circuit", "Binary System 双星", "", "mirage only", "data extraction", "r_p near 近地点"]


def _rules(spark: SparkSession, d: str) -> DataFrame:
    added = F.element_at(F.array(*map(F.lit, _ADDED)), (F.col("rule_no") % len(_ADDED) + 1).cast("int"))
    return rules(spark, d).withColumn("title", F.concat_ws(" ", "title", added))


def retrieval_profile(spark: SparkSession, d: str) -> DataFrame:
    return H.retrieval_profile(_rules(spark, d)).select("rule_id", "generic_math", "narrow", "meta_hint", "scope")


def strong_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The words of triggers, some with signs, digits or in capitals, and whether they are strong symbols."""
    w = F.explode(F.array_distinct(F.slice(F.split("trigger", " "), 1, 6))).alias("w")
    no = F.col("rule_no")
    s = F.when(no % 4 == 0, T.upper(F.col("w"))).when(no % 4 == 1, F.concat(F.substring("w", 1, 1), F.lit("_1"))).when(no % 4 == 2, F.substring("w", 1, 3)).otherwise(F.element_at(F.array(*map(F.lit, [*H.STRONG_SYMBOLS, "q", "V2", "ab"])), (F.length("w") % 11 + 1).cast("int")))
    return rules(spark, d).select("rule_no", w).select(s.alias("symbol")).distinct().select("symbol", H.strong_symbol(F.col("symbol")).alias("strong"))


def refined_scenes(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the rules' check logic as scenes of their topics, with words of settings and actions among them."""
    no = F.col("rule_no")
    said = F.element_at(F.array(*map(F.lit, ["coil in a field", "verify it", "x or y", "orbit", "mass", "spring", "a long way without anything there", "时"])), (no % 8 + 1).cast("int"))
    w = F.split("check_logic", " ")
    scene = F.explode(F.array(said, F.array_join(F.slice(w, 1, 2), " "), F.concat_ws(" ", F.array_join(F.slice(w, 3, 2), " "), said), F.array_join(F.slice(w, 5, 7), " ")))
    return H.refined_scenes(rules(spark, d).select("domain", "topic", scene.alias("scene")))


def contrastive_terms(spark: SparkSession, d: str) -> DataFrame:
    return H.contrastive_terms(rules(spark, d))


def context_summary(spark: SparkSession, d: str) -> DataFrame:
    t = P._formula_texts(spark, d)
    s = H.context_summary(t, A.formulas(t, "key", "text"), "key", "text", symbols=30, formulas=4, budget=300)
    return s.select("key", F.array_join("symbols", " ").alias("symbols"), F.array_join("formulas", " | ").alias("formulas"), F.md5("preview").alias("preview_md5"))


def _any(values: list[str], hay: str) -> list[str]:
    return [f"contains({hay}, '{v}')" for v in values]


def _n(conditions: list[str]) -> str:
    return "(" + " + ".join(f"({c})::INT" for c in conditions) + ")"


_NARROW = " OR ".join(f"{_n(_any(g, 'x'))} >= {min(2, len(g))}" for g in H.NARROW)
_SET = lambda t: "(" + t + " <> '' AND (" + t + " IN (" + ", ".join(f"'{h}'" for h in H.SETTINGS) + ") OR " + " OR ".join(f"contains('{h}', {t}) OR contains({t}, '{h}')" for h in H.SETTINGS if " " not in h) + "))"
_LOW = ", ".join(f"'{w}'" for w in T.LOW_SIGNAL)
_SAID = ", ".join(f"'{w}'" for w in ["coil in a field", "verify it", "x or y", "orbit", "mass", "spring", "a long way without anything there", "时"])
FUNCTIONS = [retrieval_profile, strong_symbols, refined_scenes, contrastive_terms, context_summary]
SQL = {
    "retrieval_profile": f"""WITH {RULES_SQL}, t AS (SELECT rule_id, {R._FOLD.format(f"trim(title || ' ' || [{', '.join(f"'{a}'" for a in _ADDED)}][rule_no % {len(_ADDED)} + 1] || ' ' || " + '"trigger"' + " || ' ' || check_logic)")} AS y FROM rules),
        u AS (SELECT rule_id, trim(regexp_replace(y, '\\s+', ' ', 'g')) AS x FROM t),
        c AS (SELECT rule_id, {_n(_any(H.ALGEBRA, 'x'))} >= 2 AND {_n(_any(H.SETTINGS, 'x'))} = 0 AS generic_math, {_NARROW} AS narrow, {" OR ".join(_any(T.META_HINTS, 'x'))} AS meta_hint FROM u)
        SELECT *, CASE WHEN generic_math OR narrow THEN 'meta' ELSE 'domain' END AS scope FROM c""",
    "strong_symbols": f"""WITH {RULES_SQL}, w AS (SELECT DISTINCT rule_no, unnest(string_split("trigger", ' ')[1:6]) AS w FROM rules),
        s AS (SELECT DISTINCT CASE rule_no % 4 WHEN 0 THEN upper(w) WHEN 1 THEN substr(w, 1, 1) || '_1' WHEN 2 THEN substr(w, 1, 3) ELSE [{', '.join(f"'{x}'" for x in [*H.STRONG_SYMBOLS, 'q', 'V2', 'ab'])}][length(w) % 11 + 1] END AS symbol FROM w)
        SELECT symbol, CASE WHEN symbol = '' THEN false WHEN symbol IN ({', '.join(f"'{x}'" for x in H.STRONG_SYMBOLS)}) THEN true WHEN (regexp_matches(symbol, '^[A-Za-z]{{1,2}}$') AND upper(symbol) NOT IN ('ISS', 'EMF')) OR length(symbol) = 1 THEN false
            ELSE regexp_matches(symbol, '[_/\\\\()^0-9]') OR length(symbol) >= 4 OR (upper(symbol) = symbol AND lower(symbol) <> symbol AND length(symbol) >= 3) END AS strong FROM s""",
    "refined_scenes": f"""WITH {RULES_SQL}, w AS (SELECT domain, topic, string_split(check_logic, ' ') AS w, [{_SAID}][rule_no % 8 + 1] AS said FROM rules),
        s AS (SELECT DISTINCT domain, topic, unnest([said, array_to_string(w[1:2], ' '), array_to_string(w[3:4], ' ') || ' ' || said, array_to_string(w[5:11], ' ')]) AS scene FROM w),
        t AS (SELECT *, {R._FOLD.format("scene")} AS low, trim(scene) AS x, list_transform({R._TOKENS.format("scene")}, lambda token: token) AS toks, list_filter({R._TOKENS.format("scene")}, lambda token: {R._KEEP}) AS kept FROM s),
        c AS (SELECT *, len(kept) AS n, length(x) AS long, len(list_filter(list_transform(toks, lambda q: {R._FOLD.format("q")}), lambda q: {_SET("q")})) AS every, len(list_filter(list_transform(kept, lambda q: {R._FOLD.format("q")}), lambda q: {_SET("q")})) AS ctx, {" OR ".join(_any(H.ACTIONS, "low"))} AS acts FROM t),
        k AS (SELECT * FROM c WHERE NOT ({R._FOLD.format("x")} IN ({_LOW}, {', '.join(f"'{w}'" for w in H.COMMON_SCENES)}) OR n = 0 OR (low LIKE '%时' AND ctx < 2) OR contains(low, ' or ') OR contains(low, ' 或 ') OR (n >= 5 AND ctx < 2) OR (long >= 20 AND ctx = 0)
            OR (acts AND ctx < 2 AND (contains(scene, ' ') OR long >= 10)) OR (acts AND ctx < 3 AND n >= 3) OR (regexp_matches(scene, '[一-鿿]') AND ctx < 2 AND long >= 8)))
        SELECT domain, topic, scene, place FROM (SELECT *, row_number() OVER (PARTITION BY domain, topic ORDER BY least(every, 2) DESC, (n BETWEEN 2 AND 3) DESC, long, low, scene) AS place FROM k) WHERE place <= 16""",
    "contrastive_terms": f"""WITH {RULES_SQL}, s AS (SELECT domain, topic, rule_no, unnest({R._TOKENS.format("concat_ws(' ', title, \"trigger\", check_logic)")}) AS token FROM rules),
        c AS (SELECT domain, topic, {R._FOLD.format("token")} AS term, count(DISTINCT rule_no) AS n FROM s WHERE {R._KEEP} GROUP BY ALL), z AS (SELECT domain, topic, count(*) AS r FROM rules GROUP BY ALL),
        t AS (SELECT term, sum(n) AS total, count(*) AS n_topics FROM c GROUP BY term),
        l AS (SELECT c.domain, c.topic, c.term, n, n_topics, round(((n + 0.5) / (r + 1))::DOUBLE / ((total - n + 0.5) / ((SELECT sum(r) FROM z) - r + 1))::DOUBLE, 6) AS lift FROM c JOIN t USING (term) JOIN z USING (domain, topic))
        SELECT * FROM (SELECT *, CASE WHEN term IN ({_LOW}) OR (n_topics > 1 AND 2 * n_topics >= (SELECT count(*) FROM z)) THEN 'generic' WHEN n_topics = 1 THEN 'narrow' ELSE 'strong' END AS class, row_number() OVER (PARTITION BY domain, topic ORDER BY lift DESC, n DESC, term) AS place FROM l WHERE lift > 1) WHERE place <= 20""",
    "context_summary": f"""{P._F}, sy AS (SELECT key, unnest(q) AS name, generate_subscripts(q, 1) AS i FROM (SELECT key, {R._SYMBOLS.format("text").removeprefix("list_sort(list_distinct(list_transform(").rsplit(", lambda s: lower(s))))", 1)[0]} AS q FROM texts)),
        n0 AS (SELECT key, name, min(i) AS i, name || ':' || count(*) AS item FROM sy GROUP BY key, name), n1 AS (SELECT *, row_number() OVER w AS r, sum(length(item)) OVER w AS u FROM n0 WINDOW w AS (PARTITION BY key ORDER BY i)),
        f1 AS (SELECT key, line, no, raw, row_number() OVER w AS r, sum(length(raw)) OVER w AS u FROM u WINDOW w AS (PARTITION BY key ORDER BY line, no))
        SELECT texts.key, coalesce((SELECT string_agg(item, ' ' ORDER BY i) FROM n1 WHERE n1.key = texts.key AND r <= 30 AND u <= 300), '') AS symbols, coalesce((SELECT string_agg(raw, ' | ' ORDER BY line, no) FROM f1 WHERE f1.key = texts.key AND r <= 4 AND u <= 300), '') AS formulas,
            md5(substr(text, 1, 300)) AS preview_md5 FROM texts""",
}
