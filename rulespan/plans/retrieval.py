"""Queries over samples and rules: text functions, topic and rule scores, gates and quotas; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.roles import RULES_SQL, SAMPLES_SQL, rules, samples


def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("id", F.md5(T.norm_text(F.col("prediction"))).alias("norm_md5"), T.slugify(F.col("context")).alias("slug"), F.md5(T.answer_norm(F.col("question"))).alias("answer_md5"))


def symbol_set(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("id", F.array_join(T.symbol_set(F.col("prediction")), " ").alias("symbols"))


def rule_classes(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    return r.select("rule_id", T.error_type(F.col("check_logic")).alias("error_class"), T.is_negative(F.col("trigger"), F.col("error_type")).alias("negative"), T.is_meta(F.concat_ws(" ", "title", "trigger")).alias("meta"))


def extract_keywords_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.extract_keywords(samples(spark, d), ["id"], F.col("prediction"), 10).select("id", "folded", "keyword", "n", "rank")


def ordered_unique_tokens(spark: SparkSession, d: str) -> DataFrame:
    return R.unique_tokens(samples(spark, d), "id", "prediction")


def signal_df(spark: SparkSession, d: str) -> DataFrame:
    return R.weighted_signals(R.topic_signals(rules(spark, d))).select("domain", "topic", "type", "signal", "df", "w")


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return R.top_topics(R.topic_scores(samples(spark, d), R.topic_signals(rules(spark, d))))


def topic_score(spark: SparkSession, d: str) -> DataFrame:
    return R.topic_scores(samples(spark, d), R.topic_signals(rules(spark, d))).select("id", "domain", "topic", "score")


def topic_topk(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d).select("id", "domain", "topic", "score", "topic_rank")


def _rule_hints(rules: DataFrame) -> DataFrame:
    """Hints of each rule: its title and trigger as phrases, one word as a term, two that speak against it."""
    w = F.split("trigger", " ")
    return rules.select("rule_no", "domain", "topic", F.slice(w, 6, 2).alias("negatives"), F.array("title", "trigger").alias("phrases"), F.slice(w, 2, 1).alias("terms"))


def hinted_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic scores with the hints of a language model, which are the titles of the rules and a word of each."""
    flat = lambda c: F.flatten(F.collect_list(c))
    r = rules(spark, d)
    hints = _rule_hints(r).groupBy("domain", "topic").agg(flat(F.slice("phrases", 1, 1)).alias("phrases"), flat("terms").alias("terms"))
    return R.topic_scores(samples(spark, d), R.topic_signals(r), hints).select("id", "domain", "topic", "score")


def symbol_boost(spark: SparkSession, d: str) -> DataFrame:
    required = rules(spark, d).where("NOT is_meta").groupBy("domain", "topic").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.symbol_set(F.col("trigger")))))).alias("symbols"))
    return R.symbol_boost(topic_score(spark, d), samples(spark, d), required)


def rule_score(spark: SparkSession, d: str) -> DataFrame:
    return R.rule_scores(samples(spark, d), _topics(spark, d), rules(spark, d)).select("id", "topic_rank", "rule_id", "t_hits", "o_hits", "s_hits", "score")


def hinted_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rule scores with words that speak against a rule and with the hints of a language model."""
    r = rules(spark, d)
    return R.rule_scores(samples(spark, d), _topics(spark, d), r, _rule_hints(r)).select("id", "topic_rank", "rule_id", "neg_hits", "llm_hits", "generic_only", "score")


def _context(spark: SparkSession, d: str) -> DataFrame:
    return R.rule_context(R.rule_scores(samples(spark, d), _topics(spark, d), rules(spark, d)))


def rule_context(spark: SparkSession, d: str) -> DataFrame:
    return _context(spark, d).select("id", "rule_id", "gap", "min_score", "adjusted", "margin")


def tuned_context(spark: SparkSession, d: str) -> DataFrame:
    """The context under the deltas of a tuning."""
    scored = R.rule_scores(samples(spark, d), _topics(spark, d), rules(spark, d))
    return R.rule_context(scored, min_delta=0.5, bonus_delta=-0.25).select("id", "rule_id", "generic_only", "anchored", "min_score", "adjusted")


def offline_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules that a report on the matching takes: by adjusted score, without regard to their least score."""
    return R.select_rules(_context(spark, d), offline=True)


def quota_select(spark: SparkSession, d: str) -> DataFrame:
    return R.select_rules(_context(spark, d))


def matching_summary(spark: SparkSession, d: str) -> DataFrame:
    """Selected rules per sample: samples, with a rule, mean, and the 95th percentile as a discrete value."""
    chosen = R.select_rules(_context(spark, d)).groupBy("id").agg(F.count("*").alias("n"))
    n = samples(spark, d).select("id").join(chosen, "id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.count("*").alias("n_samples"), F.count_if(F.col("n") > 0).alias("n_selected"), F.round(F.avg("n"), 6).alias("mean_rules"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").alias("p95_rules"))


def tuning_sweep(spark: SparkSession, d: str) -> DataFrame:
    """How many rules would be published at each threshold and penalty of a grid; one pass over the scored rules."""
    grid = F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(p).alias("penalty")) for t in (4.0, 6.0, 8.0) for p in (0.0, 1.0)))
    rows = _context(spark, d).select("id", "topic_rank", "score", F.explode(grid).alias("g"))
    ok = F.col("score") - F.when(F.col("topic_rank") > 1, F.col("g.penalty")).otherwise(0.0) >= F.col("g.threshold")
    return rows.groupBy(F.col("g.threshold").alias("threshold"), F.col("g.penalty").alias("penalty")).agg(F.count_if(ok).alias("n_published"), F.count_distinct(F.when(ok, F.col("id"))).alias("n_samples"))


_FOLD = "replace(lower({}), 'ß', 'ss')"
_KEEP = "NOT regexp_matches(token, '^[0-9]+$') AND NOT regexp_matches(token, '^[!-~]$') AND lower(token) NOT IN (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
_TOKENS = f"regexp_extract_all({{}}, '{T.TOKEN}')"


def _keywords_sql(source: str, key: str, text: str, most: int) -> str:
    return f"""SELECT {key}, folded, keyword, n, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, first, folded) AS rank FROM (
            SELECT {key}, {_FOLD.format("token")} AS folded, count(*) AS n, min(pos) AS first, arg_min(token, pos) AS keyword FROM (
                SELECT {key}, unnest({_TOKENS.format(text)}) AS token, generate_subscripts({_TOKENS.format(text)}, 1) AS pos FROM {source}) WHERE {_KEEP} GROUP BY ALL)
    ) WHERE rank <= {most}"""


_SYMBOLS = r"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({}, '\\?([a-zA-Z][a-zA-Z0-9_]*)', 1), lambda s: length(s) <= 20 AND lower(s) NOT IN (" + ", ".join(f"'{x}'" for x in T.NOT_SYMBOLS) + ") AND NOT (length(s) >= 4 AND NOT regexp_matches(s, '[^a-z]'))), lambda s: lower(s))))"
_MATCH = "(length({n}) > 0 AND CASE WHEN regexp_matches({n}, '^[a-z]$') THEN regexp_matches({h}, '(^|[^a-z0-9_])' || {n} || '([^a-z0-9_]|$)') ELSE contains({h}, {n}) END)"
_SIGNALS = f"""words_of AS (SELECT domain, topic, string_agg(trim(title || ' ' || "trigger"), ' ' ORDER BY rule_no) AS t, string_agg(check_logic, ' ' ORDER BY rule_no) AS c FROM rules GROUP BY ALL),
kw AS ({_keywords_sql("words_of", "domain, topic", "t", 8)}), sc AS ({_keywords_sql("words_of", "domain, topic", "c", 4)}),
signals AS (
    SELECT domain, topic, 'keyword' AS type, folded AS signal FROM kw UNION SELECT domain, topic, 'scene', folded FROM sc
    UNION SELECT domain, topic, 'symbol', s FROM (SELECT domain, topic, unnest({_SYMBOLS.format("t")}) AS s FROM words_of) WHERE length(s) <= 2
    UNION SELECT domain, topic, 'alias', folded FROM kw WHERE rank = 1 UNION SELECT domain, topic, 'alias', lower(topic) FROM words_of),
dfs AS (SELECT type, signal, count(*) AS df FROM (SELECT DISTINCT type, signal, domain, topic FROM signals) GROUP BY ALL),
weighted AS (SELECT domain, topic, type, signal, df, CASE
        WHEN type = 'scene' THEN CASE WHEN df <= 1 THEN 3.5 WHEN df <= 3 THEN 0.75 * 3.5 WHEN df <= 8 THEN (3.5 + 0.75) / 2 ELSE 0.75 END
        WHEN type = 'keyword' THEN CASE WHEN df <= 1 THEN 2.0 WHEN df <= 3 THEN 1.5 WHEN df <= 8 THEN (2.0 + 0.35) / 2 ELSE 0.35 END
        WHEN type = 'symbol' THEN CASE WHEN length(signal) = 1 AND df > 6 THEN 0 WHEN df <= 2 THEN 1 WHEN df <= 6 THEN 0.5 ELSE 0.25 END ELSE 6 END::DOUBLE AS w
    FROM signals JOIN dfs USING (type, signal)
    WHERE NOT (type = 'keyword' AND (regexp_matches(signal, '^[a-z]{{1,2}}$') OR signal IN ({", ".join(f"'{w}'" for w in T.LOW_SIGNAL)}) OR (df > 18 AND length(signal) <= 8))))"""
_SURFACE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(raw, '\s+', ' ', 'g')), '\\mathrm\{{([^}}]*)\}}', '\1', 'gi'), '\\text\{{([^}}]*)\}}', '\1', 'gi'), '\\,|~', ' ', 'g'), '\s+', ' ', 'g'))".replace("{{", "{").replace("}}", "}")
_HAY = f"""hay AS (SELECT id, {_FOLD.format('concat_ws(chr(10), nullif(question, ' + chr(39) * 2 + '), nullif(context, ' + chr(39) * 2 + '), substr(prediction, 1, 4000))')} AS hay FROM samples),
raw AS (SELECT id, concat_ws(chr(10), nullif(question, ''), nullif(context, ''), nullif(prediction, '')) AS raw FROM samples),
whole AS (SELECT id, {_FOLD.format(f"CASE WHEN contains(raw, chr(92)) OR contains(raw, '~') THEN raw || chr(10) || {_SURFACE} ELSE raw END")} AS hay FROM raw)"""
_SCORES = f"""hits AS (SELECT id, domain, topic, type, w FROM hay JOIN weighted ON {_MATCH.format(n="signal", h="hay")}),
sums AS (SELECT id, domain, topic, count(*) FILTER (type = 'alias') AS a, count(*) FILTER (type = 'scene') AS sn, count(*) FILTER (type = 'keyword') AS kn,
    coalesce(sum(w) FILTER (type = 'scene'), 0) AS sw, coalesce(sum(w) FILTER (type = 'keyword'), 0) AS kws, coalesce(sum(w) FILTER (type = 'symbol'), 0) AS yw FROM hits GROUP BY ALL),
scores AS (SELECT samples.id, t.domain, t.topic, round(CASE WHEN a > 0 THEN 6 ELSE 0 END + least(coalesce(sw, 0), 12) + least(coalesce(kws, 0), 8) + CASE WHEN a > 0 OR sn > 0 OR kn >= 2 THEN least(coalesce(yw, 0), 3) ELSE 0 END, 6)::DOUBLE AS score, coalesce(a, 0) + coalesce(sn, 0) > 0 AS anchored
    FROM samples CROSS JOIN (SELECT DISTINCT domain, topic FROM weighted) t LEFT JOIN sums ON sums.id = samples.id AND sums.domain = t.domain AND sums.topic = t.topic),
topics AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain, topic) AS topic_rank FROM scores) WHERE topic_rank <= 3)"""
_LOOSE = f"list_transform(list_filter(regexp_extract_all({{p}}, '{T.TOKEN}'), lambda token: {_KEEP} AND length(token) >= 4), lambda token: {_FOLD.format('token')})"
_HOLDS = "(len({w}) > 0 AND len(list_filter({w}, lambda t: contains({h}, t))) >= greatest(2, floor(len({w}) * 0.45 + 0.5)))"
_NO_HINTS = "hints AS (SELECT rule_no, []::VARCHAR[] AS negatives, []::VARCHAR[] AS phrases, []::VARCHAR[] AS terms FROM rules)"
_HINTS = """hints AS (SELECT rule_no, domain, topic, string_split("trigger", ' ')[6:7] AS negatives, [title, "trigger"] AS phrases, string_split("trigger", ' ')[2:2] AS terms FROM rules)"""


def _folded(words: str) -> str:
    return f"list_distinct(list_transform({words}, lambda x: {_FOLD.format('x')}))"


def _found(words: str) -> str:
    return f"list_filter({words}, lambda n: {_MATCH.format(n='n', h='hay')})"


def _loosely(phrases: str) -> str:
    """How many of a list of phrases stand loosely in hay."""
    return f"len(list_filter(list_distinct(list_transform({phrases}, lambda p: {_LOOSE.format(p='p')})), lambda w: {_HOLDS.format(w='w', h='hay')}))"


_GENERIC = f"regexp_matches(n, '{'|'.join(T.GENERIC_SIGNALS)}')"
_RULES = f"""ft AS (SELECT rule_no, list(folded) AS t FROM ({_keywords_sql("rules", "rule_no", '"trigger"', 6)}) GROUP BY rule_no),
fo AS (SELECT rule_no, list(folded) AS o FROM ({_keywords_sql("rules", "rule_no", "check_logic", 4)}) GROUP BY rule_no),
feats AS (SELECT rules.*, negatives, phrases, terms, coalesce(t, []) AS t, coalesce(o, []) AS o, {_SYMBOLS.format("title")} AS s FROM rules JOIN hints USING (rule_no) LEFT JOIN ft USING (rule_no) LEFT JOIN fo USING (rule_no)),
hit AS (SELECT topics.id, topic_rank, topics.score AS topic_score, topics.domain, topics.topic, anchored, rule_id, is_meta, support, {_found("t")} AS th, {_found("o")} AS oh, {_found("s")} AS sh,
    len({_found(_folded("negatives"))}) AS neg_hits, len({_found(_folded("terms"))}) AS n_terms, {_loosely("phrases")} AS n_phrases
    FROM topics JOIN feats USING (domain, topic) JOIN whole USING (id)),
counted AS (SELECT *, len(th) AS t_hits, len(oh) AS o_hits, len(sh) AS s_hits, n_terms + n_phrases AS llm_hits, len(th) + len(oh) + len(sh) > 0 AND len(list_filter(th || oh, lambda n: NOT {_GENERIC})) = 0 AS generic_only FROM hit),
sums_of AS (SELECT *, least(3 * t_hits, 9) + least(2 * o_hits, 6) + least(2 * s_hits, 4)
    + CASE WHEN support > 0 AND (t_hits > 0 OR s_hits > 0 OR (t_hits + o_hits + s_hits >= 2 AND o_hits > 0)) THEN least(log2(support + 1), 3) ELSE 0 END
    + (least(n_phrases * 2.5, 7.5) + least(n_terms, 4)) * CASE WHEN t_hits + o_hits + s_hits = 0 THEN 0.35 ELSE 1 END AS total FROM counted),
raws AS (SELECT *, greatest(total - least(neg_hits * 2, 8), 0) AS raw FROM sums_of),
scored AS (SELECT *, round(CASE WHEN NOT is_meta THEN raw WHEN t_hits = 0 AND o_hits = 0 THEN greatest(greatest(raw - 1.5, 0) - 0.5, 0) ELSE greatest(raw - 1.5, 0) END, 6)::DOUBLE AS score FROM raws),
tops AS (SELECT *, max(topic_score) FILTER (topic_rank = 1) OVER (PARTITION BY id) AS top1, coalesce(max(topic_score) FILTER (topic_rank = 2) OVER (PARTITION BY id), 0) AS top2 FROM scored),
gaps AS (SELECT *, greatest(0, top1 - topic_score) AS g, generic_only::INT AS gen, (generic_only AND NOT anchored)::INT AS adrift FROM tops),
context AS (SELECT *, round(g, 6)::DOUBLE AS gap, round(top1 - top2, 6)::DOUBLE AS margin,
    (CASE WHEN topic_rank = 1 THEN 1 WHEN g <= 0.5 THEN 4 WHEN g <= 1.5 THEN 6 WHEN g <= 3 THEN 7 ELSE 8 END + CASE WHEN is_meta THEN 0.5 ELSE 0 END + gen + 2 * adrift)::DOUBLE AS min_score,
    round(score + CASE WHEN topic_rank = 1 THEN 1.5 WHEN g <= 0.5 THEN 0 WHEN g <= 1.5 THEN -0.75 WHEN g <= 3 THEN -1.75 ELSE -2.5 END - CASE WHEN is_meta THEN 0.75 ELSE 0 END - gen - 1.5 * adrift, 6)::DOUBLE AS adjusted FROM gaps)"""
_T = f"WITH {RULES_SQL}, {_SIGNALS}"
_S = f"WITH {SAMPLES_SQL}, {RULES_SQL}, {_SIGNALS}, {_HAY}, {_SCORES}"
_C = f"{_S}, {_NO_HINTS}, {_RULES}"


def _chosen(where: str, by: str) -> str:
    return f"""{_C},
ok AS (SELECT *, topic_rank = 1 AS is_first FROM context WHERE {where}),
sides AS (SELECT *, sum(is_first::INT) OVER (PARTITION BY id) AS n_first, row_number() OVER (PARTITION BY id, is_first ORDER BY is_meta::INT, {by} DESC, domain, topic, rule_id) AS r_side,
    least(CASE WHEN margin > 1.5 THEN 1 WHEN margin > 0.5 THEN 2 ELSE 6 END, 6) AS quota FROM ok),
kept AS (SELECT * FROM sides WHERE CASE WHEN margin >= 3 THEN is_first OR (n_first = 0 AND r_side <= 2) ELSE is_first OR n_first < greatest(6 - quota, 0) OR r_side <= quota END),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY is_meta::INT, {by} DESC, domain, topic, rule_id) AS place FROM kept) WHERE place <= 6)"""


_Q = _chosen("score > 0 AND score >= min_score AND adjusted > 0", "score")
_ERROR = "CASE " + " ".join(f"WHEN regexp_matches(coalesce({{}}, ''), '(?i){p}') THEN '{name}'" for name, p in T.ERROR_TYPES) + " ELSE 'logic' END"

FUNCTIONS = [norm_text, symbol_set, rule_classes, extract_keywords_topk, ordered_unique_tokens, signal_df, topic_score, topic_topk, symbol_boost, hinted_topics, rule_score, hinted_rules, rule_context, tuned_context, quota_select, offline_rules, matching_summary, tuning_sweep]
SQL = {
    "norm_text": rf"""WITH {SAMPLES_SQL} SELECT id, md5(trim(regexp_replace(prediction, '\s+', ' ', 'g'))) AS norm_md5,
        regexp_replace(regexp_replace(lower(trim(regexp_replace(context, '\s+', ' ', 'g'))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
        md5(lower(regexp_replace(regexp_replace(question, '\\boxed|\\left|\\right', '', 'g'), '[{{}}$\s]', '', 'g'))) AS answer_md5 FROM samples""",
    "symbol_set": f"WITH {SAMPLES_SQL} SELECT id, array_to_string({_SYMBOLS.format('prediction')}, ' ') AS symbols FROM samples",
    "rule_classes": f"""WITH {RULES_SQL}, t AS (SELECT *, trim(regexp_replace("trigger", '\\s+', ' ', 'g')) AS x, lower(concat_ws(' ', title, "trigger")) AS low FROM rules)
        SELECT rule_id, {_ERROR.format(*["check_logic"] * len(T.ERROR_TYPES))} AS error_class, lower(error_type) = 'info' OR x = '' OR regexp_matches(x, '(?i){"|".join(T.NEGATIVE)}') AS negative,
        {" OR ".join(f"contains(low, '{h}')" for h in T.META_HINTS)} AS meta FROM t""",
    "extract_keywords_topk": f"WITH {SAMPLES_SQL} {_keywords_sql('samples', 'id', 'prediction', 10)}",
    "ordered_unique_tokens": f"""WITH {SAMPLES_SQL}, s AS (SELECT id, unnest({_TOKENS.format("prediction")}) AS token, generate_subscripts({_TOKENS.format("prediction")}, 1) AS pos FROM samples),
        f AS (SELECT id, {_FOLD.format("token")} AS k, arg_min(token, pos) AS token, min(pos) AS pos FROM s GROUP BY ALL) SELECT id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM f GROUP BY id""",
    "signal_df": f"{_T} SELECT domain, topic, type, signal, df, w FROM weighted",
    "topic_score": f"{_S} SELECT id, domain, topic, score FROM scores",
    "topic_topk": f"{_S} SELECT id, domain, topic, score, topic_rank FROM topics",
    "symbol_boost": f"""{_S}, req AS (SELECT domain, topic, list_distinct(flatten(list({_SYMBOLS.format('"trigger"')}))) AS symbols FROM rules WHERE NOT is_meta GROUP BY ALL),
        o AS (SELECT scores.*, coalesce(len(list_intersect({_SYMBOLS.format("prediction")}, symbols)), 0) AS overlap FROM scores JOIN samples USING (id) LEFT JOIN req USING (domain, topic))
        SELECT id, domain, topic, overlap::INT AS overlap, round(score + least(2.2, overlap * 0.45), 6)::DOUBLE AS score FROM o""",
    "rule_score": f"{_C} SELECT id, topic_rank, rule_id, t_hits, o_hits, s_hits, score FROM context",
    "hinted_topics": f"""{_S}, {_HINTS}, h AS (SELECT domain, topic, list(title) AS phrases, list(term) AS terms FROM (SELECT domain, topic, phrases[1] AS title, terms[1] AS term FROM hints) GROUP BY ALL),
        hinted AS (SELECT id, domain, topic, least({_loosely("phrases")} * 3, 6) + least(len({_found(_folded("list_filter(terms, lambda x: x IS NOT NULL)"))}) * 0.8, 5) AS hint FROM hay CROSS JOIN h)
        SELECT id, domain, topic, round(score + coalesce(hint, 0), 6)::DOUBLE AS score FROM scores LEFT JOIN hinted USING (id, domain, topic)""",
    "hinted_rules": f"{_S}, {_HINTS}, {_RULES} SELECT id, topic_rank, rule_id, neg_hits, llm_hits, generic_only, score FROM context",
    "tuned_context": f"{_C} SELECT id, rule_id, generic_only, anchored, min_score + 0.5 AS min_score, round(adjusted - 0.25, 6) AS adjusted FROM context",
    "offline_rules": f"{_chosen('score > 0', 'adjusted')} SELECT id, place, topic_rank, rule_id, score, adjusted FROM chosen",
    "rule_context": f"{_C} SELECT id, rule_id, gap, min_score, adjusted, margin FROM context",
    "quota_select": f"{_Q} SELECT id, place, topic_rank, rule_id, score, adjusted FROM chosen",
    "matching_summary": f"""{_Q}, n AS (SELECT samples.id, count(chosen.id) AS n FROM samples LEFT JOIN chosen ON chosen.id = samples.id GROUP BY samples.id)
        SELECT count(*) AS n_samples, count(*) FILTER (n > 0) AS n_selected, round(avg(n), 6) AS mean_rules, quantile_disc(n, 0.95) AS p95_rules FROM n""",
    "tuning_sweep": f"""{_C}, g AS (SELECT t.threshold::DOUBLE AS threshold, p.penalty::DOUBLE AS penalty FROM (VALUES (4), (6), (8)) t(threshold), (VALUES (0), (1)) p(penalty)),
        j AS (SELECT id, threshold, penalty, score - CASE WHEN topic_rank > 1 THEN penalty ELSE 0 END >= threshold AS ok FROM context, g)
        SELECT threshold, penalty, count(*) FILTER (ok) AS n_published, count(DISTINCT id) FILTER (ok) AS n_samples FROM j GROUP BY ALL""",
}
