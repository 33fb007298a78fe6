"""Queries over rollouts, registries, catalog upkeep, hints and reports; each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import location as L
from ..operators import upkeep as U
from ..operators.lineage import cut
from ..operators.roles import RULES_SQL, SAMPLES_SQL, rules, samples, table
from ..sources import rollouts as S
from . import analysis as A
from . import retrieval as R


def _rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as rollouts: each turn a sample whose prompt holds the turn before."""
    t = table(spark, d, "conversations").where("text is not null")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    prompt = F.concat(F.lit("Be brief.\nUser: "), before, F.lit("\nAssistant: ok"))
    meta = F.when(F.col("turn") % 3 == 0, F.create_map(F.lit("stem"), F.concat(F.lit(" about "), "role"))).otherwise(F.create_map(F.lit("title"), F.lit(" ")))
    s = F.struct(F.col("turn").alias("index"), prompt.alias("prompt"), F.col("text").alias("response"), F.array("role").alias("label"), F.create_map(F.lit("acc"), (F.col("turn") % 2).cast("double")).alias("reward"), meta.alias("metadata"))
    rows = t.withColumn("s", s).select("conv_id", F.struct(F.col("turn"), F.to_json("s").alias("j")).alias("s"))
    shape = "struct<index:bigint,prompt:string,response:string,label:array<string>,reward:map<string,double>,metadata:map<string,string>>"
    return rows.groupBy(F.col("conv_id").alias("rollout_id")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.from_json(x["j"], shape)).alias("samples"))


def rollout_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.count_samples(_rollouts(spark, d), n_capped=4)


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.eval_rows(_rollouts(spark, d)).select("id", "rollout_id", "index", F.md5("question").alias("question_md5"), F.length("prediction").alias("n_prediction"), "answer", "acc")


def sample_index(spark: SparkSession, d: str) -> DataFrame:
    return S.indexed(_rollouts(spark, d), "rollout_id", width=16)


def sidecar_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids in a list with comments: lines of titles and numbers."""
    lines = rules(spark, d).select(F.when(F.col("rule_no") % 5 == 0, "# all of it").otherwise(F.concat(F.lit("  "), "topic", F.lit("_"), F.col("rule_no") % 20, F.lit(" # "), "title")).alias("value"))
    return S.id_list(lines)


def _specs(spark: SparkSession, d: str) -> list[DataFrame]:
    r = rules(spark, d)
    nested = r.where("rule_no % 3 = 0").select("rule_id", "topic", F.lit("nested").alias("origin"))
    flat = r.where("rule_no % 2 = 0").select("rule_id", F.lower("topic").alias("topic"), F.lit("flat").alias("origin"))
    return [nested, flat.unionByName(flat)]


def registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    return S.upserted(_specs(spark, d), ["rule_id"])


def pending_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a cut-off run has left: documents without a finished row, failed ones again."""
    work = table(spark, d, "documents").select("doc_id", "lang")
    done = work.where("doc_id % 3 <> 0").select("doc_id", (F.col("doc_id") % 5 == 0).alias("failed"))
    return S.pending(work, done, ["doc_id"], F.col("failed"))


def scale_curve(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by the size of a checkpoint, which is stated or stands in a path."""
    no = F.col("doc_id")
    runs = table(spark, d, "labels").select(F.when(no % 3 == 0, (no % 4 + 1) * 100).cast("string").alias("stated"), F.concat(F.lit("/runs/ckpt_"), (no % 4 + 1) * 200, F.lit("/metrics.json")).alias("path"), "quality", "toxic")
    return runs.withColumn("size", S.checkpoint_size(F.col("stated"), F.col("path"))).groupBy("size").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.max("toxic").alias("toxic"))


def _new_rules(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    made = F.when(F.col("rule_no") % 6 == 0, " ").when(F.col("rule_no") % 6 == 1, F.col("rule_id")).otherwise(F.concat(F.lit("new_"), F.floor(F.col("rule_no") / 12)))
    return r.withColumn("rule_id", made)


def catalog_add(spark: SparkSession, d: str) -> DataFrame:
    updated, left = U.add_rules(rules(spark, d), _new_rules(spark, d))
    added = updated.where("rule_id LIKE 'new_%'").select("rule_no", "rule_id", F.lit("added").alias("outcome"))
    return added.unionByName(left.withColumnRenamed("warning", "outcome"))


def catalog_remove(spark: SparkSession, d: str) -> DataFrame:
    ids = rules(spark, d).where("rule_no % 4 = 0").select(F.concat(F.lit(" "), "rule_id").alias("rule_id")).unionByName(table(spark, d, "region").select(F.lit("exp_none").alias("rule_id")))
    kept, gone = U.remove_rules(rules(spark, d), ids)
    return kept.select("rule_id", F.lit(False).alias("removed")).unionByName(gone.withColumn("removed", F.lit(True)))


def bind_checks(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    m = r.where("rule_no % 3 <> 0").select("rule_id", F.col("rule_no").alias("place"), F.concat(F.lit("check_"), "rule_no").alias("function_name"), F.when(F.col("rule_no") % 2 == 0, "hand").alias("source"))
    again = m.where("place % 5 = 0").withColumns({"place": F.col("place") + 1000, "function_name": F.concat("function_name", F.lit("_b"))})
    return U.bind_checks(r, m.unionByName(again)).select("rule_id", "function_name", "source")


def default_precision(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.split(F.col(c), " ")
    r = rules(spark, d).withColumns({"primitive": F.when(F.col("rule_no") % 2 == 0, "none").when(F.col("rule_no") % 3 == 0, "power_law"), "required_symbols": F.slice(words("trigger"), 1, 4), "trigger_keywords": words("title"), "object_keywords": F.slice(words("trigger"), 6, 3)})
    p = U.default_precision(r)
    return p.select("rule_id", "profile", "policy", *(F.array_join(c, "|").alias(c) for c in ("preconditions", "violation_signatures", "negative_conditions", "evidence_requirements")))


def flat_library(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d).select("rule_id", "title", "support")
    knowledge = r.where("support % 2 = 0").withColumns({"title": T.upper(F.col("title")), "rule_id": F.when(F.col("support") == 2, F.concat(F.lit("k"), "rule_id")).otherwise(F.col("rule_id"))})
    return U.library(r.where("support % 3 <> 1"), knowledge)


def blueprint_validate(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d).select("topic", "rule_no", "rule_id")
    r = r.withColumn("topic_key", F.lower("topic"))
    given = r.where("topic <> 'T3' AND NOT (topic = 'T4' AND rule_no % 24 = 4)").groupBy("topic_key").agg(F.collect_list("rule_id").alias("ids"))
    ids = F.when(F.col("topic_key") == "t5", F.array().cast("array<string>")).when(F.col("topic_key") == "t6", F.concat("ids", F.slice("ids", 1, 1))).when(F.col("topic_key") == "t7", F.concat("ids", F.array(F.lit("exp_x")))).otherwise(F.col("ids"))
    extra = table(spark, d, "region").where("r_regionkey = 0").select(F.lit("t99").alias("topic_key"), F.array(F.lit("exp_1")).alias("rule_ids"))
    blue = given.select("topic_key", ids.alias("rule_ids")).unionByName(extra)
    full, subset = (U.validate_blueprints(r, blue, mode).withColumn("mode", F.lit(mode)) for mode in ("full", "subset"))
    return full.unionByName(subset)


GENERIC = ["the", "and the", "ing"]


def scene_keywords(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    t = r.select(F.col("rule_id"), F.when(F.col("rule_no") % 2 == 0, F.col("topic")).otherwise(F.concat("title", F.lit(" of AB, "), "topic")).alias("name"), F.array(F.concat("title", F.lit("; the")), F.col("trigger"), F.upper("title")).alias("texts"))
    return U.scene_keywords(t, GENERIC, 5).select("rule_id", F.array_join("scenes", "|").alias("scenes"))


def keyword_overrides(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    f = r.select("rule_id", F.split("title", " ").alias("keywords"))
    o = r.where("rule_no % 2 = 0").select("rule_id", F.array(F.upper(F.element_at(F.split("title", " "), 1))).alias("drop"), F.array(F.lit("Lever"), F.lit(" lever ")).alias("prepend"))
    return U.keyword_overrides(f, o).select("rule_id", F.array_join("keywords", "|").alias("keywords"))


def rule_summary(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d).withColumns({"node_summary": F.when(F.col("rule_no") % 4 == 0, F.col("trigger")), "check_logic": F.when(F.col("rule_no") % 4 == 1, " ").otherwise(F.col("check_logic"))})
    return U.rule_summary(r, 60).select("rule_id", "summary", F.md5("embedding_text").alias("embedding_md5"))


def srd_text(spark: SparkSession, d: str) -> DataFrame:
    no = F.col("rule_no")
    r = rules(spark, d).withColumns({"source": F.element_at(F.array(F.lit("experience_tagged"), F.lit("experience"), F.lit("knowledge"), F.lit(None)), (no % 4 + 1).cast("int")), "description": F.concat(F.lit("about "), "title"), "name": F.col("rule_id")})
    r = r.withColumns({"rule_id": F.when(no % 4 != 2, F.col("rule_id")), "trigger": F.when(no % 3 != 0, F.col("trigger"))})
    return U.srd_text(r).select("name", F.md5("srd").alias("srd_md5"))


def inject_rules(spark: SparkSession, d: str) -> DataFrame:
    chosen = cut(R.quota_select(spark, d).select("id", "rule_id", "score"), "chosen")  # itself, and what it lacks
    extra = samples(spark, d).select("id", F.concat(F.lit("exp_"), F.col("id") % 20).alias("rule_id"), F.lit(0.0).alias("score"))
    return U.inject_rules(chosen, extra, ["id", "rule_id"])


def applicable_specs(spark: SparkSession, d: str) -> DataFrame:
    specs = rules(spark, d).select(F.col("rule_id").alias("spec_id"), F.concat(F.split("title", " "), F.array(F.substring("trigger", 1, 24))).alias("keywords"), (F.col("rule_no") % 3).alias("penalty"))
    hay = samples(spark, d).select("id", T.fold(F.coalesce("prediction", F.lit(""))).alias("hay"))
    return U.applicable_specs(hay, specs)


def topic_quality(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d).withColumn("title", F.when(F.col("rule_no") % 5 < 2, "Same, title!").otherwise(F.col("title")))
    r = r.withColumn("required_symbols", T.symbol_set(F.when(F.col("rule_no") % 3 > 0, F.col("title"))))
    return U.topic_quality(r)


def run_report(spark: SparkSession, d: str) -> DataFrame:
    no = F.col("doc_id")
    rows = table(spark, d, "documents").select((no - no % 3).alias("id"), F.concat(F.lit("T"), no % 15).alias("topic"), (no % 7 == 0).alias("failed"))
    return U.run_report(rows, rules(spark, d).select("topic"))


def cluster_coverage(spark: SparkSession, d: str) -> DataFrame:
    return U.cluster_coverage(A.embedding_clusters(spark, d), 0.05)


def quality_errors(spark: SparkSession, d: str) -> DataFrame:
    """Error items from turns: whole texts as errors, every third turn with the quote of another."""
    t = table(spark, d, "conversations")
    items = t.select(F.col("conv_id").alias("sample"), F.col("turn").cast("int").alias("no"), F.when(F.col("turn") % 5 == 4, F.concat(F.lit("It might be "), "text")).otherwise(F.col("text")).alias("error"), F.concat(F.lit("q"), F.col("turn") % 3).alias("quote"), (F.col("turn") % 2).alias("paragraph"))
    return U.quality_errors(items).select("sample", "no")


def eval_pools(spark: SparkSession, d: str) -> DataFrame:
    no = F.col("doc_id")
    w = lambda k: F.lower(F.coalesce(F.element_at(F.split(F.coalesce("text", F.lit("")), " "), k), F.lit("")))
    s = table(spark, d, "documents").select(no.alias("id"), F.array(w(1)).alias("expected"), F.when(no % 3 == 0, F.array(w(1))).when(no % 3 == 1, F.array(F.concat(F.lit("="), w(1)))).otherwise(F.array(F.lit("#"))).alias("predicted"), F.when(no % 2 == 0, (no % 4) / 2.0).alias("acc"))
    return U.eval_pools(s).select("id", "pool")


def ranked_topics(spark: SparkSession, d: str) -> DataFrame:
    return U.ranked_topics(rules(spark, d), 5)


def short_circuit(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).select("id", "prediction", F.array(F.when(F.col("id") % 2 == 0, F.concat(F.lit("\\boxed{"), F.translate(F.substring("prediction", 30, 12), "abcdefgh", "ABCDEFGH"), F.lit("}"))).otherwise("none of it 77")).alias("expected"))
    return U.short_circuit(s).select("id", "answered")


def text_matches(spark: SparkSession, d: str) -> DataFrame:
    """Loose phrases, symbols by any spelling, evaluator words and LaTeX surfaces of every text."""
    s = samples(spark, d).select("id", F.coalesce("prediction", F.lit("")).alias("p"))
    low = F.lower(T.norm_text(F.col("p")))
    latex = F.concat(F.lit("\\mathrm{A}~\\text{b c}\\,"), "p")
    return s.select("id", T.matches_loosely(low, F.lit("the tion erreur whatever then")).alias("loose"), T.has_symbol(F.col("p"), F.lit("Avg")).alias("has_avg"), T.has_symbol(F.col("p"), F.lit("{a}")).alias("has_a"), F.size(L.evaluator_tokens(F.col("p"))).alias("n_words"), F.md5(T.surface(latex)).alias("surface_md5"))


def required_symbols(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d).where("NOT is_meta").groupBy("domain", "topic").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", T.symbols(F.col("trigger")).alias("s")))), lambda x: x["s"])).alias("s"))
    return r.select("domain", "topic", F.array_join(U.ordered_unique(F.col("s")), "|").alias("symbols"))


FUNCTIONS = [rollout_counts, eval_rows, sample_index, sidecar_ids, registry_upsert, pending_rows, scale_curve, catalog_add, catalog_remove, bind_checks, default_precision, flat_library, blueprint_validate, scene_keywords, keyword_overrides, rule_summary, srd_text, inject_rules, applicable_specs, topic_quality, run_report, cluster_coverage, quality_errors, eval_pools, ranked_topics, short_circuit, text_matches, required_symbols]
_R = f"WITH {RULES_SQL}"
_T = "WITH t AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations WHERE text IS NOT NULL)"
_FOLD = "replace(lower({}), 'ß', 'ss')"


def _unique(x: str) -> str:
    """Each folded spelling once, in its first spelling and place."""
    clean = f"list_filter(list_transform({x}, lambda u: trim(regexp_replace(u, '\\s+', ' ', 'g'))), lambda u: u <> '')"
    return f"list_filter({clean}, lambda u, i: list_position(list_transform({clean}, lambda z: {_FOLD.format('z')}), {_FOLD.format('u')}) = i)"


_NOT = "('" + "', '".join([*GENERIC, *T.LOW_SIGNAL]) + "')"
_LONG = f"({_FOLD.format('p')} NOT IN {_NOT} AND NOT regexp_matches(p, '^[A-Z]{{1,2}}$') AND p <> '' AND (contains(p, ' ') OR length(p) >= 4))"
_PARTS = r"list_filter(list_transform(regexp_split_to_array({0}, '(?i)[()/,;:，；]+| and | of | with | - '), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: " + _LONG + ")"
_SYMS = "list_filter(regexp_extract_all({}, '" + r"\\?([a-zA-Z][a-zA-Z0-9_]*)" + "', 1), lambda s: " + A._IS + ")"
SQL = {
    "rollout_counts": f"{_T} SELECT count(DISTINCT conv_id) AS n_rollouts, count(*) AS n_samples, (SELECT sum(least(n, 4))::BIGINT FROM (SELECT count(*) AS n FROM t GROUP BY conv_id)) AS n_capped FROM t",
    "eval_rows": f"""{_T} SELECT conv_id || '_' || turn AS id, conv_id AS rollout_id, turn AS index, md5(CASE WHEN turn % 3 = 0 THEN 'about ' || role ELSE coalesce(nullif(trim(regexp_extract('User: ' || before || chr(10) || 'Assistant: ok', '(?is)User:\\s*(.*?)(\\nAssistant:|<Assistant)', 1)), ''), trim('Be brief.' || chr(10) || 'User: ' || before || chr(10) || 'Assistant: ok')) END) AS question_md5,
        length(text) AS n_prediction, role AS answer, (turn % 2)::DOUBLE AS acc FROM t""".replace("\\\\", "\\"),
    "sample_index": f"{_T} SELECT conv_id AS rollout_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, row_number() OVER (ORDER BY conv_id, turn) - 1 AS global_index FROM t",
    "sidecar_ids": f"{_R} SELECT DISTINCT topic || '_' || (rule_no % 20) AS id FROM rules WHERE rule_no % 5 <> 0",
    "registry_upsert": f"{_R} SELECT rule_id, CASE WHEN rule_no % 3 = 0 THEN topic ELSE lower(topic) END AS topic, CASE WHEN rule_no % 3 = 0 THEN 'nested' ELSE 'flat' END AS origin FROM rules WHERE rule_no % 3 = 0 OR rule_no % 2 = 0",
    "pending_rows": "SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0",
    "scale_curve": "SELECT CASE WHEN doc_id % 3 = 0 THEN (doc_id % 4 + 1) * 100 ELSE (doc_id % 4 + 1) * 200 END AS size, count(*) AS n, round(avg(quality), 6) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1",
    "catalog_add": f"""{_R}, n AS (SELECT rule_no, CASE rule_no % 6 WHEN 0 THEN ' ' WHEN 1 THEN rule_id ELSE 'new_' || (rule_no // 12) END AS rule_id FROM rules), f AS (SELECT *, row_number() OVER (PARTITION BY trim(rule_id) ORDER BY rule_no) AS r FROM n)
        SELECT rule_no, rule_id, CASE WHEN trim(rule_id) = '' THEN 'without rule_id' WHEN r > 1 OR rule_id LIKE 'exp%' THEN 'duplicate rule_id' ELSE 'added' END AS outcome FROM f""",
    "catalog_remove": f"{_R} SELECT rule_id, rule_no % 4 = 0 AS removed FROM rules",
    "bind_checks": f"{_R} SELECT rule_id, CASE WHEN rule_no % 3 <> 0 THEN 'check_' || rule_no || CASE WHEN rule_no % 5 = 0 THEN '_b' ELSE '' END END AS function_name, CASE WHEN rule_no % 3 <> 0 THEN CASE WHEN rule_no % 2 = 0 THEN 'hand' ELSE 'experience_code_manifest' END END AS source FROM rules",
    "default_precision": f"""{_R}, p AS (SELECT *, string_split("trigger", ' ') AS tw, string_split(title, ' ') AS k FROM rules), q AS (SELECT *, array_to_string({_unique("list_concat(tw[1:4][1:3], k[1:2])")}, '|') AS anchors FROM p)
        SELECT rule_id, CASE WHEN is_meta THEN 'balanced' ELSE 'strict' END AS profile, CASE WHEN rule_no % 2 <> 0 AND rule_no % 3 = 0 THEN 'suppress_on_inconclusive' ELSE 'suppress_on_pass' END AS policy, array_to_string({_unique("list_concat(k[1:3], tw[6:8][1:2])")}, '|') AS preconditions,
            anchors AS violation_signatures, '{"|".join(U.NEGATIVE_CONDITIONS)}' AS negative_conditions, anchors AS evidence_requirements FROM q""",
    "flat_library": f"""{_R}, e AS (SELECT rule_id, title, support FROM rules WHERE support % 3 <> 1), k AS (SELECT CASE WHEN support = 2 THEN 'k' || rule_id ELSE rule_id END AS rule_id, upper(title) AS title, support FROM rules WHERE support % 2 = 0)
        SELECT * FROM e UNION ALL SELECT k.* FROM k ANTI JOIN e USING (rule_id)""",
    "blueprint_validate": f"""{_R}, n AS (SELECT lower(topic) AS k, count(*) AS n, count(*) FILTER (rule_no % 24 = 4) AS gone FROM rules GROUP BY 1), m AS (SELECT unnest(['full', 'subset']) AS mode)
        SELECT k AS topic_key, mode, 'missing_topic' AS problem FROM n, m WHERE mode = 'full' AND k = 't3' UNION ALL SELECT 't99', 'subset', 'unknown_topic' UNION ALL SELECT k, mode, 'empty_clusters' FROM n, m WHERE k = 't5' UNION ALL SELECT k, mode, 'duplicate_assignment' FROM n, m WHERE k = 't6'
        UNION ALL SELECT k, mode, 'unknown_rules' FROM n, m WHERE k = 't7' UNION ALL SELECT k, mode, 'uncovered_rules' FROM n, m WHERE k = 't7' OR (k = 't4' AND gone > 0 AND gone < n)""",
    "scene_keywords": f"""{_R}, s AS (SELECT rule_id, CASE WHEN rule_no % 2 = 0 THEN topic ELSE title || ' of AB, ' || topic END AS name, [title || '; the', "trigger", upper(title)] AS texts FROM rules),
        f AS (SELECT rule_id, list_concat(list_filter([name], lambda p: {_FOLD.format("p")} NOT IN {_NOT} AND NOT regexp_matches(p, '^[A-Z]{{1,2}}$') AND p <> ''), {_PARTS.replace("{0}", "name")}, {", ".join(f"list_filter([texts[{i}]], lambda p: {_LONG}), {_PARTS.replace('{0}', f'texts[{i}]')}" for i in (1, 2, 3))}) AS a FROM s)
        SELECT rule_id, array_to_string(({_unique("a")})[1:5], '|') AS scenes FROM f""",
    "keyword_overrides": f"""{_R}, k AS (SELECT rule_id, rule_no % 2 = 0 AS o, string_split(title, ' ') AS k FROM rules), l AS (SELECT rule_id, CASE WHEN o THEN list_concat(['Lever'], list_filter(k, lambda w: {_FOLD.format("w")} <> {_FOLD.format("upper(k[1])")})) ELSE k END AS k FROM k)
        SELECT rule_id, array_to_string({_unique("k")}, '|') AS keywords FROM l""",
    "rule_summary": f"""{_R}, s AS (SELECT *, CASE WHEN rule_no % 4 = 1 THEN '' ELSE check_logic END AS logic FROM rules), u AS (SELECT *, left(CASE WHEN rule_no % 4 = 0 THEN "trigger" WHEN logic <> '' THEN title || ': ' || logic ELSE title || ': ' || "trigger" END, 60) AS summary FROM s)
        SELECT rule_id, summary, md5(concat_ws(chr(10), domain, topic, title, summary, nullif(logic, ''))) AS embedding_md5 FROM u""",
    "srd_text": f"""{_R}, s AS (SELECT rule_id AS name, rule_no % 4 AS k, title, CASE WHEN rule_no % 3 <> 0 THEN "trigger" END AS t, check_logic FROM rules)
        SELECT name, md5(CASE WHEN k = 0 THEN 'about ' || title WHEN k = 2 THEN 'Title: ' || title || chr(10) || 'Description: about ' || title || chr(10) || 'Check Logic: ' || check_logic
            ELSE concat_ws(chr(10), 'Title: ' || title, 'Trigger: ' || t, 'Check Logic: ' || nullif(check_logic, '')) END) AS srd_md5 FROM s""",
    "inject_rules": f"{R._Q}, e AS (SELECT id, 'exp_' || (id % 20) AS rule_id, 0.0::DOUBLE AS score FROM samples) SELECT id, rule_id, score FROM chosen UNION ALL SELECT e.* FROM e ANTI JOIN chosen USING (id, rule_id)",
    "applicable_specs": f"""WITH {SAMPLES_SQL}, {RULES_SQL}, p AS (SELECT rule_id AS spec_id, list_transform(list_concat(string_split(title, ' '), [substr("trigger", 1, 24)]), lambda w: {_FOLD.format("w")}) AS k, rule_no % 3 AS penalty FROM rules),
        h AS (SELECT id, spec_id, penalty, list_filter(k, lambda w: w <> '' AND contains({_FOLD.format("coalesce(prediction, '')")}, w)) AS hit FROM samples, p), c AS (SELECT id, spec_id, len(hit) AS hits, len(list_filter(hit, lambda w: length(w) >= 22)) AS long_hits, penalty FROM h),
        s AS (SELECT id, spec_id, hits, long_hits, hits + 2 * long_hits - penalty AS score FROM c WHERE hits >= 2 OR long_hits >= 1) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, spec_id) AS place FROM s) WHERE place <= 3""",
    "topic_quality": f"""{_R}, q AS (SELECT domain, topic, support, check_logic, CASE WHEN rule_no % 5 < 2 THEN 'Same, title!' ELSE title END AS title, rule_no % 3 > 0 AS own FROM rules), s AS (SELECT *, len({_SYMS.format("title")}) AS n FROM q),
        g AS (SELECT domain, topic, regexp_replace({_FOLD.format("title")}, '[^a-z0-9]+', '', 'g') AS k, count(*) AS n, count(*) FILTER (trim(check_logic) = '') AS l, count(*) FILTER (NOT own OR n = 0) AS s, sum(support) AS u FROM s GROUP BY ALL)
        SELECT domain, topic, sum(n)::BIGINT AS n_rules, sum(l)::BIGINT AS no_logic, sum(s)::BIGINT AS no_symbols, count(*) FILTER (n > 1 AND k <> '') AS near_dup_groups, sum(u)::BIGINT AS n_support FROM g GROUP BY ALL""",
    "run_report": f"{_R}, r AS (SELECT doc_id - doc_id % 3 AS id, doc_id % 7 = 0 AS f, 'T' || (doc_id % 15) NOT IN (SELECT topic FROM rules) AS u FROM documents), g AS (SELECT id, count(*) AS n FROM r GROUP BY id) SELECT count(*) AS n_rows, (SELECT count(*) FROM g) AS n_ids, (SELECT count(*) FROM g WHERE n > 1) AS repeated_ids, count(*) FILTER (f) AS n_failed, count(*) FILTER (u) AS unknown_topic FROM r",
    "cluster_coverage": f"SELECT label, count(*) AS n_rules, count(DISTINCT cluster_id) AS n_clusters, count(cluster_id) AS clustered, round(count(cluster_id) / count(*), 6) AS coverage, count(cluster_id) / count(*) >= 0.05 AND count(cluster_id) > 0 AS ready FROM ({A.SQL['embedding_clusters']}) GROUP BY label",
    "eval_pools": """WITH e AS (SELECT doc_id, lower(coalesce(string_split(coalesce(text, ''), ' ')[1], '')) AS w FROM documents) SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 2 AND w = '#') THEN 'correct'
        WHEN w <> '' AND (doc_id % 3 = 1 OR contains(w, '#')) THEN 'relaxed' WHEN doc_id % 2 <> 0 OR (doc_id % 4) / 2 < 0.999999 THEN 'wrong' ELSE 'none' END AS pool FROM e""",
    "ranked_topics": f"{_R} SELECT domain, topic, count(*) AS n_rules FROM rules GROUP BY ALL ORDER BY n_rules DESC, domain, topic LIMIT 5",
    "short_circuit": rf"""WITH {SAMPLES_SQL}, a AS (SELECT id, lower(regexp_replace(regexp_replace(coalesce(prediction, ''), '\\boxed|\\left|\\right', '', 'g'), '[{{}}$\s]', '', 'g')) AS p, CASE WHEN id % 2 = 0 THEN translate(substr(prediction, 30, 12), 'abcdefgh', 'ABCDEFGH') ELSE 'noneofit77' END AS e FROM samples),
        b AS (SELECT id, p, lower(regexp_replace(regexp_replace(coalesce(e, ''), '\\boxed|\\left|\\right', '', 'g'), '[{{}}$\s]', '', 'g')) AS e FROM a) SELECT id, e <> '' AND contains(p, e) AS answered FROM b""",
    "text_matches": rf"""WITH {SAMPLES_SQL}, s AS (SELECT id, coalesce(prediction, '') AS p FROM samples), l AS (SELECT *, trim(regexp_replace(p, '\s+', ' ', 'g')) AS n, lower(regexp_replace(p, '\\left|\\right|[{{}}$ ]', '', 'g')) AS m FROM s)
        SELECT id, contains(lower(n), 'tion')::INT + contains(lower(n), 'erreur')::INT + contains(lower(n), 'whatever')::INT >= 2 AS loose, contains(m, 'avg') OR contains(m, 'average') OR contains(m, 'mean') OR contains(m, '平均值') AS has_avg,
            regexp_matches(lower(p), '(^|[^a-z0-9_])a([^a-z0-9_]|$)') AS has_a, len(list_distinct(list_filter(regexp_extract_all(lower(p), '[a-z0-9_]+'), lambda t: length(t) >= 3))) AS n_words, md5(trim(regexp_replace(regexp_replace('A b c ' || p, '\\,|~', ' ', 'g'), '\s+', ' ', 'g'))) AS surface_md5 FROM l""",
    "required_symbols": f"""{_R}, s AS (SELECT domain, topic, flatten(list({_SYMS.format('"trigger"')} ORDER BY rule_no)) AS s FROM rules WHERE NOT is_meta GROUP BY ALL) SELECT domain, topic, array_to_string({_unique("s")}, '|') AS symbols FROM s""",
}
