"""Queries over parsed answers, judged topics, bridged checks and the making of a catalog; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import catalog as C
from ..operators.lineage import cut
from ..operators.roles import RULES_SQL, rules, table
from . import retrieval as R


def json_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects of answers that are whole, fenced, embedded, arrays, cut off, or none."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    item = F.format_string('{"no": %d, "lang": "%s"}', "doc_id", "lang")
    forms = ["%s", "Here:\n```json\n%s\n```\nDone.", "so %s it is", "[%s]"]
    text = F.when(F.col("doc_id") % 6 == 4, F.concat(F.lit('{"items": ['), F.substring_index(item, '"', 5), F.lit('"d\\'))).when(F.col("doc_id") % 6 == 5, "none {at all")
    for i, form in enumerate(forms):
        text = text.when(F.col("doc_id") % 6 == i, F.format_string(form, item))
    found = docs.withColumn("o", P.json_object(text, "items", repair=True))
    value = lambda name: F.coalesce(F.get_json_object("o", f"$.{name}"), F.get_json_object("o", f"$.items[0].{name}"))
    return found.select("doc_id", value("no").alias("no"), value("lang").alias("lang"))


def scraped_errors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    whole = F.format_string('x {"error": "bad  %d", "quote": "q\\"%d", "paragraph_index": %d} y {"error": " "} {"quote": "z"}', "doc_id", "doc_id", F.col("doc_id") % 4)
    text = F.when(F.col("doc_id") % 3 == 0, F.format_string('"error": "only %d" tail', "doc_id")).when(F.col("doc_id") % 3 == 1, F.regexp_replace(whole, ', "paragraph_index": .', "")).otherwise(whole)
    return docs.select("doc_id", F.inline(P.scraped_errors(text)))


def normal_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string('{"diagnostics": [{"severity": "ERROR", "message": "m%d", "evidence": {"quote": " q "}}, {"severity": "odd", "detail": "d"}, {"severity": "info"}]}', "doc_id")
    joined = lambda items, name: F.array_join(F.transform(items, lambda i: i[name]), ",")
    kept = F.when(F.col("doc_id") % 4 == 0, "nothing").otherwise(text)
    every, stated = P.clamped_diagnostics(kept), P.stated_diagnostics(kept)
    return table(spark, d, "documents").select("doc_id", joined(every, "severity").alias("severities"), joined(every, "message").alias("messages"), joined(stated, "quote").alias("quotes"), F.size(stated).alias("n_stated"))


def classify_topics(spark: SparkSession, d: str) -> DataFrame:
    topics = rules(spark, d).groupBy("domain", "topic").agg(F.min("rule_no").alias("place"))
    topics = topics.unionByName(topics.select(F.lit("DX").alias("domain"), "topic", (F.col("place") + 1000).alias("place")))
    no = F.col("doc_id")
    answers = table(spark, d, "documents").select(no.alias("id"), F.when(no % 3 == 1, "DX").when(no % 3 == 2, "D1").alias("domain"), F.concat(F.lit("T"), no % 15).alias("topic"))
    return C.classify_topics(answers, topics)


def navigate_tree(spark: SparkSession, d: str) -> DataFrame:
    c = cut(R._context(spark, d).select("id", "domain", "topic", F.concat(F.lit("c"), F.substring("rule_id", -1, 1)).alias("cluster_id"), "rule_id", "score"), "context")  # for all levels
    catalog = rules(spark, d).where("rule_no % 5 <> 0").select("domain", "topic", F.concat(F.lit("c"), F.substring("rule_id", -1, 1)).alias("cluster_id"), "rule_id")
    judged = lambda relevant, score: c.withColumns({"relevant": F.expr(relevant), "score": F.expr(score)})
    levels = [judged("domain <> 'D1'", "(id % 7) / 4D"), judged("(id + length(topic)) % 4 <> 0", "score / 10 - 0.1D"), judged("cluster_id <> 'c3'", "score / 20"), judged("true", "score / 8")]
    return C.navigate_tree(catalog, levels).withColumn("score", F.round("score", 6))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """(sample, k, j): three rule numbers of one topic for every document."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("sample"), "text", F.explode(F.array(*map(F.lit, range(3)))).alias("j")).withColumn("k", F.col("sample") % 12 + 12 * F.col("j"))


def topic_bridge(spark: SparkSession, d: str) -> DataFrame:
    r, n = rules(spark, d), _numbered(spark, d)
    checks = r.where("rule_no % 5 <> 0").select("rule_id", "domain", "topic", F.col("rule_no").alias("place"))
    name = F.concat(F.lit("exp_"), "k").alias("rule_id")
    results = n.select("sample", name, F.element_at(F.array(*map(F.lit, ["pass", "fail", "inconclusive"])), ((F.col("sample") + F.col("k")) % 3 + 1).cast("int")).alias("result"))
    return C.topic_bridge(n.select("sample", F.col("j").alias("pos"), name), r, checks, results, 2)


def bottom_up(spark: SparkSession, d: str) -> DataFrame:
    r, n = rules(spark, d), _numbered(spark, d)
    docs, no = table(spark, d, "documents"), F.col("doc_id")
    name = F.concat(F.lit("exp_"), "k").alias("rule_id")
    topics = docs.select(no.alias("sample"), F.concat(F.lit("D"), no % 6).alias("domain"), F.concat(F.lit("T"), no % 12).alias("topic"))
    evidence = F.when(F.col("j") == 0, F.concat(F.translate(F.substring("text", 21, 10), "abcdefgh", "ABCDEFGH"), F.lit(": seen"))).otherwise("nowhere to be seen")
    results = n.select("sample", name, F.when((F.col("sample") + F.col("j")) % 3 == 0, "pass").otherwise("fail").alias("result"), evidence.alias("evidence"), F.lit("no").alias("message"))
    covered = n.where("k % 7 = 0").select("sample", name)
    keywords = r.select("rule_id", F.split("title", " ").alias("keywords"))
    checks = r.select("rule_id", "domain", "topic", F.col("rule_no").alias("place"))
    return C.bottom_up(docs.select(no.alias("sample"), F.coalesce("text", F.lit("")).alias("text")), topics, checks, results, covered, keywords, 2)


def assign_clusters(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    claim = lambda place, label, which: r.where(which).groupBy("domain", "topic").agg(F.collect_list("rule_id").alias("rule_ids")).select("domain", "topic", F.lit(place).alias("place"), F.lit(label).alias("label"), "rule_ids")
    claims = claim(0, "First, One!", "rule_no % 5 = 0").unionByName(claim(1, " ", "true")).unionByName(claim(2, "Second", "rule_no % 5 <= 1"))
    return C.assign_clusters(r, claims).select("rule_id", "cluster_id")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    key = ["domain", "topic"]
    clusters = rules(spark, d).where("rule_no % 3 <> 0").withColumn("source_id", F.concat(F.lit("emb_"), "error_type")).groupBy(*key, "source_id").agg(F.min("rule_no").alias("place"), F.sort_array(F.collect_list("rule_id")).alias("rule_ids"))
    labels = clusters.where("source_id = 'emb_units'").select(*key, "source_id", F.lit("Unit Checks!").alias("cluster_id"), F.lit(" Units ").alias("name"), F.lit("").alias("summary"))
    return C.label_clusters(clusters, labels)


def label_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).withColumn("rule_ids", F.array_join("rule_ids", ","))


def _blueprints(spark: SparkSession, d: str) -> DataFrame:
    return C.blueprints(rules(spark, d), _labelled(spark, d), 2)


def catalog_blueprints(spark: SparkSession, d: str) -> DataFrame:
    return _blueprints(spark, d).withColumn("rule_ids", F.array_join("rule_ids", ","))


def catalog_navigation(spark: SparkSession, d: str) -> DataFrame:
    placed = _blueprints(spark, d).select("cluster_id", "group_id", F.explode("rule_ids").alias("rule_id"))
    shown = lambda c: F.concat(c["cluster_id"], F.lit(":"), F.array_join(F.transform(F.flatten(F.transform(c["groups"], lambda g: g["rules"])), lambda r: r["rule_id"]), ","))
    return C.navigation(rules(spark, d).join(placed, "rule_id")).select("domain", "topic", "n_rules", F.array_join(F.transform("clusters", shown), ";").alias("clusters"))


def catalog_build(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    again = r.where("rule_no % 4 = 0").withColumns({"rule_no": F.col("rule_no") + 1000, "rule_id": F.concat("rule_id", F.lit("b")), "title": F.upper("title")})
    skeleton = r.where("topic <> 'T5'").select(F.lower("domain").alias("domain"), "topic").distinct()
    return C.build_catalog(skeleton, r.unionByName(again)).select("rule_id", "domain", "topic", "support", "n_merged", "orphan")


def catalog_quality(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d).select("domain", "topic", F.substring("title", 1, 14).alias("summary"), "trigger", "check_logic", (F.col("rule_no") % 4 == 1).alias("clustered"))
    no = F.col("doc_id")
    runtime = table(spark, d, "documents").select(no.alias("sample"), (no % 4).alias("n_topics"), (no % 5).alias("n_clusters"), (no % 7).alias("n_rules"), (no % 50 == 49).alias("failed"))
    return C.quality_metrics(r, runtime, shortest=14, longest=100).withColumn("value", F.round("value", 6))


def catalog_score(spark: SparkSession, d: str) -> DataFrame:
    return C.quality_score(catalog_quality(spark, d))


FUNCTIONS = [json_objects, scraped_errors, normal_diagnostics, classify_topics, navigate_tree, topic_bridge, bottom_up, assign_clusters, label_clusters, catalog_blueprints, catalog_navigation, catalog_build, catalog_quality, catalog_score]
_N = f"""WITH {RULES_SQL}, n AS (SELECT doc_id AS sample, coalesce(text, '') AS text, j, doc_id % 12 + 12 * j AS k FROM documents, (SELECT unnest([0, 1, 2]) AS j)),
    named AS (SELECT *, 'exp_' || k AS rule_id FROM n)"""
_L = f"""WITH {RULES_SQL}, src AS (SELECT domain, topic, 'emb_' || error_type AS source_id, min(rule_no) AS p, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids, list(rule_id) AS ids FROM rules WHERE rule_no % 3 <> 0 GROUP BY ALL),
    labelled AS (SELECT domain, topic, row_number() OVER (PARTITION BY domain, topic ORDER BY p, source_id) AS place, source_id, rule_ids, ids FROM src),
    shown AS (SELECT domain, topic, place, CASE WHEN source_id = 'emb_units' THEN 'unit_checks' ELSE source_id END AS cluster_id, CASE WHEN source_id = 'emb_units' THEN 'Units' ELSE topic || ' Cluster ' || lpad(place::VARCHAR, 2, '0') END AS name,
        'Rules of ' || topic || ' that lie close together.' AS summary, rule_ids, ids FROM labelled)"""
_B = f"""{_L}, rest AS (SELECT domain, topic, rule_no, rule_id, (row_number() OVER (PARTITION BY domain, topic ORDER BY rule_no) - 1) // 2 + 1 AS c FROM rules WHERE rule_no % 3 = 0),
    top AS (SELECT domain, topic, max(place) AS last FROM shown GROUP BY ALL),
    blue AS (SELECT domain, topic, place, cluster_id, cluster_id || '_rules' AS group_id, rule_ids FROM shown
        UNION ALL SELECT domain, topic, coalesce(any_value(last), 0) + c, 'residual_rules_' || lpad(c::VARCHAR, 2, '0'), 'residual_rules_' || lpad(c::VARCHAR, 2, '0') || '_checks', string_agg(rule_id, ',' ORDER BY rule_no)
        FROM rest LEFT JOIN top USING (domain, topic) GROUP BY domain, topic, c)"""
_Q = f"""WITH {RULES_SQL}, s AS (SELECT domain, topic, substr(title, 1, 14) AS summary, "trigger", check_logic, rule_no % 4 = 1 AS clustered FROM rules),
    per AS (SELECT domain, topic, count_if(clustered) AS c FROM s GROUP BY ALL), dup AS (SELECT replace(lower(trim(summary)), 'ß', 'ss') AS k FROM s WHERE trim(summary) <> '' GROUP BY 1 HAVING count(*) > 1),
    metrics AS (SELECT 'n_rules' AS metric, count(*)::DOUBLE AS value FROM s UNION ALL SELECT 'n_topics', count(*) FROM per
        UNION ALL SELECT 'summary_problems', count_if(length(trim(summary)) < 14 OR length(trim(summary)) > 100) FROM s
        UNION ALL SELECT 'missing_logic', count_if("trigger" = '') + count_if(check_logic = '') FROM s UNION ALL SELECT 'clustered_ratio', round(avg(clustered::INT), 6) FROM s
        UNION ALL SELECT 'unclustered_topics', count_if(c = 0) FROM per UNION ALL SELECT 'duplicate_groups', count(*) FROM dup UNION ALL SELECT 'semantic_errors', count_if(doc_id % 50 = 49) FROM documents
        UNION ALL SELECT 'empty_samples', count_if(doc_id % 7 = 0) FROM documents UNION ALL SELECT 'broad_samples', count_if(doc_id % 7 > 5 OR doc_id % 4 > 2 OR doc_id % 5 > 3) FROM documents)"""
_TREE = [
    ("domain", "domain <> 'D1'", "(id % 7) / 4"), ("domain, topic", "(id + length(topic)) % 4 <> 0", "score / 10 - 0.1::DOUBLE"),
    ("domain, topic, cluster_id", "cluster_id <> 'c3'", "score / 20"), ("domain, topic, cluster_id, rule_id", "true", "score / 8"),
]
_LEVELS = ", ".join(
    f"l{i} AS (SELECT id, {keys}, max(greatest(0, least(1, {score}))) AS score FROM c SEMI JOIN leaf USING ({keys})" + (f" SEMI JOIN l{i - 1} USING (id, {_TREE[i - 1][0]})" if i else "") + f" WHERE {relevant} GROUP BY id, {keys})"
    for i, (keys, relevant, score) in enumerate(_TREE)
)
_ROWS = " UNION ALL ".join(
    f"SELECT id, {i} AS level, row_number() OVER (PARTITION BY id ORDER BY score DESC, {keys}) AS place, domain, {'topic' if i > 0 else 'NULL'} AS topic, {'cluster_id' if i > 1 else 'NULL'} AS cluster_id, {'rule_id' if i > 2 else 'NULL'} AS rule_id, round(score, 6) AS score FROM l{i}"
    for i, (keys, _, _) in enumerate(_TREE)
)
SQL = {
    "json_objects": "SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN doc_id::VARCHAR END AS no, CASE WHEN doc_id % 6 < 4 THEN coalesce(lang, '') WHEN doc_id % 6 = 4 THEN 'd' END AS lang FROM documents",
    "scraped_errors": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'only ' ELSE 'bad ' END || doc_id AS error, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'q"' || doc_id END AS quote,
        CASE WHEN doc_id % 3 = 2 THEN doc_id % 4 ELSE -1 END AS paragraph_index FROM documents""",
    "normal_diagnostics": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'error,info,info' END AS severities, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'm' || doc_id || ',d,' END AS messages,
        CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'q' END AS quotes, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS n_stated FROM documents""",
    "classify_topics": f"""WITH {RULES_SQL}, t AS (SELECT domain, topic, min(rule_no) AS place FROM rules GROUP BY ALL), every AS (SELECT * FROM t UNION ALL SELECT 'DX', topic, place + 1000 FROM t),
        a AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 1 THEN 'DX' WHEN 2 THEN 'D1' END AS wanted, 'T' || (doc_id % 15) AS topic FROM documents),
        r AS (SELECT a.id, every.domain, every.topic, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN wanted IS NULL OR wanted = every.domain THEN 0 ELSE 1 END, place) AS r FROM a LEFT JOIN every USING (topic))
        SELECT id, domain, topic FROM r WHERE r = 1""",
    "navigate_tree": f"""{R._C}, c AS (SELECT id, domain, topic, 'c' || right(rule_id, 1) AS cluster_id, rule_id, score FROM context),
        leaf AS (SELECT domain, topic, 'c' || right(rule_id, 1) AS cluster_id, rule_id FROM rules WHERE rule_no % 5 <> 0), {_LEVELS} {_ROWS}""",
    "topic_bridge": f"""{_N}, checks AS (SELECT rule_id, topic, row_number() OVER (PARTITION BY topic ORDER BY rule_no) AS r FROM rules WHERE rule_no % 5 <> 0),
        res AS (SELECT sample, rule_id, ['pass', 'fail', 'inconclusive'][(sample + k) % 3 + 1] AS result FROM named)
        SELECT d.sample, d.j AS pos, d.rule_id, c.rule_id AS bridge_rule_id, result, CASE WHEN result = 'fail' THEN 'fail' ELSE 'inconclusive' END AS symbolic_result, result = 'fail' AS attached
        FROM named d JOIN rules USING (rule_id) JOIN checks c ON c.topic = rules.topic AND c.r <= 2 JOIN res ON res.sample = d.sample AND res.rule_id = c.rule_id WHERE rules.rule_no % 5 = 0""",
    "bottom_up": f"""{_N}, checks AS (SELECT rule_id, topic, title, row_number() OVER (PARTITION BY topic ORDER BY rule_no) AS r FROM rules),
        f AS (SELECT sample, rule_id, text, title, CASE WHEN j = 0 THEN translate(substr(text, 21, 10), 'abcdefgh', 'ABCDEFGH') || ': seen' ELSE 'nowhere to be seen' END AS e FROM named JOIN checks USING (rule_id)
            WHERE (sample + j) % 3 <> 0 AND r <= 2 AND topic = 'T' || (sample % 12) AND k % 7 <> 0),
        q AS (SELECT *, list_filter(list_concat([trim(e), trim(split_part(e, ':', 1)), trim(substr(e, 1, 80)), 'no'], list_filter(string_split(title, ' '), lambda w: length(w) >= 3)[1:6]), lambda c: length(c) >= 6 AND (contains(text, c) OR contains(lower(text), lower(c))))[1] AS quote FROM f)
        SELECT sample, rule_id, 'warning' AS severity, 'check failed: no' AS message, quote, coalesce(CASE WHEN contains(text, quote) THEN strpos(text, quote) ELSE strpos(lower(text), lower(quote)) END - 1, -1) AS start, quote IS NOT NULL AS published FROM q""",
    "assign_clusters": f"""WITH {RULES_SQL}, c AS (SELECT *, CASE rule_no % 5 WHEN 0 THEN 'cluster_first_one' WHEN 1 THEN 'cluster_second' END AS own FROM rules)
        SELECT rule_id, coalesce(own, max(own) OVER (PARTITION BY domain, topic), 'cluster_general') AS cluster_id FROM c""",
    "label_clusters": f"{_L} SELECT domain, topic, place, cluster_id, name, summary, rule_ids FROM shown",
    "catalog_blueprints": f"{_B} SELECT * FROM blue",
    "catalog_navigation": f"""{_B}, leaf AS (SELECT domain, topic, cluster_id, group_id, unnest(string_split(rule_ids, ',')) AS rule_id FROM blue),
        g AS (SELECT domain, topic, cluster_id, count(*) AS n, string_agg(rule_id, ',' ORDER BY group_id, rule_id) AS ids FROM leaf GROUP BY ALL)
        SELECT domain, topic, sum(n)::BIGINT AS n_rules, string_agg(cluster_id || ':' || ids, ';' ORDER BY cluster_id) AS clusters FROM g GROUP BY ALL""",
    "catalog_build": f"""WITH {RULES_SQL}, every AS (SELECT rule_no, rule_id, domain, topic, title, "trigger", check_logic, support FROM rules
            UNION ALL SELECT rule_no + 1000, rule_id || 'b', domain, topic, upper(title), "trigger", check_logic, support FROM rules WHERE rule_no % 4 = 0)
        SELECT arg_min(rule_id, rule_no) AS rule_id, CASE WHEN topic = 'T5' THEN domain ELSE lower(domain) END AS domain, topic, sum(support)::BIGINT AS support, count(*) AS n_merged, topic = 'T5' AS orphan
        FROM every GROUP BY domain, topic, replace(lower(title), 'ß', 'ss'), replace(lower("trigger"), 'ß', 'ss'), replace(lower(check_logic), 'ß', 'ss')""",
    "catalog_quality": f"{_Q} SELECT * FROM metrics",
    "catalog_score": f"""{_Q}, m AS (SELECT metric, value, CASE metric WHEN 'summary_problems' THEN least(20, value) WHEN 'missing_logic' THEN least(20, value) WHEN 'empty_samples' THEN least(10, 3 * value) WHEN 'broad_samples' THEN least(8, 2 * value)
            WHEN 'clustered_ratio' THEN CASE WHEN value < 0.6 THEN 15 ELSE 0 END WHEN 'unclustered_topics' THEN CASE WHEN value > 30 THEN 10 ELSE 0 END WHEN 'duplicate_groups' THEN CASE WHEN value > 100 THEN 5 ELSE 0 END
            WHEN 'semantic_errors' THEN CASE WHEN value > 0 THEN 20 ELSE 0 END ELSE 0 END AS p FROM metrics)
        SELECT greatest(0, 100 - sum(p)) AS score, count_if(p > 0)::BIGINT AS n_issues, count_if(metric IN ('semantic_errors', 'empty_samples') AND value > 0) = 0 AS ready FROM m""",
}
