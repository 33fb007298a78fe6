"""Queries over clusters, reranking, merged judgments and parsed answers; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import navigation as N
from ..operators.lineage import cut
from ..operators.roles import RULES_SQL, rules, table
from . import retrieval as R

PHRASES = [(1, "first", ["ing", "tion"]), (2, "second", ["qu", "sch"])]


def scenario_clusters(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    listed = r.where("rule_no % 10 = 3").groupBy("domain", "topic").agg(F.collect_list("rule_id").alias("rule_ids")).select("domain", "topic", F.lit(0).alias("place"), F.lit("listed").alias("cluster_id"), F.lit("g0").alias("group_id"), "rule_ids", F.array().cast("array<string>").alias("match_any"))
    topics = r.select("domain", "topic").distinct()
    groups = listed
    for place, name, phrases in PHRASES:
        groups = groups.unionByName(topics.select("*", F.lit(place).alias("place"), F.lit(name).alias("cluster_id"), F.lit(f"g{place}").alias("group_id"), F.array().cast("array<string>").alias("rule_ids"), F.array(*map(F.lit, phrases)).alias("match_any")))
    return N.scenario_clusters(r, groups).select("rule_id", "topic", "cluster_id", "group_id")


def rerank_rules(spark: SparkSession, d: str) -> DataFrame:
    c = cut(R._context(spark, d).select("id", "rule_id", "score", "adjusted"), "context")  # orders are made of it, and ranked
    orders = c.groupBy("id").agg(F.sort_array(F.collect_list("rule_id")).alias("order"))
    return N.rerank_rules(c, orders, 6).select("id", "rule_id", F.round("adjusted", 6).alias("adjusted"), F.round("factor", 6).alias("factor"))


def rerank_topics(spark: SparkSession, d: str) -> DataFrame:
    s = R.topic_score(spark, d)
    orders = s.select("id").distinct().withColumn("order", F.array(*(F.lit(i) for i in (7, 5, 3, 3, 99))))
    return N.rerank_topics(s, orders).select("id", "domain", "topic", "place")


def merge_judgments(spark: SparkSession, d: str) -> DataFrame:
    c = cut(R._context(spark, d).where("score > 0").select("id", "domain", "topic", "topic_rank", "rule_id", "score"), "judged")  # read four times
    by_cluster = c.where("rule_id LIKE '%1' OR rule_id LIKE '%4'").select("id", "domain", "topic", F.concat(F.lit("c"), F.substring("rule_id", -1, 1)).alias("cluster_id"), "rule_id", "score")
    clusters = by_cluster.select("id", "domain", "topic").unionByName(c.where("topic_rank = 2").select("id", "domain", "topic"))
    return N.merge_judgments(by_cluster, c.select("id", "domain", "topic", "rule_id", "score"), clusters)


def boxed_answers(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("so \\boxed{a_{"), "doc_id", F.lit("}} or \\boxed{"), "lang", F.lit("} and {\\boxed{open"))
    return table(spark, d, "documents").select("doc_id", F.array_join(N.boxed(text), ";").alias("answers"))


def literal_fields(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, "not one").otherwise(F.concat(F.lit("{'acc': True, 'no': "), "doc_id", F.lit(", 'lang': '"), "lang", F.lit("'}")))
    return table(spark, d, "documents").select("doc_id", *(N.literal_field(text, n).alias(n) for n in ("acc", "no", "lang")))


FUNCTIONS = [scenario_clusters, rerank_rules, rerank_topics, merge_judgments, boxed_answers, literal_fields]
_MATCH = " ".join(f"WHEN {' OR '.join(f'contains(hay, {chr(39)}{p}{chr(39)})' for p in phrases)} THEN '{{{place}}}'" for place, _, phrases in PHRASES)
_CASE = "CASE WHEN rule_no % 10 = 3 THEN '{0}' " + _MATCH + " ELSE '{3}' END"
SQL = {
    "scenario_clusters": f"""WITH {RULES_SQL}, h AS (SELECT *, replace(lower(concat_ws(' ', title, "trigger", check_logic)), 'ß', 'ss') AS hay FROM rules)
        SELECT rule_id, topic, {_CASE.format("listed", "first", "second", "general_reasoning")} AS cluster_id, {_CASE.format("g0", "g1", "g2", "general_reasoning_checks")} AS group_id FROM h""",
    "rerank_rules": f"""{R._C}, p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY adjusted DESC, rule_id) AS p, row_number() OVER (PARTITION BY id ORDER BY rule_id) - 1 AS r, count(*) OVER (PARTITION BY id) AS n FROM context),
        f AS (SELECT *, CASE WHEN p <= 6 AND n >= 2 THEN 1 + greatest(0, 0.28::DOUBLE - 0.015::DOUBLE * r) ELSE 1 END AS factor FROM p)
        SELECT id, rule_id, round(adjusted * factor, 6) AS adjusted, round(factor, 6) AS factor FROM f""",
    "rerank_topics": f"""{R._S}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain, topic) - 1 AS i FROM scores)
        SELECT id, domain, topic, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN i >= 8 THEN 2 WHEN i IN (7, 5, 3) THEN 0 ELSE 1 END, CASE WHEN i IN (7, 5, 3) THEN -i ELSE i END) AS place FROM r""",
    "merge_judgments": f"""{R._C}, c AS (SELECT id, domain, topic, topic_rank, rule_id, score FROM context WHERE score > 0),
        bc AS (SELECT id, domain, topic, 'c' || right(rule_id, 1) AS cluster_id, rule_id, score FROM c WHERE rule_id LIKE '%1' OR rule_id LIKE '%4'),
        clustered AS (SELECT DISTINCT id, domain, topic FROM bc), tried AS (SELECT * FROM clustered UNION SELECT id, domain, topic FROM c WHERE topic_rank = 2),
        every AS (SELECT * FROM bc UNION ALL SELECT id, domain, topic, NULL, rule_id, score FROM c ANTI JOIN clustered USING (id, domain, topic)),
        loose AS (SELECT every.*, cluster_id IS NULL AND tried.id IS NULL AS loose FROM every LEFT JOIN tried ON every.id = tried.id AND every.domain = tried.domain AND every.topic = tried.topic),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY id, domain, topic, loose ORDER BY score DESC, rule_id) AS r FROM loose)
        SELECT id, place, domain, topic, cluster_id, rule_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain, topic, rule_id) AS place FROM ranked WHERE NOT loose OR r <= 2) WHERE place <= 5""",
    "boxed_answers": "SELECT doc_id, 'a_{' || doc_id || '};' || lang AS answers FROM documents",
    "literal_fields": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'True' END AS acc, CASE WHEN doc_id % 5 <> 0 THEN doc_id::VARCHAR END AS no, CASE WHEN doc_id % 5 <> 0 THEN lang END AS lang FROM documents",
}
