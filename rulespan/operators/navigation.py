"""Scenario clusters, reranking and merging of judgments, and answers and literals inside texts."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from ..functions import text as T


def scenario_clusters(rules: DataFrame, groups: DataFrame) -> DataFrame:
    """``rules`` with cluster_id and group_id of the first group of their topic, by place, that claims them.

    ``groups`` (domain, topic, place, cluster_id, group_id, rule_ids, match_any): a group with rule ids claims those,
    one without claims rules whose text holds any of its phrases. What no group claims goes to general_reasoning. The
    groups of a topic are few and meet a rule as one array, so that no row is made for a group that does not match.
    """
    per = groups.groupBy("domain", "topic").agg(F.array_sort(F.collect_list(F.struct("place", "cluster_id", "group_id", "rule_ids", "match_any"))).alias("__g"))
    hay = T.fold(F.concat_ws(" ", *(T.norm_text(F.col(c)) for c in ("title", "trigger", "check_logic"))))
    both = rules.join(per, ["domain", "topic"], "left").withColumn("__hay", hay)
    listed = lambda g: F.coalesce(F.size(g["rule_ids"]), F.lit(0)) > 0
    claims = lambda g: F.when(listed(g), F.array_contains(g["rule_ids"], F.col("rule_id"))).otherwise(F.exists(g["match_any"], lambda m: F.contains(F.col("__hay"), m)))
    first = both.withColumn("__first", F.get(F.filter("__g", claims), F.lit(0)))
    return first.withColumns({"cluster_id": F.coalesce("__first.cluster_id", F.lit("general_reasoning")), "group_id": F.coalesce("__first.group_id", F.lit("general_reasoning_checks"))}).drop("__g", "__hay", "__first")


def rerank_rules(scored: DataFrame, orders: DataFrame, pool: int = 18) -> DataFrame:
    """``scored`` (id, rule_id, score, adjusted, …) with both scores raised by place r in ``orders`` (id, order): times
    1 + max(0, 0.28 - 0.015 r), for the ``pool`` best rules of a sample that are in an order of two or more."""
    per = Window.partitionBy("id")
    df = scored.join(orders, "id", "left").withColumns({"__p": F.row_number().over(per.orderBy(F.desc("adjusted"), "rule_id")), "__n": F.count("*").over(per)})
    place = F.size("order") - F.array_position(F.reverse("order"), F.col("rule_id"))
    known = (F.col("__p") <= pool) & (F.col("__n") >= 2) & (F.size("order") >= 2) & F.array_contains("order", F.col("rule_id"))
    factor = F.when(known, 1 + F.greatest(F.lit(0.0), 0.28 - 0.015 * place)).otherwise(1.0)
    return df.withColumns({"score": F.col("score") * factor, "adjusted": F.col("adjusted") * factor, "factor": factor}).drop("__p", "__n", "order")


def rerank_topics(scores: DataFrame, orders: DataFrame, pool: int = 8) -> DataFrame:
    """``scores`` (id, domain, topic, score) with place: the ``pool`` best topics in the order of ``orders`` (id, order of
    places from 0), those that it leaves out after them, the others last. An order of one or none changes nothing."""
    per = Window.partitionBy("id")
    df = scores.join(orders, "id", "left").withColumn("__r", F.row_number().over(per.orderBy(F.desc("score"), "domain", "topic")).cast("int"))
    at = F.array_position("order", F.col("__r") - 1)
    kind = F.when(F.col("__r") > pool, 2).when((F.size("order") >= 2) & (at > 0), 0).otherwise(1)
    df = df.withColumns({"__k": kind, "__a": F.when(kind == 0, at).otherwise(F.col("__r"))})
    return df.withColumn("place", F.row_number().over(per.orderBy("__k", "__a"))).drop("__r", "__k", "__a", "order")


def merge_judgments(by_cluster: DataFrame, by_topic: DataFrame, clusters: DataFrame, per_topic: int = 2, most: int = 5) -> DataFrame:
    """(id, place, domain, topic, cluster_id, rule_id, score): the best judgment of each rule, ``most`` for a sample.

    Judgments over whole topics count where no cluster of the topic gave one; a topic without any of ``clusters``
    (id, domain, topic) keeps ``per_topic`` of them.
    """
    key = ["id", "domain", "topic"]
    rest = by_topic.join(by_cluster.select(*key).distinct(), key, "left_anti").withColumn("cluster_id", F.lit(None).cast("string"))
    every = by_cluster.unionByName(rest.select(*by_cluster.columns))
    first = F.row_number().over(Window.partitionBy("id", "rule_id").orderBy(F.desc("score"), F.col("cluster_id").isNull(), "domain", "topic", "cluster_id"))
    best = every.withColumn("__r", first).where("__r = 1").join(clusters.select(*key).distinct().withColumn("__c", F.lit(True)), key, "left")
    best = best.withColumn("__loose", F.col("cluster_id").isNull() & F.col("__c").isNull())
    rank = F.row_number().over(Window.partitionBy(*key, "__loose").orderBy(F.desc("score"), "rule_id"))
    kept = best.withColumn("__r", rank).where(~F.col("__loose") | (F.col("__r") <= per_topic))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "domain", "topic", "rule_id"))
    return kept.withColumn("place", place).where(F.col("place") <= most).select("id", "place", "domain", "topic", "cluster_id", "rule_id", "score")


def _boxed(text: str) -> list[str]:
    found, opened, begin = [], 0, -1
    for m in re.finditer(r"\\boxed\{|[{}]", text):
        if begin < 0:
            if len(m[0]) > 1:
                opened, begin = 1, m.end()
            continue
        opened += 1 if m[0] != "}" else -1
        if opened == 0:
            found.append(text[begin : m.start()])
            begin = -1
    return found


@F.pandas_udf(ArrayType(StringType()))
def boxed(texts: pd.Series) -> pd.Series:
    """The contents of every boxed answer with balanced braces; one that never closes ends the search."""
    return texts.map(lambda t: _boxed(t or ""))


def _literal(text: str | None) -> dict[str, str]:
    try:
        value = ast.literal_eval(text or "")
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return {}
    return {str(k): str(v) for k, v in value.items()} if isinstance(value, dict) else {}


@F.pandas_udf(MapType(StringType(), StringType()))
def literal_map(texts: pd.Series) -> pd.Series:
    """The entries of a dictionary written as a literal, as strings; empty for anything else."""
    return texts.map(_literal)


def literal_field(texts: Column, name: str) -> Column:
    """One entry of a dictionary written as a literal, as a string, or null."""
    return F.try_element_at(literal_map(texts), F.lit(name))
