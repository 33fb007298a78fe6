"""Rules of catalogs whose topics hold them in a flat list or in a tree of any depth.

Catalogs come as JSON of no fixed schema. Trees are opened level by level: each round yields the rules of all nodes of one
depth, of all topics at once, and their children. The number of rounds is the depth of the deepest tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _list(v: Column, path: str) -> Column:
    """The objects of a list inside a variant, with their places; none if there is no list."""
    items = F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(items, lambda x, i: F.struct(i.alias("at"), x.alias("v"))), lambda s: s["v"].isNotNull() & _object(s["v"]))


def topics(catalogs: DataFrame) -> DataFrame:
    """(catalog, domain_no, domain, topic_no, topic, v): the topics of ``catalogs`` (catalog, json) as variants, in order.
    What is no JSON holds none; a domain or topic without a name is ``Unknown``."""
    v = catalogs.select("catalog", F.try_parse_json("json").alias("v")).where(_object(F.col("v")))
    name = lambda c: F.coalesce(F.try_variant_get(c, "$.name", "string"), F.lit("Unknown"))
    d = v.select("catalog", F.explode(_list(F.col("v"), "$.domains")).alias("d"))
    t = d.select("catalog", F.col("d.at").alias("domain_no"), name(F.col("d.v")).alias("domain"), F.explode(_list(F.col("d.v"), "$.topics")).alias("t"))
    return t.select("catalog", "domain_no", "domain", F.col("t.at").alias("topic_no"), name(F.col("t.v")).alias("topic"), F.col("t.v").alias("v"))


def rule_leaves(catalogs: DataFrame) -> DataFrame:
    """(catalog, domain_no, domain, topic_no, topic, path, ordinal, rule_id, description, rule) of every rule of ``catalogs``
    (catalog, json; catalogs distinct).

    A topic with a list ``rules`` that holds an object yields these; any other one yields the ``rule`` of every node of its
    ``rule_tree``, a node before its ``children``. path has the places of the children that lead to a rule, ordinal counts
    a topic's rules from 0, rule is the rule's JSON. rule_id is ``rule_id`` or ``id``, trimmed; a rule without a description has
    one made of its trigger and check logic. Entries that are no objects are passed over.
    """
    every = cut(topics(catalogs), "topics")
    key = ["catalog", "domain_no", "domain", "topic_no", "topic"]
    flat = every.withColumn("own", _list(F.col("v"), "$.rules"))
    leaves = [flat.select(*key, F.explode("own").alias("r")).select(*key, F.array("r.at").alias("path"), F.col("r.v").alias("rule"))]
    root = F.try_variant_get("v", "$.rule_tree", "variant")
    level = flat.where(F.size("own") == 0).select(*key, F.array().cast("array<int>").alias("path"), root.alias("v")).where(_object(F.col("v")))
    while not (level := cut(level, "level")).isEmpty():
        own = F.try_variant_get("v", "$.rule", "variant")
        leaves.append(level.select(*key, "path", own.alias("rule")).where(_object(F.col("rule"))))
        level = level.select(*key, "path", F.explode(_list(F.col("v"), "$.children")).alias("c")).select(*key, F.concat("path", F.array("c.at")).alias("path"), F.col("c.v").alias("v"))
    found = leaves[0]
    for more in leaves[1:]:
        found = found.unionByName(more)
    text = lambda name: F.coalesce(F.try_variant_get("rule", f"$.{name}", "string"), F.lit(""))
    ordinal = F.row_number().over(Window.partitionBy("catalog", "domain_no", "topic_no").orderBy("path")) - 1  # of one topic
    labelled = [F.when(text(c) != "", F.concat(F.lit(label), text(c))) for label, c in (("Trigger: ", "trigger"), ("Check Logic: ", "check_logic"))]
    rule_id = F.trim(F.when(text("rule_id") != "", text("rule_id")).otherwise(text("id")))
    description = F.when(text("description") != "", text("description")).otherwise(F.concat_ws("\n", *labelled))
    return found.select(*key, "path", ordinal.alias("ordinal"), rule_id.alias("rule_id"), description.alias("description"), F.to_json("rule").alias("rule"))


def find_rules(leaves: DataFrame, ids: DataFrame) -> DataFrame:
    """The first of ``leaves`` of each catalog with each ``rule_id`` of ``ids``, by domain, topic and ordinal."""
    first = F.min(F.struct("domain_no", "topic_no", "ordinal", "domain", "topic", "description", "rule")).alias("r")
    return leaves.join(ids.select("rule_id").distinct(), "rule_id").groupBy("catalog", "rule_id").agg(first).select("catalog", "rule_id", "r.*")
