"""Adding, removing, binding and grading rules of a catalog, hints for retrieval, and reports over runs and error items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .analysis import ratio
from .phrase_index import found_sets
from .retrieval import small, spread

#: Marks of error texts that speak about the reference answer, and of those that are not sure.
ARTIFACTS = ["reference answer", "uses a different variable", "not defined in the student's answer", "placeholder for", "reference uses"]
DOUBTS = ["not an error", "minor omission", "might be", "could be", "uncertain", "not necessarily"]
NEGATIVE_CONDITIONS = ["intermediate value later corrected", "rule not required by the problem", "equivalent formulation"]


def ordered_unique(items: Column) -> Column:
    """Items without blanks, trimmed, each folded spelling once, in its first spelling and place."""
    trimmed = F.filter(F.transform(items, T.norm_text), lambda x: x != "")
    return F.filter(trimmed, lambda x, i: F.array_position(F.transform(trimmed, T.fold), T.fold(x)) == i + 1)


def add_rules(catalog: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog with the rules of ``new`` that it lacks, (rule_no, rule_id, warning) of those that were left out): rules
    without an id, with an id the catalog has, or that an earlier new one has (by rule_no)."""
    rid = F.trim(F.coalesce("rule_id", F.lit("")))
    first = F.row_number().over(Window.partitionBy(rid).orderBy("rule_no"))
    df = new.withColumn("__first", first == 1).join(catalog.select("rule_id").distinct().withColumn("__has", F.lit(True)), "rule_id", "left")
    warning = F.when(rid == "", "without rule_id").when(F.col("__has") | ~F.col("__first"), "duplicate rule_id")
    df = df.withColumn("warning", warning)
    added = df.where("warning is null").select(*catalog.columns)
    return catalog.unionByName(added), df.where("warning is not null").select("rule_no", "rule_id", "warning")


def remove_rules(catalog: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog without the rules of ``ids`` (rule_id), the ids that were there)."""
    wanted = ids.select(F.trim("rule_id").alias("rule_id")).where("rule_id <> ''").distinct()
    return catalog.join(wanted, "rule_id", "left_anti").select(*catalog.columns), catalog.join(wanted, "rule_id", "left_semi").select("rule_id")


def bind_checks(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """``catalog`` with function_name and source of its check, the last of the manifest (rule_id, place, function_name,
    source) for a rule, or nulls."""
    last = manifest.where("trim(rule_id) <> ''").groupBy(F.trim("rule_id").alias("rule_id")).agg(F.max_by(F.struct("function_name", F.coalesce("source", F.lit("experience_code_manifest")).alias("source")), "place").alias("__b"))
    return catalog.join(last, "rule_id", "left").select(*catalog.columns, "__b.function_name", "__b.source")


def default_precision(rules: DataFrame) -> DataFrame:
    """``rules`` (is_meta, primitive, required_symbols, trigger_keywords, object_keywords) with profile, policy, preconditions,
    violation_signatures, negative_conditions and evidence_requirements as they are without other knowledge."""
    few = lambda c, n: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n)
    anchors = ordered_unique(F.concat(few("required_symbols", 3), few("trigger_keywords", 2)))
    policy = F.when(F.coalesce("primitive", F.lit("")).isin("", "none"), "suppress_on_pass").otherwise("suppress_on_inconclusive")
    return rules.withColumns({
        "profile": F.when(F.col("is_meta"), "balanced").otherwise("strict"), "policy": policy, "preconditions": ordered_unique(F.concat(few("trigger_keywords", 3), few("object_keywords", 2))),
        "violation_signatures": anchors, "negative_conditions": F.array(*map(F.lit, NEGATIVE_CONDITIONS)), "evidence_requirements": anchors,
    })


def library(experience: DataFrame, knowledge: DataFrame, source: str = "hybrid") -> DataFrame:
    """A flat library by ``source``: hybrid (experience rules, then knowledge rules with new ids), experience-only or
    knowledge-only."""
    tables = {"hybrid": [experience, knowledge], "experience-only": [experience], "knowledge-only": [knowledge]}[source]
    from ..sources.rollouts import upserted

    return upserted(tables, ["rule_id"])


def validate_blueprints(rules: DataFrame, blueprints: DataFrame, mode: str = "full") -> DataFrame:
    """(problem, topic_key) of ``blueprints`` (topic_key, rule_ids) against ``rules`` (topic_key, rule_id).

    full looks at every topic of the catalog and wants each rule assigned; subset looks at the topics of the blueprints.
    Every problem of a topic is a row: missing_topic, unknown_topic, empty_clusters, duplicate_assignment, unknown_rules,
    uncovered_rules.
    """
    none = F.array().cast("array<string>")
    have = rules.groupBy("topic_key").agg(F.collect_set("rule_id").alias("own"))
    given = blueprints.groupBy("topic_key").agg(F.flatten(F.collect_list(F.coalesce("rule_ids", none))).alias("ids"))
    both = have.join(given, "topic_key", "full_outer")
    ids, own = F.coalesce("ids", none), F.coalesce("own", none)
    filled = F.col("own").isNotNull() & (F.size(ids) > 0)
    extra, rest = F.size(F.array_except(ids, own)) > 0, F.size(F.array_except(own, ids)) > 0
    problems = F.array(
        F.when(F.lit(mode == "full") & F.col("ids").isNull(), "missing_topic"), F.when(F.lit(mode == "subset") & F.col("own").isNull(), "unknown_topic"), F.when(F.col("own").isNotNull() & F.col("ids").isNotNull() & (F.size(ids) == 0), "empty_clusters"),
        F.when(filled & (F.size(F.array_distinct(ids)) != F.size(ids)), "duplicate_assignment"), F.when(filled & extra, "unknown_rules"), F.when(filled & (extra | rest), "uncovered_rules"),
    )
    return both.select("topic_key", F.explode(F.array_compact(problems)).alias("problem"))


#: Fixed value: what separates the parts of a scene.
PART_ENDS = r"[()/,;:，；]+| and | of | with | - "


def scene_keywords(topics: DataFrame, generic: list[str], most: int = 16) -> DataFrame:
    """``topics`` (key…, name, texts) with scenes: the name, the texts and their parts between punctuation, ``and``, ``of``,
    ``with`` and dashes, that say something: at most ``most``, each once.

    A part is left out if it is generic, up to two capitals, or a single word of three characters or fewer; the name
    itself may be a short word.
    """
    text = lambda x: T.norm_text(x)
    said = lambda x: ~T.fold(x).isin([*generic, *T.LOW_SIGNAL]) & ~x.rlike("^[A-Z]{1,2}$") & (x != "")
    long = lambda x: said(x) & (F.contains(x, F.lit(" ")) | (F.length(x) >= 4))
    parts = lambda x: F.filter(F.transform(F.split(x, "(?i)" + PART_ENDS), text), long)
    name = text(F.col("name"))
    own = F.concat(F.filter(F.array(name), said), parts(name), F.flatten(F.transform("texts", lambda x: F.concat(F.filter(F.array(text(x)), long), parts(text(x))))))
    return topics.withColumn("scenes", F.slice(ordered_unique(own), 1, most))


def keyword_overrides(features: DataFrame, overrides: DataFrame, column: str = "keywords") -> DataFrame:
    """``features`` (rule_id, keywords) with the words of ``overrides`` (rule_id, drop, prepend) left out and put first."""
    none = F.array().cast("array<string>")
    df = features.join(overrides.select("rule_id", "drop", "prepend"), "rule_id", "left")
    gone = F.transform(F.coalesce("drop", none), T.fold)
    kept = F.filter(F.col(column), lambda w: ~F.array_contains(gone, T.fold(w)))
    return df.withColumn(column, ordered_unique(F.concat(F.coalesce("prepend", none), kept))).drop("drop", "prepend")


def rule_summary(rules: DataFrame, most: int = 160) -> DataFrame:
    """``rules`` with summary: node_summary, else title and logic, else title and trigger, up to ``most`` characters, and
    embedding_text: domain, topic, title, summary and logic by lines."""
    has = lambda c: F.nullif(T.norm_text(F.col(c)), F.lit(""))
    title = T.norm_text(F.col("title"))
    s = F.left(F.coalesce(has("node_summary"), F.concat(title, F.lit(": "), has("check_logic")), F.concat(title, F.lit(": "), has("trigger")), title), F.lit(most))
    return rules.withColumn("summary", s).withColumn("embedding_text", F.concat_ws("\n", has("domain"), has("topic"), has("title"), F.nullif("summary", F.lit("")), has("check_logic")))


def srd_text(rules: DataFrame) -> DataFrame:
    """``rules`` with srd, the text a rule is checked by, by its source: the description of tagged ones; title, trigger and
    logic of others that have an id; title, description and logic of knowledge rules."""
    line = lambda label, c: F.concat(F.lit(label + ": "), F.nullif(F.coalesce(c, F.lit("")), F.lit("")))
    short = F.concat_ws("\n", line("Title", "title"), line("Trigger", "trigger"), line("Check Logic", "check_logic"))
    own = F.when((short == "") & (F.coalesce("source", F.lit("")) != "experience"), F.coalesce("description", F.lit(""))).otherwise(short)
    plain = F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("None"))) for label, c in (("Title", "title"), ("Description", "description"), ("Check Logic", "check_logic"))))
    return rules.withColumn("srd", F.when(F.col("source") == "experience_tagged", F.coalesce("description", F.lit(""))).when((F.col("source") == "experience") | F.col("rule_id").isNotNull(), own).otherwise(plain))


def inject_rules(selected: DataFrame, extra: DataFrame, key: list[str]) -> DataFrame:
    """``selected`` and those of ``extra`` (same columns) that it lacks by ``key``."""
    return selected.unionByName(extra.join(selected.select(*key), key, "left_anti").select(*selected.columns))


def applicable_specs(samples: DataFrame, specs: DataFrame, most: int = 3, long: int = 22) -> DataFrame:
    """(id, spec_id, hits, long_hits, score, place): the ``most`` best specs of each sample (id, hay): two keywords, or one of
    ``long`` characters or more, stand in its text; hits plus twice the long ones less the spec's penalty.

    ``specs`` (spec_id, keywords, penalty) may be of any number. Each distinct keyword is looked for once in a text, by
    :mod:`phrase_index`, and what is found is joined with the specs that have it."""
    words = specs.select("spec_id", F.explode(F.transform("keywords", T.fold)).alias("k"), "penalty").where("k <> ''").withColumn("n", F.lit(1)).groupBy("spec_id", "penalty", "k").agg(F.sum("n").alias("n"))
    found = spread(found_sets(spread(samples.select("id", "hay")), words.select(F.col("k").alias("phrase")), alone=False)).select("id", F.explode("found").alias("k"))
    hit = found.join(small(words), "k").groupBy("id", "spec_id", "penalty").agg(F.sum("n").alias("hits"), F.sum(F.when(F.length("k") >= long, F.col("n")).otherwise(0)).alias("long_hits"))
    df = hit.where("hits >= 2 OR long_hits >= 1")
    df = df.withColumn("score", F.col("hits") + 2 * F.col("long_hits") - F.col("penalty"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "spec_id"))
    return df.withColumn("place", place).where(F.col("place") <= most).drop("penalty")


def topic_quality(rules: DataFrame) -> DataFrame:
    """(domain, topic, n_rules, no_logic, no_symbols, near_dup_groups, n_support) of each topic: near duplicates share a title
    but for case and signs."""
    plain = F.regexp_replace(T.fold(F.col("title")), "[^a-z0-9]+", "")
    groups = rules.groupBy("domain", "topic", plain.alias("k")).agg(F.count("*").alias("n"), F.count_if(T.norm_text(F.col("check_logic")) == "").alias("l"), F.count_if(F.size("required_symbols") == 0).alias("s"), F.sum("support").alias("u"))
    return groups.groupBy("domain", "topic").agg(F.sum("n").alias("n_rules"), F.sum("l").alias("no_logic"), F.sum("s").alias("no_symbols"), F.count_if((F.col("n") > 1) & (F.col("k") != "")).alias("near_dup_groups"), F.sum("u").alias("n_support"))


def run_report(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """One row over an extraction run (id, topic, failed): ids, repeated ids, failures, rows of topics that ``topics`` (topic)
    lacks."""
    per = rows.join(topics.select("topic").distinct().withColumn("__known", F.lit(True)), "topic", "left").groupBy("id").agg(F.count("*").alias("n"), F.count_if("failed").alias("f"), F.count_if(F.col("__known").isNull()).alias("u"))
    t = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(t("n").alias("n_rows"), F.count("*").alias("n_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"), t("f").alias("n_failed"), t("u").alias("unknown_topic"))


def cluster_coverage(members: DataFrame, least: float = 0.6) -> DataFrame:
    """(label, n_rules, n_clusters, clustered, coverage, ready): how much of each topic is in clusters, and whether enough."""
    g = members.groupBy("label").agg(F.count("*").alias("n_rules"), F.count_distinct("cluster_id").alias("n_clusters"), F.count("cluster_id").alias("clustered"))
    share = ratio(F.col("clustered"), F.col("n_rules"))
    return g.withColumns({"coverage": F.round(share, 6), "ready": (share >= least) & (F.col("n_clusters") > 0)})


def quality_errors(items: DataFrame, least_words: int = 5, jaccard: float = 0.72) -> DataFrame:
    """The ``items`` (sample, no, error, quote, paragraph) worth keeping: no talk of the reference answer, no doubt, five or
    more words of three characters, no near copy of a kept one of the same paragraph or quote, and one for each quote.

    What is kept depends on what was kept before, so that a sample's few items are folded in order, as one array.
    """
    low = F.lower(F.coalesce("error", F.lit("")))
    words = F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= 3))
    key = T.fold(F.trim(F.coalesce("quote", F.lit(""))))
    bad = F.exists(F.array(*map(F.lit, ARTIFACTS + DOUBTS)), lambda m: F.contains(low, m))
    kind = "array<struct<no:int,quote:string,paragraph:int,words:array<string>>>"
    item = F.struct(F.col("no").cast("int").alias("no"), key.alias("quote"), F.coalesce(F.col("paragraph").cast("int"), F.lit(-1)).alias("paragraph"), words.alias("words"))
    per = items.where(~bad & (F.size(words) >= least_words)).groupBy("sample").agg(F.array_sort(F.collect_list(item)).alias("s"))

    def step(kept: Column, x: Column) -> Column:
        near = lambda k: (((k["paragraph"] == x["paragraph"]) & (x["paragraph"] >= 1)) | ((k["quote"] == x["quote"]) & (x["quote"] != ""))) & (F.size(F.array_intersect(k["words"], x["words"])) >= jaccard * F.size(F.array_union(k["words"], x["words"])))
        used = F.exists(kept, lambda k: (k["quote"] == x["quote"]) & (x["quote"] != ""))
        return F.when(F.exists(kept, near) | used, kept).otherwise(F.concat(kept, F.array(x)))

    kept = per.select("sample", F.explode(F.aggregate("s", F.array().cast(kind), step)).alias("k")).select("sample", F.col("k.no").alias("no"))
    return items.join(kept, ["sample", "no"], "left_semi")


def eval_pools(samples: DataFrame) -> DataFrame:
    """``samples`` (id, expected, predicted: arrays of normalised answers, acc) with pool: correct if both are equal, relaxed
    if every expected answer is found in a predicted one or holds it, wrong if neither and acc is not above 0.999999."""
    strict = F.col("expected") == F.col("predicted")
    near = lambda e: F.exists("predicted", lambda p: (p != "") & (e != "") & (F.contains(p, e) | F.contains(e, p)))
    relaxed = (F.size("expected") > 0) & F.forall("expected", near)
    return samples.withColumn("pool", F.when(strict, "correct").when(relaxed, "relaxed").when(F.coalesce(F.col("acc") < 0.999999, F.lit(True)), "wrong").otherwise("none"))


def ranked_topics(rules: DataFrame, most: int) -> DataFrame:
    """(domain, topic, n_rules): the ``most`` topics of the most rules, by name on a tie."""
    return rules.groupBy("domain", "topic").agg(F.count("*").alias("n_rules")).orderBy(F.desc("n_rules"), "domain", "topic").limit(most)


def short_circuit(samples: DataFrame) -> DataFrame:
    """``samples`` (id, expected: answers, prediction) with answered: an expected answer of any length stands in the
    prediction, both without layout, so that no check is needed."""
    p = T.answer_norm(F.col("prediction"))
    return samples.withColumn("answered", F.exists(F.transform("expected", T.answer_norm), lambda e: (e != "") & F.contains(p, e)))
