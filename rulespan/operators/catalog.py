"""Topics and rules by judgments, bridged and bottom-up checks, and building, clustering and grading of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut

# Penalties of the quality score, as (metric, per unit, at most) and as (metric, holds, penalty).
PER_UNIT = [("summary_problems", 1, 20), ("missing_logic", 1, 20), ("proposal_failures", 1, 5), ("empty_samples", 3, 10), ("broad_samples", 2, 8)]
OUTRIGHT = [("clustered_ratio", "< 0.6", 15), ("unclustered_topics", "> 30", 10), ("duplicate_groups", "> 100", 5), ("semantic_errors", "> 0", 20)]
LEVELS = [["domain"], ["domain", "topic"], ["domain", "topic", "cluster_id"], ["domain", "topic", "cluster_id", "rule_id"]]


def classify_topics(answers: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, domain, topic) for ``answers`` of the same columns: the first of ``topics`` (domain, topic, place) with that
    name in that domain, else with that name anywhere, else nulls. An empty domain fits all."""
    named = topics.select("topic", F.col("domain").alias("__d"), "place")
    elsewhere = ~((F.coalesce("domain", F.lit("")) == "") | (F.col("domain") == F.col("__d")))
    best = F.min(F.when(F.col("__d").isNotNull(), F.struct(elsewhere.alias("e"), "place", F.col("__d").alias("d"), "topic")))
    return answers.join(named, "topic", "left").groupBy("id").agg(best.alias("b")).select("id", F.col("b.d").alias("domain"), F.col("b.topic").alias("topic"))


def navigate_tree(catalog: DataFrame, judgments: list[DataFrame]) -> DataFrame:
    """(id, level, place, domain, topic, cluster_id, rule_id, score) of the nodes that judgments select.

    ``judgments`` has one table per level, from domains to rules: id, the level's keys, relevant, score. A judgment
    counts if it is relevant, its node is in ``catalog`` (domain, topic, cluster_id, rule_id), and the node above was
    selected for the same sample. Scores are clamped to 0 and 1; a node judged twice counts with the better one.
    """
    above, out = None, None
    for level, (keys, judged) in enumerate(zip(LEVELS, judgments, strict=True)):
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("score").cast("double"), F.lit(0.0))))
        chosen = judged.where("relevant").select("id", *keys, score.alias("score")).join(catalog.select(*keys).distinct(), keys, "left_semi")
        if above is not None:
            chosen = chosen.join(above.select("id", *keys[:-1]), ["id", *keys[:-1]], "left_semi")
        above = cut(chosen.groupBy("id", *keys).agg(F.max("score").alias("score")), f"level{level}")  # read by its rows and by the next level
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), *keys))
        rows = above.select("id", F.lit(level).alias("level"), place.alias("place"), *(F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in LEVELS[-1]), "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def _first_checks(checks: DataFrame, limit: int) -> DataFrame:
    """``checks`` (rule_id, domain, topic, place): the first ``limit`` of each topic."""
    rank = F.row_number().over(Window.partitionBy("domain", "topic").orderBy("place", "rule_id"))
    return checks.withColumn("__r", rank).where(F.col("__r") <= max(1, limit)).drop("__r")


def topic_bridge(diagnostics: DataFrame, rules: DataFrame, checks: DataFrame, results: DataFrame, limit: int = 4) -> DataFrame:
    """(sample, pos, rule_id, bridge_rule_id, result, symbolic_result, attached): checks of the same topic for
    diagnostics whose rule has no check of its own.

    Only a failing check corroborates; one that passes says nothing about another rule and is inconclusive.
    ``diagnostics`` (sample, pos, rule_id), ``rules`` (rule_id, domain, topic), ``results`` (sample, rule_id, result).
    """
    own = diagnostics.join(checks.select("rule_id"), "rule_id", "left_anti").join(rules.select("rule_id", "domain", "topic"), "rule_id")
    near = _first_checks(checks, limit).select("domain", "topic", F.col("rule_id").alias("bridge_rule_id"))
    ran = results.select("sample", F.col("rule_id").alias("bridge_rule_id"), "result")
    fails = F.col("result") == "fail"
    both = own.join(near, ["domain", "topic"]).join(ran, ["sample", "bridge_rule_id"])
    return both.select("sample", "pos", "rule_id", "bridge_rule_id", "result", F.when(fails, "fail").otherwise("inconclusive").alias("symbolic_result"), fails.alias("attached"))


def _anchors(x: Column) -> Column:
    """A text, what stands before its first colon, and its first 80 characters."""
    x = F.trim(F.coalesce(x, F.lit("")))
    return F.array(x, F.trim(F.substring_index(x, ":", 1)), F.trim(F.substring(x, 1, 80)))


def anchored(text: Column, evidence: Column, message: Column, keywords: Column, low: Column | None = None) -> Column:
    """The first of a check's evidence, its message and six keywords of three or more characters that stands in a text, as it
    is or without regard to case, with six or more characters; else null. ``low``: the text in lower case, if it is at hand."""
    low = F.lower(text) if low is None else low
    words = F.slice(F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: F.length(k) >= 3), 1, 6)
    ascii_only = lambda c: F.octet_length(c) == F.length(c)  # noqa: E731  (what holds such a one holds it in lower case too)
    stands = lambda c: (F.length(c) >= 6) & (F.contains(low, F.lower(c)) | (~ascii_only(c) & F.contains(text, c)))
    return F.get(F.filter(F.array_distinct(F.concat(_anchors(evidence), _anchors(message), words)), stands), F.lit(0))


def bottom_up(samples: DataFrame, topics: DataFrame, checks: DataFrame, results: DataFrame, covered: DataFrame, keywords: DataFrame, limit: int = 0) -> DataFrame:
    """(sample, rule_id, severity, message, quote, start, published): failing checks of a sample's topics that no
    diagnostic covers.

    A check is published as a warning if its evidence, else its message, else one of its rule's first six keywords of
    three or more characters stands in the text (``samples``: sample, text), as it is or without regard to case, with
    six or more characters. ``topics`` (sample, domain, topic), ``results`` (sample, rule_id, result, evidence, message),
    ``covered`` (sample, rule_id), ``keywords`` (rule_id, keywords). A ``limit`` above zero takes as many checks of a topic.
    """
    tried = topics.distinct().join(_first_checks(checks, limit) if limit > 0 else checks, ["domain", "topic"]).select("sample", "rule_id").distinct()
    failed = results.where("result = 'fail'").join(tried, ["sample", "rule_id"], "left_semi").join(covered, ["sample", "rule_id"], "left_anti")
    rows = failed.join(samples.select("sample", "text"), "sample").join(keywords.select("rule_id", "keywords"), "rule_id", "left")
    rows = rows.withColumn("__low", F.lower("text")).withColumn("quote", anchored(F.col("text"), F.col("evidence"), F.col("message"), F.col("keywords"), F.col("__low")))
    exact, loose = F.expr("locate(quote, text)"), F.expr("locate(lower(quote), __low)")
    start = F.coalesce(F.when(exact > 0, exact).otherwise(loose) - 1, F.lit(-1))
    message = F.substring(F.concat(F.lit("check failed: "), F.coalesce("message", F.lit(""))), 1, 300)
    return rows.select("sample", "rule_id", F.lit("warning").alias("severity"), message.alias("message"), "quote", start.alias("start"), F.col("quote").isNotNull().alias("published"))


def assign_clusters(rules: DataFrame, claims: DataFrame) -> DataFrame:
    """``rules`` with cluster_id: of the first of ``claims`` (domain, topic, place, label, rule_ids) that names them.

    Claims without a label, or left without rules by earlier ones, do not count. What none names goes to the last claim
    of the topic that counts, or to cluster_general.
    """
    key = ["domain", "topic"]
    named = claims.where("trim(label) <> ''").withColumn("cluster_id", F.concat(F.lit("cluster_"), F.regexp_replace(F.substring(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "_"), 1, 32), "^_+|_+$", "")))
    claimed = named.select(*key, "place", "cluster_id", F.explode("rule_ids").alias("rule_id"))
    first = rules.select(*key, "rule_id").join(claimed, [*key, "rule_id"]).groupBy(*key, "rule_id").agg(F.min(F.struct("place", "cluster_id")).alias("__c"))
    last = first.groupBy(*key).agg(F.max("__c.place").alias("__p"), F.max_by("__c.cluster_id", "__c.place").alias("__l"))
    both = rules.join(first, [*key, "rule_id"], "left").join(last.drop("__p"), key, "left")
    return both.withColumn("cluster_id", F.coalesce("__c.cluster_id", "__l", F.lit("cluster_general"))).drop("__c", "__l")


def label_clusters(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """(domain, topic, place, cluster_id, name, summary, rule_ids): ``clusters`` (domain, topic, place, source_id,
    rule_ids) with the names of ``labels`` (domain, topic, source_id, cluster_id, name, summary), or with plain ones."""
    key = ["domain", "topic", "source_id"]
    place = F.row_number().over(Window.partitionBy("domain", "topic").orderBy("place", "source_id"))
    df = clusters.withColumn("place", place).join(labels.dropDuplicates(key).select(*key, "cluster_id", "name", "summary"), key, "left")
    words = F.initcap(F.array_join(F.slice(F.split(T.norm_text(F.regexp_replace("topic", "[^A-Za-z0-9 ]+", " ")), " "), 1, 5), " "))
    given = lambda c: F.nullif(T.norm_text(F.col(c)), F.lit(""))
    return df.select(
        "domain", "topic", "place", F.coalesce(F.nullif(T.slugify(F.coalesce(given("cluster_id"), F.col("source_id"))), F.lit("")), F.col("source_id")).alias("cluster_id"),
        F.coalesce(given("name"), F.format_string("%s Cluster %02d", words, F.col("place"))).alias("name"),
        F.coalesce(given("summary"), F.format_string("Rules of %s that lie close together.", words)).alias("summary"), F.array_distinct("rule_ids").alias("rule_ids"),
    )


def blueprints(rules: DataFrame, labelled: DataFrame, chunk: int = 12) -> DataFrame:
    """(domain, topic, place, cluster_id, group_id, rule_ids): a group for each of ``labelled`` that has rules, and
    after them the rest of ``rules`` (domain, topic, rule_no, rule_id) in groups of ``chunk``, so that none is large."""
    key = ["domain", "topic"]
    groups = labelled.where(F.size("rule_ids") > 0).select(*key, "place", "cluster_id", F.concat("cluster_id", F.lit("_rules")).alias("group_id"), "rule_ids")
    rest = rules.join(groups.select(*key, F.explode("rule_ids").alias("rule_id")), [*key, "rule_id"], "left_anti")
    no = F.ceil(F.row_number().over(Window.partitionBy(*key).orderBy("rule_no", "rule_id")) / chunk).cast("int")
    chunks = rest.withColumn("__n", no).groupBy(*key, "__n").agg(F.array_sort(F.collect_list(F.struct("rule_no", "rule_id"))).alias("m"))
    cluster = F.format_string("residual_rules_%02d", F.col("__n"))
    last = groups.groupBy(*key).agg(F.max("place").alias("__last"))
    chunks = chunks.join(last, key, "left").select(*key, (F.coalesce("__last", F.lit(0)) + F.col("__n")).alias("place"), cluster.alias("cluster_id"), F.concat(cluster, F.lit("_checks")).alias("group_id"), F.transform("m", lambda x: x["rule_id"]).alias("rule_ids"))
    return groups.unionByName(chunks)


def navigation(rules: DataFrame) -> DataFrame:
    """(domain, topic, n_rules, clusters): one row per topic; clusters are nested (cluster_id, groups of (group_id, rules
    of (rule_id, title, trigger, check_logic, error_type))), each in order of its id."""
    leaf = F.struct("rule_id", "title", "trigger", "check_logic", "error_type")
    groups = rules.groupBy("domain", "topic", "cluster_id", "group_id").agg(F.array_sort(F.collect_list(leaf)).alias("rules"))
    clusters = groups.groupBy("domain", "topic", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("group_id", "rules"))).alias("groups"), F.sum(F.size("rules")).alias("n"))
    return clusters.groupBy("domain", "topic").agg(F.sum("n").alias("n_rules"), F.array_sort(F.collect_list(F.struct("cluster_id", "groups"))).alias("clusters"))


def build_catalog(skeleton: DataFrame, rules: DataFrame) -> DataFrame:
    """``rules`` with the topic of ``skeleton`` (domain, topic) that they belong to, by folded names, and orphan.

    Rules that agree in topic, title, trigger and logic become one, the first, with their summed support and their
    number. A rule without a topic in the skeleton is an orphan and keeps its own names.
    """
    fold = lambda c: T.fold(T.norm_text(F.col(c)))
    keyed = rules.withColumns({"__d": fold("domain"), "__t": fold("topic"), "__f": F.sha1(F.concat_ws("|", *(fold(c) for c in ("title", "trigger", "check_logic"))))})
    one = keyed.groupBy("__d", "__t", "__f").agg(F.min_by(F.struct(*rules.columns), "rule_no").alias("__r"), F.sum("support").alias("__s"), F.count("*").alias("n_merged"))
    topics = skeleton.select(fold("domain").alias("__d"), fold("topic").alias("__t"), F.struct("domain", "topic").alias("__k")).groupBy("__d", "__t").agg(F.min("__k").alias("__k"))
    both = one.join(topics, ["__d", "__t"], "left")
    replaced = {"domain": F.coalesce("__k.domain", "__r.domain"), "topic": F.coalesce("__k.topic", "__r.topic"), "support": F.col("__s")}
    return both.select(*(replaced.get(c, F.col(f"__r.{c}")).alias(c) for c in rules.columns), "n_merged", F.col("__k").isNull().alias("orphan"))


def quality_metrics(rules: DataFrame, runtime: DataFrame | None = None, shortest: int = 12, longest: int = 160, most_rules: int = 5) -> DataFrame:
    """(metric, value) of ``rules`` (domain, topic, summary, trigger, check_logic, clustered) and of ``runtime`` (sample,
    n_topics, n_clusters, n_rules, failed): one row each, so that no table has to be joined to another."""
    number = F.length(T.norm_text(F.col("summary")))
    blank = lambda c: T.norm_text(F.col(c)) == ""
    per = rules.groupBy("domain", "topic").agg(
        F.count("*").alias("rules"), F.count_if("clustered").alias("clustered"), F.count_if(number == 0).alias("missing"), F.count_if((number > 0) & (number < shortest)).alias("short"),
        F.count_if(number > longest).alias("long"), F.count_if(blank("trigger")).alias("no_trigger"), F.count_if(blank("check_logic")).alias("no_logic"),
    )
    total = lambda *names: sum((F.coalesce(F.sum(n), F.lit(0)) for n in names), F.lit(0))
    values = {
        "n_rules": total("rules"), "n_topics": F.count("*"), "summary_problems": total("missing", "short", "long"), "missing_logic": total("no_trigger", "no_logic"),
        "clustered_ratio": F.when(total("rules") > 0, total("clustered") / total("rules")).otherwise(0.0), "unclustered_topics": F.count_if(F.col("clustered") == 0),
    }
    long = lambda df, v: df.agg(*(x.cast("double").alias(n) for n, x in v.items())).select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in v))).alias("m")).select("m.*")
    repeated = rules.where(number > 0).groupBy(T.fold(T.norm_text(F.col("summary"))).alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    out = long(per, values).unionByName(long(repeated, {"duplicate_groups": F.count("*")}))
    if runtime is None:
        return out
    broad = (F.col("n_rules") > most_rules) | (F.col("n_topics") > 2) | (F.col("n_clusters") > 3)
    return out.unionByName(long(runtime, {"semantic_errors": F.count_if("failed"), "empty_samples": F.count_if(F.col("n_rules") == 0), "broad_samples": F.count_if(broad)}))


def quality_score(metrics: DataFrame) -> DataFrame:
    """(score, n_issues, ready): 100 less the penalties of ``metrics``, not below 0; ready without empty or failed samples."""
    m, v = F.col("metric"), F.col("value")
    penalty = F.when(F.lit(False), 0.0)
    for name, unit, most in PER_UNIT:
        penalty = penalty.when(m == name, F.least(F.lit(float(most)), v * unit))
    for name, holds, points in OUTRIGHT:
        penalty = penalty.when((m == name) & F.expr(f"value {holds}"), float(points))
    rows = metrics.withColumn("p", penalty.otherwise(0.0))
    blocked = F.count_if(m.isin("semantic_errors", "empty_samples") & (v > 0))
    return rows.agg(F.greatest(F.lit(0.0), 100 - F.coalesce(F.sum("p"), F.lit(0.0))).alias("score"), F.count_if(F.col("p") > 0).alias("n_issues"), (blocked == 0).alias("ready"))
