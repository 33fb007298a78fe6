"""Allow and block verdicts for urls: explicit rules first, then a learned path-template tree. DataFrame functions only.

The tree is built on counts, never on pages: pages are first summed per host and path. Level by level, the segments
below one template of a host are literal branches, unless they vary too much, and then one wildcard. Branches of one
parent with like labelled shares of blocked pages are merged, if a test of homogeneity does not tell them apart. The
levels go on until every url is alone under its template or at its end. A template's purity is its labelled share
smoothed towards the same template over all hosts, which is smoothed towards the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Bytes of judged urls that may be broadcast; beyond them the join is shuffled, and hot urls are dealt to SALT tasks.
MOST_BYTES, SALT = 32_000_000, 16


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null. A rule is (verdict, host/path); it fits its host
    and all subdomains if the path starts with the rule's. Of equally long rules block wins, then the first by name."""
    chosen = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        own_host, slash, rest = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, found) if chosen is None else chosen.when(fits, found)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _kind(segment: Column) -> Column:
    """A segment with its evident variables replaced: numbers, hex strings, dates and long slugs."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "{number}")
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), "{hex}")
        .when(segment.rlike(r"^[^-_]+([-_][^-_]+){3,}$"), "{slug}")
        .otherwise(segment)
    )


def segments(path: Column) -> Column:
    """The path's segments, evident variables replaced."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), _kind)


def template_tree(urls: DataFrame, max_children: int = 8, max_share: float = 0.5, z: float = 1.96, width: float = 0.5) -> DataFrame:
    """``urls`` (host, s, n, labelled, blocked) with template, for segments ``s`` of any number.

    A level of a parent becomes ``*`` where it has more than ``max_children`` children and more than ``max_share``
    children per page. Else its labelled branches are grouped by share, in steps of ``width`` of its arcsine; a group of
    two or more becomes one branch, named ``*`` and its step, if the chi-square of the shares inside it lies within ``z``
    standard deviations of what chance gives. Urls alone under their template are done: nothing below can vary or
    merge. Each level is written, so that a plan holds one level only.
    """
    key, done, level = ["host", "template"], None, 0
    active = urls.withColumn("template", F.lit(""))
    while True:
        alone = active.groupBy(*key).agg(F.count("*").alias("__k"))
        active = active.join(alone, key)
        ends = (F.size("s") <= level) | (F.col("__k") == 1)
        rest = F.slice("s", level + 1, F.greatest(F.size("s") - level, F.lit(0)))
        finished = active.where(ends).withColumn("template", F.concat("template", F.when(F.size(rest) > 0, F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise(""))).drop("__k")
        finished = cut(finished, "templates-done")
        done = finished if done is None else done.unionByName(finished)
        active = active.where(~ends).drop("__k").withColumn("__seg", F.get("s", F.lit(level)))
        child = cut(active.groupBy(*key, "__seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b")), "branches")
        if child.isEmpty():
            return done
        parent = child.groupBy(*key).agg(F.count("*").alias("children"), F.sum("n").alias("pages"))
        step = F.when(F.col("l") > 0, F.floor(2 * F.asin(F.sqrt(F.col("b") / F.col("l"))) / width).cast("int"))
        child = child.withColumn("__step", step)
        like = child.where("l > 0").groupBy(*key, "__step").agg(F.count("*").alias("k"), F.sum("l").alias("gl"), F.sum("b").alias("gb"), F.sum(F.col("b") * F.col("b") / F.col("l")).alias("sq"))
        share = F.col("gb") / F.col("gl")
        chi = (F.col("sq") - F.col("gb") * share) / F.greatest(share * (1 - share), F.lit(0.01))
        like = like.where((F.col("k") > 1) & (chi <= F.col("k") - 1 + z * F.sqrt(2 * (F.col("k") - 1)))).select(*key, "__step", F.lit(True).alias("__like"))
        varies = (F.col("children") > max_children) & (F.col("children") > max_share * F.col("pages"))
        part = F.when(varies, "*").when(F.col("__like"), F.concat(F.lit("*"), F.col("__step"))).otherwise(F.col("__seg"))
        named = child.join(parent, key).join(like, [*key, "__step"], "left").select(*key, "__seg", F.concat("template", F.lit("/"), part).alias("__next"))
        active = cut(active.join(named, [*key, "__seg"]).withColumn("template", F.col("__next")).drop("__seg", "__next"), "tree")
        level += 1


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", weight: float = 4.0, most: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity.

    Labels of the tree are the verdicts of the rules; where no rule fits, the verdict is block if the template's
    smoothed share of blocked pages exceeds ``most``, else allow. A null url or one without ``://`` has an empty host
    and path and the tree of that host. Urls of any length and depth count whole. Columns of ``pages`` with the names of
    results are replaced; repeated rows are kept, and an empty table gives an empty result.
    """
    made = ["host", "path", "rule", "verdict", "template", "purity"]
    own = [c for c in pages.columns if c not in made]
    url = F.col(url_col).cast("string")
    df = pages.select(F.struct(*own).alias("__own"), host_of(url).alias("host"), path_of(url).alias("path"))
    df = df.withColumn("__rule", rule_verdict(F.col("host"), F.col("path"), rules)).withColumn("s", segments(F.col("path")))
    urls = df.groupBy("host", "s").agg(F.count("*").alias("n"), F.count("__rule.verdict").alias("labelled"), F.count_if(F.col("__rule.verdict") == "block").alias("blocked"))
    tree = template_tree(cut(urls, "urls"))

    total = tree.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.sum(F.length("host") + F.length(F.array_join("s", "//")) + F.length("template") + 64).alias("size")).first()
    prior = min((total["b"] or 0) / total["l"], most) if total["l"] else 0.0  # no template is rejected without labels of its own
    smooth = lambda b, n, towards: (b + weight * towards) / (n + weight)
    everywhere = tree.groupBy("template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).select("template", smooth(F.col("b"), F.col("l"), F.lit(prior)).alias("shared"))
    here = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    purity = here.join(everywhere, "template").select("host", "template", smooth(F.col("b"), F.col("l"), F.col("shared")).alias("purity"))
    judged = cut(tree.join(purity, ["host", "template"]).select("host", "s", "template", "purity"), "templates")
    if (total["size"] or 0) <= MOST_BYTES:
        both = df.join(F.broadcast(judged), ["host", "s"], "left")
    else:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")
        dealt = judged.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = df.withColumn("__salt", salt).join(dealt, ["host", "s", "__salt"], "left")
    learned = F.when(F.col("purity") > most, "block").otherwise("allow")
    return both.select(*(F.col("__own")[c].alias(c) for c in own), "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", learned).alias("verdict"), "template", "purity")
