"""Queries over nested catalogs, algebra of formulas, sweeps over grids and evaluation sets; each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import assembly as E
from ..operators import formulas as M
from ..operators import sweep as W
from ..operators import trees as N
from ..operators.roles import RULES_SQL, rules, table
from . import retrieval as R


def _catalogs(spark: SparkSession, d: str) -> DataFrame:
    """The rules as JSON catalogs of one topic each: even topics are flat, odd ones are trees in which every third dozen of rules
    opens a level, so that depth differs by topic and grows with it."""
    r = rules(spark, d).withColumn("j", F.to_json(F.struct("rule_id", "trigger", "check_logic")))
    key = [F.concat_ws("/", "domain", "topic", F.floor(F.col("rule_no") / 200)).alias("catalog"), "domain", "topic"]
    last_first = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("rule_no").alias("no"), "j"))))
    own = r.groupBy(*key).agg(last_first.alias("r"))
    rest = lambda acc: F.when(acc == "", "").otherwise(F.concat(F.lit(","), acc))
    node = lambda acc, x: F.when(F.floor(x["no"] / 12) % 3 == 0, F.concat(F.lit('{"rule":'), x["j"], F.lit(',"children":['), acc, F.lit("]}"))).otherwise(F.concat(F.lit('{"rule":'), x["j"], F.lit("}"), rest(acc)))
    tree = F.concat(F.lit('"rules":[7],"rule_tree":{"children":['), F.aggregate("r", F.lit(""), node), F.lit("]}"))
    flat = F.concat(F.lit('"rules":['), F.array_join(F.transform(F.reverse("r"), lambda x: x["j"]), ","), F.lit("]"))
    body = F.when(F.substring("topic", 2, 9).cast("int") % 2 == 0, flat).otherwise(tree)
    return own.select("catalog", F.concat(F.lit('{"domains":[null,{"name":"'), "domain", F.lit('","topics":[{"name":"'), "topic", F.lit('",'), body, F.lit("}]}]}")).alias("json"))


def rule_leaves(spark: SparkSession, d: str) -> DataFrame:
    return N.rule_leaves(_catalogs(spark, d)).select("catalog", "domain", "topic", F.col("ordinal").cast("long").alias("ordinal"), "rule_id", F.md5("description").alias("description_md5"))


def found_rules(spark: SparkSession, d: str) -> DataFrame:
    """The first rule of a catalog with an id that is asked for, wherever it lies in it."""
    asked = rules(spark, d).where("rule_no % 5 = 0").select("rule_id")
    return N.find_rules(N.rule_leaves(_catalogs(spark, d)), asked).select("catalog", "rule_id", "domain", "topic")


_THRESHOLDS, _PENALTIES = [8.0, 2.0, 4.0, 6.0], [0.0, 1.0, 2.5]


def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every setting of a grid with its objective, the best one first."""
    return W.sweep(R._context(spark, d), _THRESHOLDS, _PENALTIES)


#: Formulas of texts: each shape in several forms, of which the first is the catalog's.
_SHAPES = [
    ["F = {k} m a", r"a = \frac{{F}}{{{k} m}}", "m = F / ({k} a)", r"\frac{{F}}{{m a}} = {k}"],
    [r"T = {k} \pi \sqrt{{L / g}}", r"T = {k}\pi \sqrt{{\frac{{L}}{{g}}}}"],
    [r"E_k = \frac{{{k}}}{{2}} m v^2", "2 E_k = {k} m v^2"],
    ["y = {k} x + b", "b = y - {k} x"],
]


def _written(spark: SparkSession, d: str) -> DataFrame:
    """(key, shape, k, form, formula): the formulas that documents are taken to hold, by id and length of their texts."""
    no, n = F.col("doc_id"), F.length(F.coalesce("text", F.lit("")))
    forms = F.array(*(F.array(*(F.lit(x.format(k="@")) for x in shape)) for shape in _SHAPES))
    shape, k = no % len(_SHAPES), 2 + n % 3
    own = F.element_at(forms, (shape + 1).cast("int"))
    at = (n % F.size(own)).cast("int")
    return table(spark, d, "documents").select(no.alias("key"), shape.alias("shape"), k.alias("k"), at.alias("form"), F.replace(F.get(own, at), F.lit("@"), k.cast("string")).alias("formula"))


def formula_classes(spark: SparkSession, d: str) -> DataFrame:
    """The distinct formulas that the texts state, with their number, and the class of equal ones."""
    stated = A.formulas(_written(spark, d).select("key", "formula"), "key", "formula").select(F.col("raw").alias("formula"))
    whole = _written(spark, d).select("formula")
    return M.formula_classes(whole.unionByName(stated))


def equivalent_forms(spark: SparkSession, d: str) -> DataFrame:
    """The formulas of the texts that equal a form of the catalog, in whatever way they are written."""
    w = _written(spark, d)
    forms = w.select("shape", "k").distinct().withColumn("form", F.replace(F.element_at(F.array(*(F.lit(s[0].format(k="@")) for s in _SHAPES)), (F.col("shape") + 1).cast("int")), F.lit("@"), F.col("k").cast("string")))
    return M.equivalent(w.select("key", "formula"), forms.select(F.concat_ws("/", "shape", "k").alias("form_id"), "form")).select("key", "form_id")


def power_laws(spark: SparkSession, d: str) -> DataFrame:
    """Exponents by which the first name of a formula depends on each of the others."""
    seen = _written(spark, d).groupBy("formula").agg(F.count("*").alias("n")).withColumn("postfix", M.postfix("formula"))
    named = seen.withColumn("names", M.names(F.col("postfix")))
    pairs = named.select("formula", "n", "postfix", F.explode("names").alias("dependent"), "names").select("formula", "n", "postfix", "dependent", F.explode("names").alias("independent")).where("dependent <> independent")
    return M.power_laws(pairs).select("formula", "n", "dependent", "independent", "exponent")


_SETS = [("recall", 12, ["wrong"]), ("precision", 25, ["relaxed", "strict"]), ("smoke", 9, ["strict", "wrong"])]


def _pools(spark: SparkSession, d: str) -> DataFrame:
    pool = F.when(F.col("quality") == 0, "wrong").when(F.col("toxic") == 1, "relaxed").otherwise("strict")
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("stratum"))
    return docs.join(table(spark, d, "labels"), "doc_id").select(F.col("doc_id").alias("id"), pool.alias("pool"), "stratum")


def eval_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Disjoint evaluation sets of exact sizes, in proportion to the languages."""
    return E.assemble(_pools(spark, d), _SETS, seed=11).select("set", "id", "pool", "stratum")


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """The texts at the indices of two splits, found by their index."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("global_index"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    wanted = table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "test").otherwise("validation").alias("split"), F.col("doc_id").alias("global_index")).where("global_index % 3 = 0")
    return E.collect_splits(docs, wanted).select("split", "global_index", "text_md5")


def _assembly_sql(sets: list[tuple[str, int, list[str]]], seed: int) -> str:
    steps, drawn = ["c0 AS (SELECT pool, stratum, count(*) AS n, 0::BIGINT AS taken FROM p GROUP BY ALL)"], []
    for i, (name, size, pools) in enumerate(sets):
        order = " ".join(f"WHEN pool = '{p}' THEN {k}" for k, p in enumerate(pools))
        steps += [
            f"o{i} AS (SELECT *, CASE {order} END AS o, n - taken AS room FROM c{i})",
            f"t{i} AS (SELECT o, sum(room) AS total, greatest(0, least(sum(room), {size} - coalesce(sum(sum(room)) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS share FROM o{i} WHERE o IS NOT NULL GROUP BY o)",
            f"s{i} AS (SELECT o{i}.*, coalesce(share * room // nullif(total, 0), 0) AS base, coalesce(share * room % nullif(total, 0), 0) AS rest, coalesce(share, 0) AS share FROM o{i} LEFT JOIN t{i} USING (o))",
            f"k{i} AS (SELECT *, base + (row_number() OVER (PARTITION BY pool ORDER BY rest DESC, stratum) <= share - sum(base) OVER (PARTITION BY pool))::BIGINT AS k FROM s{i})",
            f"c{i + 1} AS (SELECT pool, stratum, n, taken + k AS taken FROM k{i})",
        ]
        drawn.append(f"SELECT '{name}' AS \"set\", ranked.id, pool, stratum FROM ranked JOIN k{i} USING (pool, stratum) WHERE r > taken AND r <= taken + k")
    return f"""WITH p AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'wrong' WHEN toxic = 1 THEN 'relaxed' ELSE 'strict' END AS pool, lang AS stratum FROM documents JOIN labels USING (doc_id)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY pool, stratum ORDER BY ('0x' || substr(md5('{seed}:' || id), 1, 15))::BIGINT, id) AS r FROM p), {", ".join(steps)} {" UNION ALL ".join(drawn)}"""


_LEAVES = f"""{RULES_SQL}, leaves AS (SELECT domain || '/' || topic || '/' || (rule_no // 200) AS catalog, domain, topic, row_number() OVER (PARTITION BY domain, topic, rule_no // 200 ORDER BY rule_no) - 1 AS ordinal, rule_id, rule_no,
    concat_ws(chr(10), CASE WHEN "trigger" <> '' THEN 'Trigger: ' || "trigger" END, CASE WHEN check_logic <> '' THEN 'Check Logic: ' || check_logic END) AS description FROM rules)"""
_GRID = ", ".join(f"({t}::DOUBLE, {p}::DOUBLE, {i})" for i, (t, p) in enumerate((t, p) for t in _THRESHOLDS for p in _PENALTIES))

FUNCTIONS = [rule_leaves, found_rules, sweep_grid, formula_classes, equivalent_forms, power_laws, eval_assembly, split_rows]
SQL = {
    "rule_leaves": f"WITH {_LEAVES} SELECT catalog, domain, topic, ordinal, rule_id, md5(description) AS description_md5 FROM leaves",
    "found_rules": f"WITH {_LEAVES} SELECT catalog, rule_id, domain, topic FROM leaves WHERE rule_no % 5 = 0",
    "sweep_grid": f"""{R._C}, grid(threshold, penalty, i) AS (VALUES {_GRID}),
        j AS (SELECT id, threshold, penalty, i, topic_rank, generic_only, min(margin) OVER (PARTITION BY id, i) <= 0.5 AS low, score - CASE WHEN topic_rank > 1 THEN penalty ELSE 0 END >= threshold AS ok FROM context, grid),
        n AS (SELECT threshold, penalty, i, count(*) FILTER (ok) AS n_published, count(DISTINCT id) FILTER (ok) AS n_samples, count(DISTINCT id) FILTER (ok AND topic_rank > 1) AS n_outside,
            count(DISTINCT id) FILTER (ok AND topic_rank > 1 AND low) AS n_low_margin, count(DISTINCT id) FILTER (ok AND generic_only) AS n_generic, count(DISTINCT id) AS total FROM j GROUP BY ALL),
        o AS (SELECT *, round(n_outside / total + 0.5 * n_low_margin / total + 0.25 * n_generic / total, 9) AS objective FROM n)
        SELECT threshold, penalty, n_published, n_samples, n_outside, n_low_margin, n_generic, objective, row_number() OVER (ORDER BY objective, i) AS place FROM o""",
    # equality holds by the shape that a formula was written from, which the query does not know
    "equivalent_forms": "SELECT doc_id AS key, (doc_id % 4) || '/' || (2 + length(coalesce(text, '')) % 3) AS form_id FROM documents",
    "eval_assembly": _assembly_sql(_SETS, 11),
    "split_rows": """SELECT CASE WHEN toxic = 1 THEN 'test' ELSE 'validation' END AS split, doc_id AS global_index, md5(coalesce(text, '')) AS text_md5 FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 = 0""",
}
