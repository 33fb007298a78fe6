"""Diagnostics, evaluation, catalog, graph, vector and sampling operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 and accuracy, over all rows or for each group of ``by``."""
    count = lambda c, name: F.count_if(c).alias(name)
    n = df.groupBy(*(by or [])).agg(count(predicted & actual, "tp"), count(predicted & ~actual, "fp"), count(~predicted & actual, "fn"), count(~predicted & ~actual, "tn"))
    c = F.col
    p, r = ratio(c("tp"), c("tp") + c("fp")), ratio(c("tp"), c("tp") + c("fn"))
    return n.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), F.round(ratio(c("tp") + c("tn"), c("tp") + c("fp") + c("fn") + c("tn")), 6).alias("accuracy"))


def dedupe_best(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def capped(df: DataFrame, sample: str, paragraph: str, order: list[Column], per_paragraph: int, per_sample: int, only: Column | None = None) -> DataFrame:
    """``df`` with dropped: null, over_paragraph_cap or over_sample_cap. A cap of zero or less is off. Of rows where ``only`` is
    not true nothing is dropped, and they count for no cap."""
    big = 2**31 - 1
    p, s = (x if x > 0 else big for x in (per_paragraph, per_sample))
    df = df.withColumn("__in", F.lit(True) if only is None else F.coalesce(only, F.lit(False)))
    counts = F.col("__in") & (F.col("__p") <= p)
    df = df.withColumn("__p", F.row_number().over(Window.partitionBy(sample, "__in", paragraph).orderBy(*order)))
    df = df.withColumn("__s", F.when(counts, F.row_number().over(Window.partitionBy(sample, counts).orderBy(*order))))
    keep = F.coalesce(F.col("__s") <= s, F.lit(False))
    kept = F.count_if(keep).over(Window.partitionBy(sample, "__in", paragraph))
    return df.withColumn("dropped", F.when(keep | ~F.col("__in"), None).when(kept >= p, "over_paragraph_cap").otherwise("over_sample_cap")).drop("__in", "__p", "__s")


def normal_form(x: Column) -> Column:
    """Lower case without layout commands and signs, for loose comparison of symbols."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\\[a-z]+", " "), r"[\\{}$^_~`\s]+", " "))


def token_present(token: Column, low: Column, norm: Column, own: Column | None = None) -> Column:
    """Whether a symbol stands in a text; short ones only between signs that are no letters or digits. ``own``: the symbol's
    normal form, if it is at hand."""
    t, n = F.lower(token), normal_form(token) if own is None else own
    short = (F.length(F.regexp_replace(n, "[^a-z0-9]", "")) <= 3) & (n != "")
    bounded = F.contains(norm, n) & F.regexp_like(norm, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), n, F.lit(r"\E([^a-z0-9]|$)")))
    return F.when(t == "", False).when(short, bounded).otherwise(F.contains(low, t) | ((n != "") & F.contains(norm, n)))


def required_symbols(df: DataFrame, text: str, symbols: str) -> DataFrame:
    """``df`` with result: pass if all symbols are present, fail if none is, else inconclusive."""
    low, norm = F.lower(text), normal_form(F.col(text))
    n = F.size(F.filter(symbols, lambda s: token_present(s, low, norm)))
    result = F.when(F.size(symbols) == 0, "inconclusive").when(n == F.size(symbols), "pass").when(n == 0, "fail").otherwise("inconclusive")
    return df.withColumn("n_present", n).withColumn("result", result)


def read_once(df: DataFrame, text: str) -> DataFrame:
    """``df`` with low and norm, a text in lower case and in normal form, for :func:`primitive`: made once for a text, before it
    meets its primitives."""
    own = F.coalesce(text, F.lit(""))
    return df.withColumns({"low": F.lower(own), "norm": normal_form(own)})


def primitive(df: DataFrame, text: str) -> DataFrame:
    """``df`` with result, of its primitive on a text: pass, fail or inconclusive. What :func:`read_once` adds is used if it is there.

    Columns: primitive, required_symbols, canonical, dependent, independent, phrases (arrays). formula_pattern passes if all
    symbols are there; equation_equivalence and inequality_consistency if a canonical form of four or more characters
    stands in the text, and fail if two thirds of the symbols (two at least) do without it; power_law fails if only one of
    the two sides is named; compliance_phrase passes on any phrase; required_symbols passes on all symbols, fails on none.
    """
    own = df if {"low", "norm"} <= set(df.columns) else read_once(df, text)
    low, norm = F.col("low"), F.col("norm")
    given = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    here = lambda c: F.filter(given(c), lambda x: token_present(x, low, norm))
    k, n = F.size(given("required_symbols")), F.size(here("required_symbols"))
    form = F.exists(given("canonical"), lambda x: (F.length(normal_form(x)) >= 4) & F.contains(norm, normal_form(x)))
    enough = (k > 0) & (n >= F.greatest(F.lit(2), (k * 0.66).cast("int")))
    dep, ind = F.size(here("dependent")) > 0, F.size(here("independent")) > 0
    said = F.exists(given("phrases"), lambda x: F.contains(low, F.lower(x)))
    p = F.lower(F.trim("primitive"))
    result = (
        F.when(p == "formula_pattern", F.when((k > 0) & (n == k), "pass"))
        .when(p.isin("equation_equivalence", "inequality_consistency"), F.when(form, "pass").when(enough, "fail"))
        .when(p == "power_law", F.when(dep != ind, "fail"))
        .when(p == "compliance_phrase", F.when(said, "pass"))
        .when(p == "required_symbols", F.when((k > 0) & (n == k), "pass").when((k > 0) & (n == 0), "fail"))
    )
    return own.select(*df.columns, F.coalesce(result, F.lit("inconclusive")).alias("result"))


def run_checks(samples: DataFrame, checks: dict[str, Callable[[dict], dict]]) -> DataFrame:
    """(id, rule_id, result, message) of every check on every sample; a check that raises or answers oddly is
    inconclusive. The checks are small functions of one sample and run in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                for rule, check in checks.items():
                    try:
                        r = check(row)
                        result, message = r["result"], str(r.get("message") or "")
                        if result not in ("pass", "fail", "inconclusive"):
                            result, message = "inconclusive", f"unknown result {result}"
                    except Exception as e:  # a faulty check must not stop a batch
                        result, message = "inconclusive", f"{type(e).__name__}"
                    out.append((row["id"], rule, result, message))
            yield pd.DataFrame(out, columns=["id", "rule_id", "result", "message"])

    return samples.mapInPandas(run, f"id {samples.schema['id'].dataType.simpleString()}, rule_id string, result string, message string")


def exact_duplicates(rules: DataFrame, key: list[str]) -> DataFrame:
    """One row per folded key: the first rule, how many there are, their summed support and their ids in order."""
    folded = [T.fold(T.norm_text(F.col(k))).alias(f"__{k}") for k in key]
    g = rules.groupBy(*folded).agg(F.min_by("rule_id", "rule_no").alias("rule_id"), F.count("*").alias("n"), F.sum("support").alias("support"), F.array_sort(F.collect_list(F.struct("rule_no", "rule_id"))).alias("m"))
    return g.select("rule_id", "n", F.when(F.col("support") > 0, F.col("support")).otherwise(F.col("n")).alias("support"), F.array_join(F.transform("m", lambda x: x["rule_id"]), ",").alias("members"))


def heuristic_clusters(rules: DataFrame, topic_least: int, bucket_least: int) -> DataFrame:
    """(domain, topic, cluster_id, n): rules of one error type, in topics with enough rules, if they are enough."""
    big = rules.withColumn("__n", F.count("*").over(Window.partitionBy("domain", "topic"))).where(F.col("__n") >= topic_least)
    g = big.groupBy("domain", "topic", "error_type").agg(F.count("*").alias("n")).where(F.col("n") >= bucket_least)
    return g.select("domain", "topic", F.concat(F.lit("cluster_"), T.slugify(F.col("error_type"))).alias("cluster_id"), "n")


#: Vectors of a block: two blocks are compared in one call.
BLOCK = 256


def _blocks(vectors: DataFrame, group: str) -> DataFrame:
    """(group, i, j, id, v, b): each vector in every pair of blocks of its group that its own block ``b`` belongs to, so that a
    group of any size is compared in bounded calls."""
    size = vectors.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__n"))
    own = vectors.select(group, "id", "v").join(size, group).withColumn("b", F.pmod(F.xxhash64("id"), F.col("__n")).cast("int"))
    dealt = own.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return dealt.select(group, F.least("b", "__o").alias("i"), F.greatest("b", "__o").alias("j"), "id", "v", "b")


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """The links of a spanning forest of a symmetric matrix of links, by breadth first search."""
    left, out = np.ones(len(near), bool), []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            m = todo.pop()
            new = np.nonzero(near[m] & left)[0]
            left[new] = False
            out += [(m, n) for n in new]
            todo += new.tolist()
    return out


def cosine_edges(vectors: DataFrame, group: str, least: float, forest: bool = False) -> DataFrame:
    """(group, a, b) of vectors a < b of one group with a cosine of at least ``least``, compared as matrices of blocks.

    With ``forest`` only so many of them that every pair of blocks stays connected as it is: fewer links than vectors.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, b = f["id"].to_numpy(), f["b"].to_numpy()
        x = np.array(f["v"].tolist(), float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm > 0, norm, 1)
        near = np.triu(x @ x.T >= least, 1)
        if f["i"].iloc[0] != f["j"].iloc[0]:
            near &= b[:, None] != b[None, :]
        links = _forest(near | near.T) if forest else zip(*np.nonzero(near), strict=True)
        return pd.DataFrame([(f[group].iloc[0], min(ids[m], ids[n]), max(ids[m], ids[n])) for m, n in links], columns=[group, "a", "b"])

    # One pair of blocks is one call: rows that held whole pairs would reach Python in batches of thousands of pairs.
    kind = {c.name: c.dataType.simpleString() for c in vectors.schema}
    return _blocks(vectors, group).groupBy(group, "i", "j").applyInPandas(run, f"`{group}` {kind[group]}, a {kind['id']}, b {kind['id']}")


def topic_components(vectors: DataFrame, group: str, least: float) -> DataFrame:
    """(group, id, component): connected components of the threshold graph of each group, by the smallest id.

    Labels spread over forests of :func:`cosine_edges` and jump to the label of their label, until none changes; each
    round is two equi-joins and is written to the shared folder, so that a lost executor costs one round.
    """
    keep = lambda df: cut(df, "components")
    e = cosine_edges(vectors, group, least, forest=True).select("a", "b")
    e = keep(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = keep(vectors.select("id", F.col("id").alias("label")))
    while True:
        low = e.join(label, e["b"] == label["id"]).groupBy("a").agg(F.min("label").alias("low"))
        step = label.join(low, label["id"] == low["a"], "left").select("id", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = keep(step.join(jump, "label", "left").select("id", F.least("label", "up").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return vectors.select(group, "id").join(new.select("id", F.col("label").alias("component")), "id").select(group, "id", "component")
        label = new.select("id", "label")


def embedding_clusters(components: DataFrame, group: str, least: int = 4, exemplars: int = 5) -> DataFrame:
    """(group, id, cluster_id, place): components of ``least`` members or more, numbered by size and smallest id among all
    components of the group, with each member's place and, for the first ``exemplars``, the mark of an example; a member
    of a smaller one has a null cluster."""
    size = components.groupBy(group, "component").agg(F.count("*").alias("n"))
    no = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "component"))
    named = size.withColumn("__no", no).select(group, "component", F.when(F.col("n") >= least, F.format_string("embedding_cluster_%02d", no)).alias("cluster_id"))
    place = F.row_number().over(Window.partitionBy(group, "component").orderBy("id"))
    df = components.withColumn("place", place).join(named, [group, "component"])
    return df.select(group, "id", "cluster_id", "place", (F.col("cluster_id").isNotNull() & (F.col("place") <= exemplars)).alias("is_example"))


def hash_rank(seed: str, key: Column) -> Column:
    """A reproducible random order: the hexadecimal SHA-1 of seed and key."""
    return F.sha1(F.concat(F.lit(seed), key.cast("string")))


def stratified_splits(df: DataFrame, key: str, by: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """(key, by, split): disjoint splits of fixed size within each stratum, by hash rank; other rows are in none."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(hash_rank(seed, F.col(key)), key))
    bounds, at, split = [], 0, None
    for name, n in sizes.items():
        bounds.append((name, at, at + n))
        at += n
    for name, lo, hi in bounds:
        hit = (F.col("__r") > lo) & (F.col("__r") <= hi)
        split = F.when(hit, name) if split is None else split.when(hit, name)
    return df.select(key, by).withColumn("__r", rank).where(F.col("__r") <= at).select(key, by, split.alias("split"))


#: Signs between the two sides of a relation, and of a definition.
RELATIONS = r"=|<=|>=|<|>|≈|~|∝|≤|≥|\\leq|\\geq|\\le|\\ge"
_CANDIDATE = r"([A-Za-z0-9_\\{}()^+\-*/'., ]{0,100}(?:" + RELATIONS + r")[A-Za-z0-9_\\{}()^+\-*/'., ]{1,120})"
_SYMBOL = r"\\?([a-zA-Z][a-zA-Z0-9_]*)"


def formulas(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, no, raw, relation, lhs, rhs, head, symbols): the relations of each line of a text.

    Parts around a sign of relation count; a line with a sign but without such a part counts whole. The first of
    ``= ≈ ~ ∝`` splits a formula, without one it is all right side. head is the first name on the left, symbols all names
    that look like symbols.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "x")).withColumn("x", F.trim("x")).where(F.col("x").rlike(RELATIONS))
    parts = F.filter(F.transform(F.regexp_extract_all("x", F.lit(_CANDIDATE), F.lit(1)), lambda c: F.btrim(c, F.lit(" .,;:"))), lambda c: c != "")
    f = lines.select(key, "line", F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array("x"))).alias("no", "raw"))
    sign = F.regexp_extract("raw", "[=≈~∝]", 0)
    at = F.locate("~", F.translate("raw", "=≈~∝", "~~~~"))
    f = f.withColumns({"relation": F.when(at > 0, sign).otherwise("unknown"), "lhs": F.when(at > 0, F.trim(F.expr("substring(raw, 1, locate('~', translate(raw, '=≈~∝', '~~~~')) - 1)"))), "rhs": F.when(at > 0, F.trim(F.expr("substring(raw, locate('~', translate(raw, '=≈~∝', '~~~~')) + 1)"))).otherwise(F.col("raw"))})
    return f.withColumns({"head": F.regexp_extract(F.coalesce("lhs", F.lit("")), "[A-Za-z][A-Za-z0-9_]*", 0), "symbols": F.array_sort(F.array_distinct(T.symbols(F.concat_ws(" ", "lhs", "rhs"))))})


def symbol_table(df: DataFrame, key: str, text: str, parsed: DataFrame) -> DataFrame:
    """(key, symbol, n_lines, n_used, n_defined): the symbols of each text, the lines that hold them as whole words, the
    formulas that use them and those that define them (their head)."""
    lines = df.select(key, F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("x"))
    words = F.filter(F.regexp_extract_all("x", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Za-z][A-Za-z0-9_]*$") & T.looks_like_symbol(w))
    named = lines.select(key, F.array_distinct(words).alias("__words"), F.array_distinct(T.symbols(F.col("x"))).alias("__names"))
    # A whole word that looks like a symbol is a symbol of its line: one pass finds both, and counts the lines of whole words only.
    each = lambda c, n: F.transform(c, lambda w: F.struct(w.alias("symbol"), F.lit(n).alias("n")))
    both = F.concat(each(F.col("__words"), 1), each(F.array_except("__names", "__words"), 0))
    found = named.select(key, F.explode(both).alias("f")).groupBy(key, F.col("f.symbol").alias("symbol")).agg(F.sum("f.n").alias("n_lines"))
    used = parsed.select(key, F.explode("symbols").alias("symbol"), (F.array_contains("symbols", F.col("head")) & F.col("lhs").isNotNull()).alias("__d"), "head").groupBy(key, "symbol").agg(F.count("*").alias("n_used"), F.count_if(F.col("__d") & (F.col("head") == F.col("symbol"))).alias("n_defined"))
    return found.join(used, [key, "symbol"], "left").fillna(0, ["n_used", "n_defined"])


def graph_findings(parsed: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, finding, symbol, n): formulas whose head is among several symbols of their own, short or underlined symbols
    that are used twice and never defined, and heads with different right sides."""
    defines = F.col("relation").isin("=", "≈", "~") & (F.col("head") != "")
    itself = F.array_contains("symbols", F.col("head")) & (F.size("symbols") > 1)
    heads = parsed.where(defines).groupBy(key, F.col("head").alias("symbol")).agg(F.count_if(itself).alias("__own"), F.count_distinct(F.when(F.col("rhs") != "", F.col("rhs"))).alias("__many"))
    kinds = F.array(F.struct(F.lit("self_reference").alias("finding"), F.col("__own").alias("n"), F.lit(1).alias("least")), F.struct(F.lit("conflict").alias("finding"), F.col("__many").alias("n"), F.lit(2).alias("least")))
    of_heads = heads.select(key, "symbol", F.explode(F.filter(kinds, lambda k: k["n"] >= k["least"])).alias("f")).select(key, "f.finding", "symbol", "f.n")
    loose = table.where(((F.length("symbol") <= 3) | F.contains("symbol", F.lit("_"))) & (F.col("n_defined") == 0) & (F.col("n_used") >= 2) & (F.col("n_lines") >= 2)).select(key, F.lit("used_not_defined").alias("finding"), "symbol", F.col("n_used").alias("n"))
    return of_heads.unionByName(loose)
