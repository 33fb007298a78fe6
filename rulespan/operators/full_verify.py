"""The whole verification as one plan: selected rules, diagnostics, checks, bridge, reconciliation, gate, caps, bottom-up.

After retrieval a sample is one row: its text, its selected rules, its topics' checks and its diagnostics. Which checks it
needs, their results and what they decide are worked out inside the row. What is decided is dealt by id once more,
without texts, and the last windows are by sample and keep that dealing. Published diagnostics and the log of suppressed
ones are rows of one table, made in the same pass.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import text as T
from . import verify as V
from .analysis import capped
from .catalog import anchored
from .retrieval import small, spread

Checks = dict[str, Callable[[dict], dict]]
_RESULT = ArrayType(StructType().add("rule_id", StringType()).add("result", StringType()).add("message", StringType()).add("evidence", StringType()))
_EMPTY = "array<string>"
#: What a diagnostic and a selected rule have for the gates.
_PER_DIAGNOSTIC = ("pos", "rule", "severity", "message", "quote", "paragraph", "locatable")
_PER_RULE = ("score", "topic_rank", "min_publish_score", "gate_reasons", "evidence_requirements", "negative_conditions", "policy", "required_symbols")


def run_named(checks: Checks):
    """A column function of (id, question, context, prediction, names): the results of the named checks on a sample, in the
    order of the names. Names without a check give nothing; a check that raises or answers oddly is inconclusive."""

    def run(ids: pa.Array, questions: pa.Array, contexts: pa.Array, predictions: pa.Array, names: pa.Array) -> pa.Array:
        found, ends = tuple([] for _ in _RESULT.elementType.fields), [0]
        for i, q, c, p, own in zip(*(x.to_pylist() for x in (ids, questions, contexts, predictions, names)), strict=True):
            sample = {"id": i, "question": q or "", "context": c or "", "prediction": p or ""}
            for name in own or ():
                if name not in checks:
                    continue
                try:
                    r = checks[name](dict(sample))
                    result = r["result"] if r["result"] in ("pass", "fail", "inconclusive") else "inconclusive"
                    message, evidence = str(r.get("message") or ""), str(r.get("evidence") or "")
                except Exception as e:  # a faulty check must not stop a batch
                    result, message, evidence = "inconclusive", type(e).__name__, ""
                for column, value in zip(found, (name, result, message, evidence), strict=True):
                    column.append(value)
            ends.append(len(found[0]))
        rows = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in found], names=_RESULT.elementType.names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return F.arrow_udf(run, _RESULT).asNondeterministic()  # so that no expression takes it in, where it could not run


def topic_checks(rules: DataFrame, names: list[str]) -> DataFrame:
    """(domain, topic, checks): the rules of each topic that have a check, by rule_no, with their first keywords. One row a
    topic; the checks of a topic are as many as functions were written for it."""
    own = rules.where(F.col("rule_id").isin(names)).groupBy("domain", "topic").agg(F.array_sort(F.collect_list(F.struct("rule_no", "rule_id", "keywords"))).alias("c"))
    return own.select("domain", "topic", F.transform("c", lambda c: F.struct(c["rule_id"].alias("rule_id"), c["keywords"].alias("keywords"))).alias("checks"))


def one_row_each(samples: DataFrame, topics: DataFrame, selected: DataFrame, diagnostics: DataFrame, near: DataFrame) -> DataFrame:
    """``samples`` with topics (array of domain, topic, checks, best first), selected and diags (arrays in any order): the rows of
    a sample together. The inputs are grouped by id, which is their only exchange."""
    t = topics.select("id", "domain", "topic", "topic_rank").join(near, ["domain", "topic"], "left")
    t = t.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("topic_rank", "domain", "topic", "checks"))).alias("topics"))
    s = selected.groupBy("id").agg(F.collect_list(F.struct(*(c for c in selected.columns if c != "id"))).alias("selected"))
    d = diagnostics.groupBy("id").agg(F.collect_list(F.struct(*(c for c in diagnostics.columns if c != "id"))).alias("diags"))
    return spread(samples).join(t, "id", "left").join(s, "id", "left").join(d, "id", "left")


def _first(items: Column, limit: int) -> Column:
    return F.slice(items, 1, limit) if limit > 0 else items


def _or_none(df: DataFrame, name: str) -> Column:
    """An array of ``df``, empty where it is null."""
    return F.coalesce(name, F.array().cast(df.schema[name].dataType))


def with_checks(selected: DataFrame, near: DataFrame, names: list[str], bridge: int) -> DataFrame:
    """``selected`` with own, whether a rule has a check, and names: its own check, else the first ``bridge`` ones of its topic."""
    own = F.col("rule_id").isin(names)
    others = F.transform(_first(F.col("checks"), max(1, bridge)), lambda k: k["rule_id"])
    named = F.when(own, F.array("rule_id")).otherwise(F.coalesce(others, F.array().cast(_EMPTY)))
    return selected.join(near, ["domain", "topic"], "left").withColumns({"own": own, "names": named}).drop("checks")


def verify_full(samples: DataFrame, rules: DataFrame, topics: DataFrame, selected: DataFrame, diagnostics: DataFrame, checks: Checks, mode: str = "strict", least: float = V.LEAST_SCORE, bridge: int = 4, per_topic: int = 0, per_paragraph: int = 2, per_sample: int = 12, ratio: float = 0.0, fold: Callable[[Column], Column] = T.fold) -> DataFrame:
    """(id, pos, rule, severity, message, quote, status, state, reasons): every diagnostic of every sample, published or with
    the reason why it was suppressed; every selected rule that its gate stops; and the findings of checks alone.

    ``samples`` (id, question, context, prediction); ``rules`` (rule_no, rule_id, domain, topic, keywords: array);
    ``topics`` (id, domain, topic, topic_rank) and ``selected`` (id, rule_id, domain, topic, score, topic_rank,
    min_publish_score, gate_reasons, and per rule evidence_requirements, negative_conditions, policy, required_symbols)
    as retrieval and publish gate give them; ``diagnostics`` (id, pos, rule, severity, message, quote, paragraph, locatable)
    of a language model, of which those of rules that were selected and pass their gate count. ``checks`` are functions
    of a sample by rule id.

    In order: rules stopped by their gate (rule_publish_gate_precheck; pos null); scores below ``least``; own checks of a
    diagnostic's rule, or the first ``bridge`` ones of its topic, of which only a failing one counts; reconciliation; the
    release gate; duplicates and caps. Checks of the sample's topics (``per_topic`` each, 0: all) that no diagnostic
    asked for are published as warnings where they fail and their evidence stands in the text, else logged as
    non_locatable. Nulls in lists and texts count as empty.

    Which checks a rule asks for is joined to it once, a text is put in lower case once, and the samples' rows are taken
    apart once, into rows of one kind that go through the gate and the windows together.
    """
    c, texts = F.col, F.array().cast(_EMPTY)
    near = small(topic_checks(rules, list(checks)))
    df = one_row_each(samples, topics, with_checks(selected.select("id", "rule_id", "domain", "topic", *_PER_RULE), near, list(checks), bridge).drop("domain", "topic"), diagnostics.select("id", *_PER_DIAGNOSTIC), near)
    # the diagnostics whose rule was run, each with its rule's row
    rule_of = lambda d: F.get(F.filter("selected", lambda s: s["rule_id"] == d["rule"]), F.lit(0))
    df = df.withColumn("ran", F.filter(F.transform(_or_none(df, "diags"), lambda d: F.struct(d.alias("d"), rule_of(d).alias("s"))), lambda x: x["s"].isNotNull() & (F.size(x["s"]["gate_reasons"]) == 0)))
    scores = lambda x: F.coalesce(x["s"]["score"], F.lit(0.0)) >= least
    asked = F.array_distinct(F.flatten(F.transform(F.filter("ran", scores), lambda x: x["s"]["names"])))
    of_topic = lambda t: F.coalesce(t["checks"], F.array().cast(near.schema["checks"].dataType))
    tried = F.flatten(F.transform(_or_none(df, "topics"), lambda t: _first(F.transform(of_topic(t), lambda k: k["rule_id"]), per_topic)))
    df = df.withColumns({"asked": asked, "tried": tried, "known": F.flatten(F.transform(_or_none(df, "topics"), of_topic))}).withColumn("tried", F.array_except("tried", "asked"))
    ran = run_named(checks)(c("id"), c("question"), c("context"), c("prediction"), F.concat("asked", "tried"))
    text = F.coalesce("prediction", F.lit(""))
    df = df.withColumns({"results": ran, "text": text, "low": F.lower(text)})  # behind a Python column, nothing before it is worked out again for each use

    d_fields, s_kind = df.schema["diags"].dataType.elementType.fields, df.schema["selected"].dataType.elementType
    d_row = lambda **kw: F.struct(*(kw.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in d_fields))
    row = lambda d, s, status, state: F.struct(d.alias("d"), s.alias("s"), status.cast("string").alias("status"), state.cast("string").alias("state"))
    none = F.lit(None)
    stopped = F.transform(F.filter(_or_none(df, "selected"), lambda s: F.size(s["gate_reasons"]) > 0), lambda s: row(d_row(rule=s["rule_id"]), s, none, F.lit("rule_publish_gate_precheck")))
    diagnosed = F.transform("ran", lambda x: row(x["d"], x["s"], none, F.when(~scores(x), "low_rule_match_score")))

    def finding(r: Column) -> Column:
        keywords = F.get(F.filter("known", lambda k: k["rule_id"] == r["rule_id"]), F.lit(0))["keywords"]
        quote = anchored(c("text"), r["evidence"], r["message"], keywords, c("low"))
        message = F.substring(F.concat(F.lit("Check failed: "), r["message"]), 1, 300)
        return F.get(F.transform(F.array(quote), lambda q: row(d_row(rule=F.concat(F.lit("check::"), r["rule_id"]), severity=F.lit("warning"), message=message, quote=q), none.cast(s_kind), F.lit("supported"), F.when(q.isNotNull(), "published").otherwise("non_locatable"))), F.lit(0))

    alone = F.transform(F.filter("results", lambda r: (r["result"] == "fail") & F.array_contains("tried", r["rule_id"])), finding)
    with_result = lambda result: F.transform(F.filter("results", lambda r: r["result"] == result), lambda r: r["rule_id"])
    rows = df.select("id", with_result("fail").alias("failed"), with_result("pass").alias("passed"), F.transform("results", lambda r: r["rule_id"]).alias("done"), F.explode(F.concat(stopped, alone, diagnosed)).alias("r"))
    fails, passes = F.arrays_overlap("r.s.names", "failed"), c("r.s.own") & F.array_contains("passed", c("r.d.rule"))
    o = rows.select("id", *(c(f"r.d.{n}") for n in _PER_DIAGNOSTIC), *(c(f"r.s.{n}") for n in _PER_RULE if n != "required_symbols"), F.when(c("r.state").isNull(), c("r.s.required_symbols")).alias("required_symbols"), c("r.status").alias("known_status"), c("r.state").alias("given"), fails.alias("fails"), passes.alias("passes"), F.size(F.array_intersect("r.s.names", "done")).alias("n_checks"))
    o = V.quote_symbols(o, "quote", "required_symbols")
    status = F.when(c("given").isNotNull(), c("known_status")).when(c("fails"), "supported").when(c("passes"), F.when(c("symbol_ratio") >= 0.5, "quote_overlap").otherwise("refuted")).otherwise("none")
    o = V.release_gate(o.withColumn("status", status), mode, ratio, fold, c("given").isNull())
    o = o.withColumn("state", F.coalesce("given", F.when(c("status") == "refuted", "symbolic_check_refuted_original").when(~c("released"), "diagnostic_release_gate")))
    reasons = F.when(c("state") == "diagnostic_release_gate", c("reasons")).when(c("state") == "rule_publish_gate_precheck", c("gate_reasons")).otherwise(texts)
    sure = F.when(c("status") == "supported", 0).when(c("status") == "quote_overlap", 1).otherwise(2)
    o = o.select("id", c("pos").cast("int"), "rule", "severity", "message", "quote", "paragraph", "status", "state", "score", "symbol_ratio", reasons.alias("reasons"), sure.alias("sure"), fold(F.trim("quote")).alias("same"))
    o = o.repartition("id")  # Spark forgets the dealing behind a Python column; no texts and no lists of rules go here
    best = F.row_number().over(Window.partitionBy("id", "open", "same", "paragraph").orderBy(F.desc("score"), "pos"))
    o = o.withColumn("open", c("state").isNull()).withColumn("state", F.when(c("open") & (best > 1), "duplicate_location_or_quote").otherwise(c("state")))
    kept = capped(o, "id", "paragraph", [c("sure"), F.desc("score"), F.desc("symbol_ratio"), c("pos")], per_paragraph, per_sample, c("state").isNull())
    return kept.withColumn("state", F.coalesce("state", "dropped", F.lit("published"))).select("id", "pos", "rule", "severity", "message", "quote", "status", "state", "reasons")


def main_results(verified: DataFrame) -> DataFrame:
    """(id, n_errors, n_warnings, rules): what is published of each sample that has something published."""
    p = verified.where("state = 'published'")
    return p.groupBy("id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"), F.array_sort(F.collect_set("rule")).alias("rules"))


def suppression_log(verified: DataFrame) -> DataFrame:
    """(id, state, reason, n): why how many of a sample's rules and diagnostics were suppressed; a gate's reasons each count."""
    s = verified.where("state <> 'published'")
    return s.select("id", "state", F.explode_outer("reasons").alias("reason")).groupBy("id", "state", "reason").agg(F.count("*").alias("n"))
