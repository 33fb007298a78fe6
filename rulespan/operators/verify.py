"""From candidate diagnostics to published ones: gates, reconciliation with checks, caps, and a log of what was dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import analysis as A
from .phrase_index import found_sets
from .retrieval import spread

#: The least score of a rule behind a diagnostic, and what an inconclusive check adds to it.
LEAST_SCORE, INCONCLUSIVE_BONUS = 4.0, 2.0
PROFILES, POLICIES = ("strict", "balanced", "recall"), ("suppress_on_pass", "suppress_on_inconclusive", "require_fail")


def matched(needles: Column, hay: Column, fold: Callable[[Column], Column] = T.fold) -> Column:
    """Those of ``needles`` that stand in a text folded by ``fold``."""
    return F.filter(F.coalesce(needles, F.array().cast("array<string>")), lambda n: T.contains_phrase(hay, fold(n)))


def _some(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def quote_symbols(df: DataFrame, quote: str, required: str) -> DataFrame:
    """``df`` with symbol_hits, those of the ``required`` symbols that a quote holds, and symbol_ratio, their share (0 if
    none is required or the quote is empty)."""
    none = F.array().cast("array<string>")
    df = df.withColumns({"__low": F.lower(F.coalesce(quote, F.lit(""))), "__norm": A.normal_form(F.coalesce(quote, F.lit("")))})
    own = F.transform(F.coalesce(required, none), lambda s: F.struct(s.alias("s"), A.normal_form(s).alias("n")))  # a symbol's normal form is made once
    hits = F.transform(F.filter(own, lambda x: A.token_present(x["s"], F.col("__low"), F.col("__norm"), x["n"])), lambda x: x["s"])
    df = df.withColumn("symbol_hits", F.when(F.col("__low") == "", none).otherwise(hits))
    n = F.size(F.coalesce(required, none))
    return df.withColumn("symbol_ratio", F.when(n > 0, F.size("symbol_hits") / n).otherwise(0.0)).drop("__low", "__norm")


def precision_metadata(rules: DataFrame) -> DataFrame:
    """``rules`` with profile, policy and publishable cleaned: a word that is unknown or absent gives strict,
    suppress_on_pass and true; 0, false, no and off give false."""
    word = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    profile, policy = word("profile"), word("policy")
    return rules.withColumns({
        "profile": F.when(profile.isin(*PROFILES), profile).otherwise("strict"), "policy": F.when(policy.isin(*POLICIES), policy).otherwise("suppress_on_pass"),
        "publishable": ~word(F.col("publishable").cast("string")).isin("0", "false", "no", "off"),
    })


def held_conditions(texts: DataFrame, conditions: Column, rules: DataFrame) -> DataFrame:
    """(id, held): which of the ``conditions`` of all ``rules`` (an array of theirs) stand in each text (id, hay; folded), each
    looked for once in a text."""
    return found_sets(spread(texts), rules.select(F.explode(F.transform(conditions, T.fold)).alias("phrase"))).withColumnRenamed("found", "held")


def publish_gate(df: DataFrame, mode: str = "strict", least: float = LEAST_SCORE) -> DataFrame:
    """``df`` with min_publish_score, reasons (an ordered array) and published, for rows of a scored rule.

    Columns: score, min_score, is_meta, topic_rank (from 1), t_hits, o_hits, s_hits, llm_hits, generic_only, publishable,
    profile, preconditions, violation_signatures, negative_conditions, and either held, as :func:`held_conditions` has it, or hay (folded), which repeats a text for each
    of its rules. ``score_only`` looks at the score alone.
    """
    c = F.col
    bar = F.greatest(F.lit(least), c("min_score")) + F.when(c("is_meta"), 0.5).otherwise(0.0) + F.when(c("topic_rank") > 1, 1.0).otherwise(0.0) + F.when(c("profile") == "balanced", 0.5).when(c("profile") == "recall", 2.0).otherwise(0.0)
    if mode == "score_only":
        reasons = F.array_compact(F.array(F.when(c("score") < least, "below_score_only_threshold")))
        bar = F.lit(least)
    else:
        hits = lambda name: F.coalesce(F.exists(c(name), lambda n: F.array_contains("held", T.fold(n))), F.lit(False)) if "held" in df.columns else _some(matched(c(name), c("hay")))
        reasons = F.array_compact(F.array(
            F.when(~c("publishable"), "rule_marked_unpublishable"), F.when(c("profile") == "recall", "recall_profile_not_publishable_in_strict_mode"), F.when(c("generic_only"), "generic_signal_only"),
            F.when((c("llm_hits") > 0) & (c("t_hits") + c("o_hits") + c("s_hits") == 0), "llm_hint_only"), F.when(_some(c("preconditions")) & ~hits("preconditions"), "missing_precondition_evidence"),
            F.when(_some(c("violation_signatures")) & ~hits("violation_signatures"), "missing_violation_signature"), F.when(hits("negative_conditions"), "negative_condition_hit"), F.when(c("score") < bar, "below_dynamic_publish_score"),
        ))
    return df.withColumns({"min_publish_score": bar, "reasons": reasons, "published": F.size(reasons) == 0})


def reconcile(diagnostics: DataFrame, checks: DataFrame) -> DataFrame:
    """``diagnostics`` with status: supported if one of its checks fails; if one passes, quote_overlap where the quote holds
    half of the required symbols and else refuted; none where nothing was decided.

    ``diagnostics`` (sample, pos, spec_ids, quote, required_symbols), ``checks`` (sample, spec_id, result). A diagnostic's
    checks meet it by key, in one aggregate."""
    ran = checks.groupBy("sample", "spec_id").agg(F.bool_or(F.col("result") == "fail").alias("fail"), F.bool_or(F.col("result") == "pass").alias("pass"))
    own = diagnostics.select("sample", "pos", F.explode("spec_ids").alias("spec_id")).join(ran, ["sample", "spec_id"]).groupBy("sample", "pos").agg(F.bool_or("fail").alias("__fail"), F.bool_or("pass").alias("__pass"))
    df = quote_symbols(diagnostics.join(own, ["sample", "pos"], "left"), "quote", "required_symbols")
    status = F.when(F.col("__fail"), "supported").when(F.col("__pass"), F.when(F.col("symbol_ratio") >= 0.5, "quote_overlap").otherwise("refuted")).otherwise("none")
    return df.withColumn("status", status).drop("__fail", "__pass")


def release_gate(df: DataFrame, mode: str = "strict", ratio: float = 0.0, fold: Callable[[Column], Column] = T.fold, only: Column | None = None) -> DataFrame:
    """``df`` with reasons, why a diagnostic may not be released, in fixed order, and released.

    Columns: severity, message, quote, locatable, gate_reasons (null: the rule has no gate), evidence_requirements,
    negative_conditions, policy, status (of reconcile, or inconclusive), n_checks, score, min_publish_score, topic_rank
    (from 0), required_symbols, symbol_ratio. ``fold`` says which spellings of a quote are the same. Rows where ``only`` is
    not true are released as they are.
    """
    c = F.col
    df = df.withColumns({"__quote": fold(F.trim(F.coalesce("quote", F.lit("")))), "__message": T.norm_text(c("message"))})  # made once for all tests
    quote = c("__quote")
    severity = F.lower(F.trim(F.coalesce("severity", F.lit(""))))
    strict = F.lit(mode == "strict")
    bar = F.coalesce("min_publish_score", F.lit(LEAST_SCORE)) + INCONCLUSIVE_BONUS
    inconclusive = c("status") == "inconclusive"
    symbolic = (
        F.when(inconclusive & c("policy").isin("require_fail", "suppress_on_inconclusive"), "symbolic_inconclusive_suppressed")
        .when(inconclusive & strict & (c("score") < bar), "symbolic_inconclusive_below_strict_score")
        .when(inconclusive & strict & (c("topic_rank") >= 1) & (c("score") < bar + 1.0), "symbolic_inconclusive_secondary_topic_below_score")
        .when(~c("status").isin("supported", "quote_overlap", "inconclusive") & (c("policy") == "require_fail") & (c("n_checks") > 0), "symbolic_fail_required")
    )
    before = F.array(
        F.when(~severity.isin(*(("error", "warning") if mode == "balanced" else ("error",))), "severity_not_error"), F.when(T.says_nothing(c("__message"), severity), "negative_or_uncertain_diagnostic"),
        F.when(quote == "", "missing_quote"), F.when(~F.coalesce("locatable", F.lit(False)), "unlocatable_quote"),
    )
    after = F.array(
        F.when(_some(c("evidence_requirements")) & ~_some(matched(c("evidence_requirements"), quote, fold)), "missing_required_evidence"), F.when(_some(matched(c("negative_conditions"), quote, fold)), "quote_hits_negative_condition"), symbolic,
        F.when(strict & (F.coalesce(F.size("required_symbols"), F.lit(0)) >= 2) & (quote != "") & (c("status") != "supported") & (c("symbol_ratio") < ratio), "quote_missing_required_symbols"),
    )
    gate = F.coalesce("gate_reasons", F.array(F.lit("missing_rule_publish_gate")))
    reasons = F.array_distinct(F.array_compact(F.concat(before, gate, after)))
    reasons = reasons if only is None else F.when(only, reasons).otherwise(F.array().cast("array<string>"))
    return df.withColumn("reasons", reasons).withColumn("released", F.size("reasons") == 0).drop("__quote", "__message")


def verify(candidates: DataFrame, checks: DataFrame, mode: str = "strict", least: float = LEAST_SCORE, per_paragraph: int = 2, per_sample: int = 12, ratio: float = 0.0) -> DataFrame:
    """Every one of ``candidates`` with state: published, or why it was suppressed, and the reasons of the gate.

    In order: rules that score too low, diagnostics that a check refutes, the release gate, duplicates of a quote and
    paragraph (the best stays), and caps for a paragraph and a sample. Candidates are an input table, so that a cached
    run is replayed by the same call. All windows are by sample.
    """
    low = candidates.where(F.coalesce("score", F.lit(0.0)) < least).select("sample", "pos", F.lit("low_rule_match_score").alias("state"), F.array().cast("array<string>").alias("reasons"))
    df = reconcile(candidates.where(F.coalesce("score", F.lit(0.0)) >= least), checks)
    df = release_gate(df, mode, ratio)
    first = F.when(F.col("status") == "refuted", "symbolic_check_refuted_original").when(~F.col("released"), "diagnostic_release_gate")
    df = df.withColumn("state", first)
    none = F.array().cast("array<string>")
    gone = df.where("state is not null").select("sample", "pos", "state", F.when(F.col("status") == "refuted", none).otherwise(F.col("reasons")).alias("reasons"))
    open_ = df.where("state is null")
    status = F.when(F.col("status") == "supported", 0).when(F.col("status") == "quote_overlap", 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("sample", T.fold(F.trim("quote")), "paragraph").orderBy(F.desc("score"), "pos"))
    open_ = open_.withColumn("__rank", rank)
    double = open_.where("__rank > 1").select("sample", "pos", F.lit("duplicate_location_or_quote").alias("state"), none.alias("reasons"))
    kept = A.capped(open_.where("__rank = 1"), "sample", "paragraph", [status, F.desc("score"), F.desc("symbol_ratio"), F.col("pos")], per_paragraph, per_sample)
    last = kept.select("sample", "pos", F.coalesce("dropped", F.lit("published")).alias("state"), none.alias("reasons"))
    return low.unionByName(gone).unionByName(double).unionByName(last)


def audit(verified: DataFrame) -> DataFrame:
    """(sample, n_candidates, n_published, n_suppressed, score): one row per sample of :func:`verify`; score is minus the
    number of published diagnostics."""
    n = F.count_if(F.col("state") == "published")
    return verified.groupBy("sample").agg(F.count("*").alias("n_candidates"), n.alias("n_published"), (F.count("*") - n).alias("n_suppressed"), (-n).alias("score"))


def findings(diagnostics: DataFrame, checks: DataFrame) -> DataFrame:
    """(sample, place, source, rule, text, quote): diagnostics and failing checks, each distinct one once, the first of its
    kind: diagnostics (sample, pos, rule, message, quote) before checks (sample, pos, rule, result, message, quote)."""
    d = diagnostics.select("sample", F.lit(0).alias("__k"), "pos", F.lit("diagnostic").alias("source"), "rule", F.col("message").alias("text"), "quote")
    c = checks.where(F.lower(F.trim("result")) == "fail").select("sample", F.lit(1).alias("__k"), "pos", F.lit("check").alias("source"), "rule", F.col("message").alias("text"), "quote")
    key = ["sample", "source", "rule", "text", "quote"]
    one = A.dedupe_best(d.unionByName(c), key, [F.col("__k"), F.col("pos")])
    return one.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy("__k", "pos"))).drop("__k", "pos")


def strict_metrics(meta: DataFrame, predicted: DataFrame, checks: DataFrame, suppressed: DataFrame) -> DataFrame:
    """One row: confusion and its ratios over the evaluable samples of ``meta`` (id, is_evaluable, gt_is_incorrect), a sample
    being positive if ``predicted`` (id) has it, and what checks and suppression did: ``checks`` (id, result),
    ``suppressed`` (id, reason). Each input is aggregated by sample before it is joined."""
    res = F.lower(F.trim("result"))
    n = lambda r: F.count_if(res == r)
    per = checks.groupBy("id").agg(n("pass").alias("p"), n("fail").alias("f"), n("inconclusive").alias("i"))
    sup = suppressed.groupBy("id").agg(F.count("*").alias("s"), F.count_if(F.col("reason") == "missing_experience_code_binding").alias("b"))
    df = meta.join(predicted.select("id").distinct().withColumn("__pred", F.lit(True)), "id", "left").join(per, "id", "left").join(sup, "id", "left")
    ok = F.coalesce(F.col("is_evaluable") & F.col("gt_is_incorrect").isNotNull(), F.lit(False))
    pred, gt = F.coalesce("__pred", F.lit(False)), F.coalesce("gt_is_incorrect", F.lit(False))
    t = lambda c: F.coalesce(F.sum(c), F.lit(0))
    quiet = F.col("p").isNotNull() & (F.col("p") + F.col("f") == 0)
    m = df.agg(
        F.count("*").alias("n_samples"), F.count_if(ok).alias("n_evaluable"), F.count_if(ok & pred & gt).alias("tp"), F.count_if(ok & pred & ~gt).alias("fp"), F.count_if(ok & ~pred & gt).alias("fn"), F.count_if(ok & ~pred & ~gt).alias("tn"),
        t("p").alias("n_pass"), t("f").alias("n_fail"), t("i").alias("n_inconclusive"), F.count("p").alias("with_checks"), F.count_if(quiet).alias("all_inconclusive"), t("s").alias("n_suppressed"), t("b").alias("n_unbound"),
    )
    c = F.col
    p, r = A.ratio(c("tp"), c("tp") + c("fp")), A.ratio(c("tp"), c("tp") + c("fn"))
    return m.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(A.ratio(2 * p * r, p + r), 6).alias("f1"), F.round(A.ratio(c("n_inconclusive"), c("n_pass") + c("n_fail") + c("n_inconclusive")), 6).alias("inconclusive_ratio"), F.round(A.ratio(c("all_inconclusive"), c("with_checks")), 6).alias("all_inconclusive_ratio"), F.round(A.ratio(c("n_unbound"), c("n_suppressed")), 6).alias("unbound_ratio"))


def error_metrics(truth: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of error-level metrics: ``truth`` (sample, locatable), ``found`` (sample, locatable), ``matches`` (sample, gt,
    pred, iou, kind) as the location matching gives them."""
    per = lambda df, name: df.groupBy("sample").agg(F.count("*").alias(name), F.count_if("locatable").alias(f"{name}_located"))
    m = matches.groupBy("sample").agg(F.count("*").alias("hit"), F.count_if(F.col("kind") != "span").alias("by_paragraph"), F.sum("iou").alias("iou"))
    df = per(truth, "gt").join(per(found, "pred"), "sample", "full_outer").join(m, "sample", "left").fillna(0)
    t = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = df.agg(F.count("*").alias("n_samples"), *(t(c).alias(f"n_{c}") for c in ("gt", "gt_located", "pred", "pred_located", "hit", "by_paragraph")), t("iou").alias("__iou"), F.count_if(F.col("pred") > 0).alias("triggered"), F.count_if(F.col("hit") > 0).alias("hit_samples"))
    c = F.col
    r, p = A.ratio(c("n_hit"), c("n_gt")), A.ratio(c("n_hit"), c("n_pred_located"))
    out = {
        "recall": r, "precision": p, "f1": A.ratio(2 * p * r, p + r), "recall_located": A.ratio(c("n_hit"), c("n_gt_located")), "gt_located_ratio": A.ratio(c("n_gt_located"), c("n_gt")), "trigger_ratio": A.ratio(c("triggered"), c("n_samples")),
        "hit_ratio": A.ratio(c("hit_samples"), c("n_samples")), "pred_located_ratio": A.ratio(c("n_pred_located"), c("n_pred")), "mean_iou": A.ratio(c("__iou"), c("n_hit")),
    }
    return s.select(*(c(x) for x in s.columns if x != "__iou"), (c("n_gt_located") - c("n_hit")).alias("missed"), (c("n_pred_located") - c("n_hit")).alias("false_alarms"), *(F.round(v, 6).alias(n) for n, v in out.items()))
