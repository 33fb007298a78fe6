"""Queries over gates, reconciliation, the whole verification, locations and evaluation reports; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import location as L
from ..operators import verify as V
from ..operators.roles import SAMPLES_SQL, rules, samples, table
from . import analysis as A
from . import retrieval as R


def publish_gate(spark: SparkSession, d: str) -> DataFrame:
    """Rules of samples through the gate; profile and conditions follow from the number of a rule."""
    no = F.substring("rule_id", 5, 9).cast("int")
    conditions = {"preconditions": F.when(no % 3 == 0, F.array(F.lit("the"), F.lit("x"))), "violation_signatures": F.when(no % 3 == 1, F.array(F.lit("Sch"))), "negative_conditions": F.when(no % 7 == 2, F.array(F.lit("tion")))}
    every = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in conditions.values()))
    held = V.held_conditions(R.R.rule_text(samples(spark, d)).select("id", "hay"), every, rules(spark, d))
    df = R._context(spark, d).join(held, "id").withColumns(conditions | {
        "llm_hits": F.when(no % 4 == 0, 1).otherwise(0), "generic_only": (no % 11 == 5) & (F.col("t_hits") > 0), "publishable": F.when(no % 17 == 3, "no").otherwise("yes"), "profile": F.when(no % 5 == 1, "Recall").when(no % 5 == 2, "balanced"), "policy": F.lit(None).cast("string"),
    })
    gated = V.publish_gate(V.precision_metadata(df))
    return gated.select("id", "rule_id", "min_publish_score", F.array_join("reasons", ",").alias("reasons"), "published")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate diagnostics from whole turns of conversations, with the rule's gate and metadata."""
    df = A._diagnostics(spark, d)
    n, by = F.length("quote"), lambda *v: F.element_at(F.array(*(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in v)), F.substring("rule", 2, 1).cast("int") + 1)
    spec = lambda k: F.concat("rule", F.lit(f"_{k}"))
    return df.withColumns({
        "severity": F.when(n % 7 == 0, "warning").otherwise("error"), "message": F.when(n % 19 == 0, "No violation of it").otherwise("It is wrong"), "quote": F.when(n % 23 == 0, "").otherwise(F.col("quote")), "locatable": n % 11 != 0,
        "gate_reasons": F.when(n % 17 == 0, None).when(n % 13 == 0, F.array(F.lit("generic_signal_only"))).otherwise(F.array().cast("array<string>")), "evidence_requirements": by([], ["the", "a"], []), "negative_conditions": by([], [], ["sch", "tion th"]),
        "policy": F.element_at(F.array(*map(F.lit, V.POLICIES)), F.substring("rule", 2, 1).cast("int") + 1), "n_checks": F.lit(2), "min_publish_score": F.when(n % 3 == 0, 5.0).otherwise(4.0), "topic_rank": (n % 2).cast("int"),
        "required_symbols": by(["the", "of"], [], ["in", "zz"]), "spec_ids": F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(spec(0), spec(1))),
    })


def _checks(spark: SparkSession, d: str) -> DataFrame:
    """A result of each of two checks a rule on every conversation."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("sample")).distinct()
    k = F.explode(F.array(*map(F.lit, range(6)))).alias("k")
    result = F.element_at(F.array(*map(F.lit, ["pass", "fail", "inconclusive", "inconclusive", "inconclusive"])), ((F.col("sample") + F.col("k")) % 5 + 1).cast("int"))
    return t.select("sample", k).select("sample", F.concat(F.lit("r"), F.floor(F.col("k") / 2), F.lit("_"), F.col("k") % 2).alias("spec_id"), result.alias("result"))


def reconcile(spark: SparkSession, d: str) -> DataFrame:
    return V.reconcile(_candidates(spark, d), _checks(spark, d)).select("sample", "pos", "status", F.round("symbol_ratio", 6).alias("symbol_ratio"))


def release_gate(spark: SparkSession, d: str) -> DataFrame:
    df = V.reconcile(_candidates(spark, d), _checks(spark, d))
    df = df.withColumn("status", F.when((F.col("status") == "none") & (F.length("quote") % 2 == 0), "inconclusive").otherwise(F.col("status")))
    return V.release_gate(df, ratio=0.4).select("sample", "pos", F.array_join("reasons", ",").alias("reasons"), "released")


def _verified(spark: SparkSession, d: str) -> DataFrame:
    return V.verify(_candidates(spark, d), _checks(spark, d), per_paragraph=1, per_sample=2)


def verify_replay(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d).select("sample", "pos", "state", F.array_join("reasons", ",").alias("reasons"))


def verify_audit(spark: SparkSession, d: str) -> DataFrame:
    return V.audit(_verified(spark, d))


def collect_findings(spark: SparkSession, d: str) -> DataFrame:
    diag = _candidates(spark, d).select("sample", "pos", "rule", "message", "quote")
    checks = _checks(spark, d).select("sample", (2 * F.substring("spec_id", 2, 1).cast("int") + F.substring("spec_id", 4, 1).cast("int")).alias("pos"), F.substring("spec_id", 1, 2).alias("rule"), "result", F.lit("failed").alias("message"), F.lit("").alias("quote"))
    return V.findings(diag, checks)


def strict_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Labels as ground truth, long documents as predictions, languages as checks."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    no = F.col("doc_id")
    meta = labels.select(no.alias("id"), (no % 10 != 0).alias("is_evaluable"), F.when(no % 9 != 0, F.col("toxic") == 1).alias("gt_is_incorrect"))
    kept = docs.join(labels.select("doc_id"), "doc_id")
    checks = kept.select(no.alias("id"), F.explode(F.array(F.when(no % 3 == 0, " PASS").otherwise("inconclusive"), F.when(no % 8 == 0, "fail").otherwise("inconclusive"))).alias("result")).where("id % 4 <> 1")
    suppressed = kept.where(no % 6 == 0).select(no.alias("id"), F.when(no % 12 == 0, "missing_experience_code_binding").otherwise("other").alias("reason"))
    return V.strict_metrics(meta, kept.where("n_chars > 500").select(no.alias("id")), checks, suppressed)


def span_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The paragraph and the context window of each located quote."""
    q = L.locate_exact(A._located(spark, d)).select(F.col("id").alias("sample"), "text", "start")
    bounds = L.paragraphs(samples(spark, d), "id", "prediction").withColumnRenamed("id", "sample")
    w = L.context_window(F.col("text"), F.col("start"), F.col("start") + 40)
    return L.paragraph_of(q, bounds).select("sample", "start", "paragraph", w["start"].alias("window_start"), w["end"].alias("window_end"))


def infer_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The paragraph of error items with a declared number, with a span, with words only, or with none of these."""
    s = samples(spark, d).select(F.col("id").alias("sample"), F.coalesce("prediction", F.lit("")).alias("text"))
    bounds = L.paragraphs(s, "sample", "text")
    no = F.col("sample")
    items = s.select("sample", F.lit(0).alias("no"), F.when(no % 4 == 0, 2).alias("declared"), F.when(no % 4 == 1, 150).alias("start"), F.when(no % 4 == 2, L.evaluator_tokens(F.substring("text", 300, 80))).otherwise(F.array().cast("array<string>")).alias("words"))
    return L.infer_paragraph(items, bounds, s)


def _located_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ground truth every 80 characters and findings shifted by the id, every third of them with a paragraph only."""
    s = A._spans(spark, d)
    words = lambda c: F.array(F.concat(F.lit("w"), F.col(c) % 3), F.concat(F.lit("v"), F.col("sample") % 2))

    def side(a: str, b: str, blind: int) -> DataFrame:
        hidden = F.col("no") % 3 == blind
        part = F.floor(F.col(a) / 200).cast("int")
        return s.select("sample", "no", F.when(~hidden, F.col(a)).alias("start"), F.when(~hidden, F.col(b)).alias("end"), (part + 1).alias("paragraph"), (part * 200).alias("p_start"), (part * 200 + 200).alias("p_end"), words("no").alias("words"))

    return side("gs", "ge", 0), side("ps", "pe", 2)


def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    return L.match_candidates(*_located_sides(spark, d)).select("sample", "gt", "pred", *(F.round(c, 6).alias(c) for c in ("iou", "coverage", "span_score", "paragraph_score")))


def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Error-level report of the greedy location matching."""
    gt, pred = _located_sides(spark, d)
    located = lambda df: df.select("sample", (F.col("no") % 5 != 4).alias("locatable"))
    return V.error_metrics(located(gt), located(pred), L.greedy_match(L.match_candidates(gt, pred)))


def checker_score(spark: SparkSession, d: str) -> DataFrame:
    """Minus one for an error, minus a half for a warning, of each conversation."""
    points = F.when(F.col("severity") == "error", -1.0).when(F.col("severity") == "warning", -0.5).otherwise(0.0)
    return _candidates(spark, d).groupBy("sample").agg(F.sum(points).alias("score"), F.count("*").alias("n"))


FUNCTIONS = [publish_gate, reconcile, release_gate, verify_replay, verify_audit, collect_findings, strict_metrics, span_paragraphs, infer_paragraphs, match_candidates, error_metrics, checker_score]
_IN = lambda x, hay: f"contains({hay}, '{x}')"
_D = f"""{A._DIAG}, c0 AS (SELECT *, length(quote) AS n, substr(rule, 2, 1)::INT AS r FROM diag),
    cand AS (SELECT sample, pos, rule, paragraph, score, n, r, CASE WHEN n % 7 = 0 THEN 'warning' ELSE 'error' END AS severity, CASE WHEN n % 19 = 0 THEN 'No violation of it' ELSE 'It is wrong' END AS message, CASE WHEN n % 23 = 0 THEN '' ELSE quote END AS quote, n % 11 <> 0 AS locatable,
        ['suppress_on_pass', 'suppress_on_inconclusive', 'require_fail'][r + 1] AS policy, CASE WHEN n % 3 = 0 THEN 5 ELSE 4 END AS bar, n % 2 AS topic_rank, CASE WHEN r = 0 THEN ['the', 'of'] WHEN r = 2 THEN ['in', 'zz'] ELSE [] END AS req FROM c0),
    k AS (SELECT DISTINCT conv_id AS sample FROM conversations), ran AS (SELECT sample, 'r' || (i // 2) || '_' || (i % 2) AS spec_id, 'r' || (i // 2) AS rule, ['pass', 'fail', 'inconclusive', 'inconclusive', 'inconclusive'][(crc + i) % 5 + 1] AS result FROM (SELECT sample, sample AS crc FROM k), range(6) t(i)),
    own AS (SELECT sample, rule, bool_or(result = 'fail') AS f, bool_or(result = 'pass') AS p FROM ran GROUP BY ALL),
    h AS (SELECT cand.*, {A._NORM.format("quote")} AS norm, CASE WHEN n % 5 <> 0 THEN f END AS f, CASE WHEN n % 5 <> 0 THEN p END AS p FROM cand JOIN own ON own.sample = cand.sample AND own.rule = cand.rule),
    q AS (SELECT *, CASE WHEN len(req) > 0 AND quote <> '' THEN len(list_filter(req, lambda x: regexp_matches(norm, '(^|[^a-z0-9])' || x || '([^a-z0-9]|$)'))) / len(req) ELSE 0 END AS ratio FROM h),
    rec AS (SELECT *, CASE WHEN f THEN 'supported' WHEN p THEN CASE WHEN ratio >= 0.5 THEN 'quote_overlap' ELSE 'refuted' END ELSE 'none' END AS status FROM q)"""


def _gate_sql(source: str, ratio: float) -> str:
    return f"""gate AS (SELECT *, concat_ws(',', CASE WHEN severity <> 'error' THEN 'severity_not_error' END, CASE WHEN message = 'No violation of it' THEN 'negative_or_uncertain_diagnostic' END, CASE WHEN quote = '' THEN 'missing_quote' END, CASE WHEN NOT locatable THEN 'unlocatable_quote' END,
        CASE WHEN n % 17 = 0 THEN 'missing_rule_publish_gate' WHEN n % 13 = 0 THEN 'generic_signal_only' END, CASE WHEN r = 1 AND NOT ({_IN("the", "quote")} OR regexp_matches(quote, '(^|[^a-z0-9_])a([^a-z0-9_]|$)')) THEN 'missing_required_evidence' END,
        CASE WHEN r = 2 AND ({_IN("sch", "quote")} OR {_IN("tion th", "quote")}) THEN 'quote_hits_negative_condition' END,
        CASE WHEN status = 'inconclusive' AND policy <> 'suppress_on_pass' THEN 'symbolic_inconclusive_suppressed' WHEN status = 'inconclusive' AND score < bar + 2 THEN 'symbolic_inconclusive_below_strict_score' WHEN status = 'inconclusive' AND topic_rank >= 1 AND score < bar + 3 THEN 'symbolic_inconclusive_secondary_topic_below_score'
            WHEN status NOT IN ('supported', 'quote_overlap', 'inconclusive') AND policy = 'require_fail' THEN 'symbolic_fail_required' END,
        CASE WHEN len(req) >= 2 AND quote <> '' AND status <> 'supported' AND ratio < {ratio} THEN 'quote_missing_required_symbols' END) AS reasons FROM {source})"""


_V = f"""{_D}, {_gate_sql("(SELECT * FROM rec WHERE score >= 4)", 0)},
    st AS (SELECT *, CASE WHEN status = 'refuted' THEN 'symbolic_check_refuted_original' WHEN reasons <> '' THEN 'diagnostic_release_gate' END AS state FROM gate),
    op AS (SELECT *, row_number() OVER (PARTITION BY sample, trim(quote), paragraph ORDER BY score DESC, pos) AS rk, CASE status WHEN 'supported' THEN 0 WHEN 'quote_overlap' THEN 1 ELSE 2 END AS s FROM st WHERE state IS NULL),
    a1 AS (SELECT *, row_number() OVER (PARTITION BY sample, paragraph ORDER BY s, score DESC, ratio DESC, pos) AS rp FROM op WHERE rk = 1),
    a2 AS (SELECT *, CASE WHEN rp <= 1 THEN row_number() OVER (PARTITION BY sample, rp <= 1 ORDER BY s, score DESC, ratio DESC, pos) END AS rs FROM a1),
    a3 AS (SELECT *, coalesce(rs <= 2, false) AS keep FROM a2), a4 AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY sample, paragraph) AS kept FROM a3),
    verified AS (SELECT sample, pos, 'low_rule_match_score' AS state, '' AS reasons FROM cand WHERE score < 4 UNION ALL SELECT sample, pos, state, CASE WHEN status = 'refuted' THEN '' ELSE reasons END FROM st WHERE state IS NOT NULL
        UNION ALL SELECT sample, pos, 'duplicate_location_or_quote', '' FROM op WHERE rk > 1 UNION ALL SELECT sample, pos, CASE WHEN keep THEN 'published' WHEN kept >= 1 THEN 'over_paragraph_cap' ELSE 'over_sample_cap' END, '' FROM a4)"""
SQL = {
    "publish_gate": f"""{R._C}, m AS (SELECT context.*, hay, substr(rule_id, 5)::INT AS no FROM context JOIN whole USING (id)),
        b AS (SELECT *, greatest(4, min_score) + CASE WHEN is_meta THEN 0.5 ELSE 0 END + CASE WHEN topic_rank > 1 THEN 1 ELSE 0 END + CASE no % 5 WHEN 1 THEN 2 WHEN 2 THEN 0.5 ELSE 0 END AS bar FROM m),
        r AS (SELECT id, rule_id, bar::DOUBLE AS min_publish_score, concat_ws(',', CASE WHEN no % 17 = 3 THEN 'rule_marked_unpublishable' END, CASE WHEN no % 5 = 1 THEN 'recall_profile_not_publishable_in_strict_mode' END, CASE WHEN no % 11 = 5 AND t_hits > 0 THEN 'generic_signal_only' END,
            CASE WHEN no % 4 = 0 AND t_hits + o_hits + s_hits = 0 THEN 'llm_hint_only' END, CASE WHEN no % 3 = 0 AND NOT (contains(hay, 'the') OR regexp_matches(hay, '(^|[^a-z0-9_])x([^a-z0-9_]|$)')) THEN 'missing_precondition_evidence' END, CASE WHEN no % 3 = 1 AND NOT contains(hay, 'sch') THEN 'missing_violation_signature' END,
            CASE WHEN no % 7 = 2 AND contains(hay, 'tion') THEN 'negative_condition_hit' END, CASE WHEN score < bar THEN 'below_dynamic_publish_score' END) AS reasons FROM b) SELECT id, rule_id, min_publish_score, reasons, reasons = '' AS published FROM r""",
    "reconcile": f"{_D} SELECT sample, pos, status, round(ratio, 6)::DOUBLE AS symbol_ratio FROM rec",
    "release_gate": f"{_D}, rec2 AS (SELECT * REPLACE (CASE WHEN status = 'none' AND length(quote) % 2 = 0 THEN 'inconclusive' ELSE status END AS status) FROM rec), {_gate_sql('rec2', 0.4)} SELECT sample, pos, reasons, reasons = '' AS released FROM gate",
    "verify_replay": f"{_V} SELECT * FROM verified",
    "verify_audit": f"{_V} SELECT sample, count(*) AS n_candidates, count(*) FILTER (state = 'published') AS n_published, count(*) FILTER (state <> 'published') AS n_suppressed, -count(*) FILTER (state = 'published') AS score FROM verified GROUP BY sample",
    "strict_metrics": f"""WITH l AS (SELECT doc_id AS id, doc_id % 10 <> 0 AND doc_id % 9 <> 0 AS ok, toxic = 1 AS gt, n_chars > 500 AS pred, documents.doc_id IS NOT NULL AS has FROM labels LEFT JOIN documents USING (doc_id)),
        c AS (SELECT *, coalesce(pred, false) AS pr, CASE WHEN has AND id % 4 <> 1 THEN (id % 3 = 0)::INT END AS p, CASE WHEN has AND id % 4 <> 1 THEN (id % 8 = 0)::INT END AS f FROM l),
        s AS (SELECT count(*) AS n_samples, count(*) FILTER (ok) AS n_evaluable, count(*) FILTER (ok AND pr AND gt) AS tp, count(*) FILTER (ok AND pr AND NOT gt) AS fp, count(*) FILTER (ok AND NOT pr AND gt) AS fn, count(*) FILTER (ok AND NOT pr AND NOT gt) AS tn, coalesce(sum(p), 0)::BIGINT AS n_pass, coalesce(sum(f), 0)::BIGINT AS n_fail,
            coalesce(sum(2 - p - f), 0)::BIGINT AS n_inconclusive, count(p) AS with_checks, count(*) FILTER (p + f = 0) AS all_inconclusive, count(*) FILTER (has AND id % 6 = 0) AS n_suppressed, count(*) FILTER (has AND id % 12 = 0) AS n_unbound FROM c)
        SELECT n_samples, n_evaluable, n_pass, n_fail, n_inconclusive, with_checks, all_inconclusive, n_suppressed, n_unbound, {A._PRF.split("round(coalesce((tp + tn)")[0].strip().rstrip(",")}, round(coalesce(n_inconclusive / nullif(n_pass + n_fail + n_inconclusive, 0), 0), 6)::DOUBLE AS inconclusive_ratio,
            round(coalesce(all_inconclusive / nullif(with_checks, 0), 0), 6)::DOUBLE AS all_inconclusive_ratio, round(coalesce(n_unbound / nullif(n_suppressed, 0), 0), 6)::DOUBLE AS unbound_ratio FROM s""",
    "match_candidates": f"""{A._SPANS}, side AS (SELECT sample, no, CASE WHEN no % 3 <> 0 THEN gs END AS gs, CASE WHEN no % 3 <> 0 THEN ge END AS ge, CASE WHEN no % 3 <> 2 THEN ps END AS ps, CASE WHEN no % 3 <> 2 THEN pe END AS pe, gs // 200 AS gp, ps // 200 AS pp, ['w' || (no % 3), 'v' || (sample % 2)] AS w FROM spans),
        j AS (SELECT g.sample, g.no AS gt, p.no AS pred, coalesce(greatest(0, least(g.ge, p.pe) - greatest(g.gs, p.ps)), 0) AS o, coalesce(greatest(g.ge, p.pe) - least(g.gs, p.ps), 1) AS wide, coalesce(least(g.ge - g.gs, p.pe - p.ps), 60) AS shorter, g.gp = p.pp AS near, len(list_intersect(g.w, p.w)) AS shared FROM side g JOIN side p USING (sample)),
        k AS (SELECT *, CASE WHEN g.o > 0 AND (g.gt % 3 <> 0) AND (g.pred % 3 <> 2) THEN o ELSE 0 END AS ov FROM j g)
        SELECT sample, gt, pred, round(CASE WHEN ov > 0 THEN ov / wide ELSE 0 END, 6)::DOUBLE AS iou, round(CASE WHEN ov > 0 THEN ov / shorter ELSE 0 END, 6)::DOUBLE AS coverage, round(CASE WHEN ov > 0 THEN ov / wide + 0.01 * ov / shorter END, 6)::DOUBLE AS span_score, round(CASE WHEN near THEN shared + 1.05 END, 6)::DOUBLE AS paragraph_score FROM k WHERE ov > 0 OR near""",
    "collect_findings": f"""{_D}, every AS (SELECT sample, 0 AS k, pos, 'diagnostic' AS source, rule, message AS text, quote FROM cand
        UNION ALL SELECT sample, 1, 2 * substr(spec_id, 2, 1)::INT + substr(spec_id, 4, 1)::INT, 'check', rule, 'failed', '' FROM ran WHERE result = 'fail'),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, source, rule, text, quote ORDER BY k, pos) AS n FROM every) WHERE n = 1)
        SELECT sample, source, rule, text, quote, row_number() OVER (PARTITION BY sample ORDER BY k, pos) AS place FROM one""",
    "checker_score": f"{_D} SELECT sample, sum(CASE severity WHEN 'error' THEN -1.0 ELSE -0.5 END)::DOUBLE AS score, count(*) AS n FROM cand GROUP BY sample",
}
