"""The whole verification on cases worked out by hand."""

import re

from pyspark.sql import functions as F

from rulespan.operators import full_verify as V
from rulespan.operators.analysis import capped
from rulespan.operators.catalog import anchored

SELECTED = "id int, rule_id string, domain string, topic string, score double, topic_rank int, min_publish_score double, gate_reasons array<string>, evidence_requirements array<string>, negative_conditions array<string>, policy string, required_symbols array<string>"
TEXT = "The total energy is conserved because no force acts on it."
CHECKS = {
    "passes": lambda s: {"result": "pass"},
    "fails": lambda s: {"result": "fail", "message": "no units", "evidence": "total ENERGY: it is not"},
    "odd": lambda s: {"result": "maybe"},
    "raises": lambda s: s["absent"],
    "lost": lambda s: {"result": "fail", "message": "nothing", "evidence": "not in the text"},
}


def tables(spark, selected, diagnostics, rules=(), topics=(("D", "T"),), text=TEXT):
    samples = spark.createDataFrame([(1, None, None, text), (2, "q", "c", None)], "id int, question string, context string, prediction string")
    r = spark.createDataFrame([(i, name, "D", "T", ["conserved", "x"]) for i, name in enumerate(rules)], "rule_no int, rule_id string, domain string, topic string, keywords array<string>")
    t = spark.createDataFrame([(1, d, x, i) for i, (d, x) in enumerate(topics, 1)], "id int, domain string, topic string, topic_rank int")
    s = spark.createDataFrame([(1, name, "D", "T", score, 0, 4.0, gate, [], [], "suppress_on_pass", symbols) for name, score, gate, symbols in selected], SELECTED)
    d = spark.createDataFrame([(1, i, rule, "error", "wrong", quote, p, True) for i, (rule, quote, p) in enumerate(diagnostics)], "id int, pos int, rule string, severity string, message string, quote string, paragraph int, locatable boolean")
    return samples, r, t, s, d


def states(df):
    return sorted((r["pos"] if r["pos"] is not None else -1, r["rule"], r["state"], r["status"]) for r in df.collect())


def test_own_checks_decide(spark):
    selected = [(n, 9.0, [], ["energy"]) for n in ("passes", "fails", "odd", "raises", "none")] + [("weak", 1.0, [], []), ("shut", 9.0, ["generic_signal_only"], [])]
    diagnostics = [("passes", "a force", 1), ("passes", "total energy", 2), ("fails", "no force", 3), ("odd", "acts on", 4), ("raises", "acts", 5), ("none", "it", 6), ("weak", "it", 7), ("shut", "it", 8), ("elsewhere", "it", 9)]
    df = V.verify_full(*tables(spark, selected, diagnostics, ["passes", "fails", "odd", "raises"]), CHECKS)
    assert states(df) == [
        (-1, "shut", "rule_publish_gate_precheck", None), (0, "passes", "symbolic_check_refuted_original", "refuted"), (1, "passes", "published", "quote_overlap"), (2, "fails", "published", "supported"),
        (3, "odd", "published", "none"), (4, "raises", "published", "none"), (5, "none", "published", "supported"), (6, "weak", "low_rule_match_score", None),
    ]


def test_bridge_only_corroborates(spark):
    selected, diagnostics = [("unchecked", 9.0, [], ["energy"])], [("unchecked", "a force", 1)]
    run = lambda rules, bridge: states(V.verify_full(*tables(spark, selected, diagnostics, rules), CHECKS, bridge=bridge))
    assert run(["passes", "fails"], 1) == [(-1, "check::fails", "published", "supported"), (0, "unchecked", "published", "none")]
    assert run(["passes", "fails"], 2) == [(0, "unchecked", "published", "supported")]


def test_checks_alone(spark):
    df = V.verify_full(*tables(spark, [], [], ["fails", "lost", "passes"]), CHECKS)
    rows = {r["rule"]: r for r in df.collect()}
    assert rows.keys() == {"check::fails", "check::lost"}
    assert (rows["check::fails"]["quote"], rows["check::fails"]["message"]) == ("total ENERGY", "Check failed: no units")
    assert rows["check::lost"]["state"] == "published" and rows["check::lost"]["quote"] == "conserved"
    assert states(V.verify_full(*tables(spark, [], [], ["lost"], text="short"), CHECKS)) == [(-1, "check::lost", "non_locatable", "supported")]
    assert states(V.verify_full(*tables(spark, [], [], ["passes", "fails"]), CHECKS, per_topic=1)) == []


def test_duplicates_and_caps(spark):
    diagnostics = [("r", "same", 1), ("r", " Same ", 1), ("r", "other", 1), ("r", "third", 1), ("r", "far", 2), ("r", "farther", 3)]
    df = V.verify_full(*tables(spark, [("r", 9.0, [], [])], diagnostics), {}, per_paragraph=2, per_sample=3)
    assert [s[2] for s in states(df)] == ["published", "duplicate_location_or_quote", "published", "over_paragraph_cap", "published", "over_sample_cap"]
    log = {(r["state"], r["n"]) for r in V.suppression_log(df).collect()}
    assert log == {("duplicate_location_or_quote", 1), ("over_paragraph_cap", 1), ("over_sample_cap", 1)}
    assert [tuple(r) for r in V.main_results(df).collect()] == [(1, 3, 0, ["r"])]


def test_nothing_to_verify(spark):
    assert states(V.verify_full(*tables(spark, [], [], topics=()), CHECKS)) == []
    t = tables(spark, [], [])
    assert states(V.verify_full(t[0].limit(0), *t[1:], CHECKS)) == []


def test_one_dealing_by_sample(spark):
    """Behind the checks there is one exchange, by sample, for all windows."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = V.verify_full(*tables(spark, [("r", 9.0, [], [])], [("r", "q", 1)], ["fails"]), CHECKS)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    first = plan[plan.index("Window [") : plan.index("ArrowEvalPython")]
    assert re.findall(r"Exchange (\S+)\(", first) == ["hashpartitioning"] and "REPARTITION_BY_COL" in first


def test_checks_run_once(spark):
    """What is published and what is suppressed come of one pass: checks, gate and caps are not worked out for each again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = V.verify_full(*tables(spark, [("r", 9.0, [], [])], [("r", "q", 1)], ["fails"]), CHECKS)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan


def test_bridge_is_by_the_rules_topic(spark):
    """Also where that is none of the sample's topics."""
    df = V.verify_full(*tables(spark, [("unchecked", 9.0, [], ["energy"])], [("unchecked", "a force", 1)], ["fails"], topics=()), CHECKS)
    assert states(df) == [(0, "unchecked", "published", "supported")]


def test_caps_of_some_rows(spark):
    """Rows that are out of the running take no place and are not dropped."""
    rows = [(1, 0, 5, True), (1, 0, 9, False), (1, 0, 4, True), (1, 0, 3, None), (1, 1, 2, True), (1, 2, 1, True)]
    df = capped(spark.createDataFrame(rows, "id int, p int, score int, open boolean"), "id", "p", [F.desc("score")], 1, 2, F.col("open"))
    assert {(r["score"], r["dropped"]) for r in df.collect()} == {(5, None), (9, None), (4, "over_paragraph_cap"), (3, None), (2, None), (1, "over_sample_cap")}


def test_gate_works_out_its_reasons_once(spark):
    plan = V.verify_full(*tables(spark, [("r", 9.0, [], [])], [("r", "q", 1)], ["fails"]), CHECKS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\bno violation\b|") == 1


def test_anchor_without_regard_to_case(spark):
    """Letters beyond ASCII are looked for as they are too, as their lower case depends on what follows."""
    rows = [("Xyz ABCDEFΣ und", "ABCDEFΣ"), ("Xyz abcdef und", "nowhere at all"), ("Xyz ABCDEFΣX", "ABCDEFΣ"), ("short", "short")]
    df = spark.createDataFrame(rows, "t string, e string").select(anchored(F.col("t"), F.col("e"), F.lit("no such text"), F.array(F.lit("x"), F.lit("abcdef"))).alias("q"))
    assert [r["q"] for r in df.collect()] == ["ABCDEFΣ", "abcdef", "ABCDEFΣ", None]
