"""Scores of topics and rules on cases worked out by hand."""

import pytest

from rulespan import plans
from rulespan.operators import retrieval as R
from rulespan.operators import roles

RULES = "rule_no int, rule_id string, domain string, topic string, title string, trigger string, check_logic string, support int, is_meta boolean"
SAMPLES = "id int, question string, context string, prediction string"
TOPICS = "id int, domain string, topic string, score double, anchored boolean, topic_rank int"
HINTS = "rule_no int, negatives array<string>, phrases array<string>, terms array<string>"


def scored(spark, text, rule, hints=None, anchored=True):
    """The one scored rule of a sample with a text; ``rule`` (title, trigger, check_logic, support, is_meta)."""
    samples = spark.createDataFrame([(1, text, "", "")], SAMPLES)
    topics = spark.createDataFrame([(1, "D", "T", 5.0, anchored, 1)], TOPICS)
    rules = spark.createDataFrame([(1, "r", "D", "T", *rule)], RULES)
    h = None if hints is None else spark.createDataFrame([(1, *hints)], HINTS)
    (row,) = R.rule_context(R.rule_scores(samples, topics, rules, h)).collect()
    return row


@pytest.mark.parametrize(
    ("negatives", "phrases", "terms", "score", "llm_hits"),
    [
        (None, None, None, 3.0, 0),
        (["vacuum"], None, None, 1.0, 0),
        (["vacuum", "Vacuum ", "drops"], [], [], 0.0, 0),
        ([], ["a body falling freely downwards"], [], 5.5, 1),
        ([], ["nothing alike anywhere"], ["falling", "absent"], 4.0, 1),
    ],
)
def test_hints_and_negatives(spark, negatives, phrases, terms, score, llm_hits):
    r = scored(spark, "a falling body drops freely in vacuum", ("", "drops", "", 0, False), (negatives, phrases, terms))
    assert (r.score, r.llm_hits) == (score, llm_hits)


def test_hints_alone_count_a_third(spark):
    r = scored(spark, "a falling body", ("", "unheard", "", 3, False), ([], ["falling body"], ["falling"]))
    assert r.score == pytest.approx(0.35 * 3.5) and r.t_hits == 0


def test_rule_without_hints_and_without_text(spark):
    assert scored(spark, "", ("", "drops", "", 3, False), ([], [], [])).score == 0
    assert scored(spark, None, ("", "drops", "", 3, True)).score == 0


@pytest.mark.parametrize(("anchored", "least", "bonus"), [(True, 2.0, 0.5), (False, 4.0, -1.0)])
def test_generic_hits_need_more(spark, anchored, least, bonus):
    r = scored(spark, "the cosine of an angle", ("", "cosine", "", 0, False), anchored=anchored)
    assert r.generic_only and (r.min_score, r.adjusted) == (least, 3.0 + bonus)
    r = scored(spark, "the cosine of an angle", ("", "cosine angle", "", 0, False), anchored=anchored)
    assert not r.generic_only and (r.min_score, r.adjusted) == (1.0, 7.5)


def test_signals_stand_with_or_without_layout(spark):
    for text in (r"\mathrm{v}_max is large", r"\text{v}_max", "v_max"):
        assert scored(spark, text, ("", "v_max", "", 0, False)).t_hits == 1
    assert scored(spark, r"\mathrm{v}_max", ("", "mathrm", "", 0, False)).t_hits == 1


def test_deltas_and_offline_choice(spark):
    context = "id int, topic_rank int, topic_score double, domain string, topic string, anchored boolean, rule_id string, is_meta boolean, generic_only boolean, score double"
    rows = [(1, 1, 5.0, "D", "A", True, "low", False, False, 0.5), (1, 1, 5.0, "D", "A", True, "high", False, True, 4.0), (1, 2, 4.8, "D", "B", True, "side", False, False, 3.5)]
    df = spark.createDataFrame(rows, context)
    plain, tuned = ({r.rule_id: r for r in R.rule_context(df, *d).collect()} for d in ((), (1.0, -0.5)))
    assert all(tuned[k].min_score == plain[k].min_score + 1 and tuned[k].adjusted == plain[k].adjusted - 0.5 for k in plain)
    chosen = lambda offline: [r.rule_id for r in R.select_rules(R.rule_context(df), offline=offline).orderBy("place").collect()]
    assert chosen(False) == ["high"] and chosen(True) == ["high", "side", "low"]


def test_topic_hints(spark):
    samples = spark.createDataFrame([(1, "a falling body drops freely", "", ""), (2, "", "", ""), (3, None, None, None)], SAMPLES)
    hints = spark.createDataFrame([("D", "A", ["bodies falling freely", "falling body", "a falling body drops"], ["drops", "x"]), ("D", "B", None, None), ("D", "C", ["two words"], ["e"])], "domain string, topic string, phrases array<string>, terms array<string>")
    found = R.topic_hints(samples, hints)
    assert [tuple(r) for r in found.collect()] == [(1, "D", "A", 6.8)]
    scores = spark.createDataFrame([(1, "D", "A", 1.0), (2, "D", "A", 0.0)], "id int, domain string, topic string, score double")
    assert {r.id: r.score for r in R.with_hints(scores, found).collect()} == {1: 7.8, 2: 0.0}
    assert R.topic_hints(samples.limit(0), hints).isEmpty() and R.topic_hints(samples, hints.limit(0)).isEmpty()


def test_large_and_small_catalogs_score_alike(spark, sf, monkeypatch):
    """Rules by the numbers of what they look for, or, where there are too many, by its spelling."""
    from rulespan.plans import retrieval as Q

    want = sorted(map(tuple, Q.hinted_rules(spark, sf).collect()))
    monkeypatch.setattr(R, "listed", lambda phrases: None)
    assert want and sorted(map(tuple, Q.hinted_rules(spark, sf).collect())) == want


@pytest.mark.parametrize(("name", "table"), [("navigate_tree", "documents"), ("merge_judgments", "documents"), ("sweep_grid", "documents"), ("rerank_rules", "documents"), ("inject_rules", "benchmark")])
def test_context_is_made_once(spark, sf, name, table):
    """What a query reads more than once of the scored rules is kept: its plan goes back to no text and no rule."""
    from rulespan import plans

    assert not [f for f in plans.QUERIES[name](spark, sf).inputFiles() if f"{table}.parquet" in f]


def test_parts_of_texts_are_not_put_together(spark):
    texts = spark.createDataFrame([(i, "a few words") for i in range(40)], "id int, hay string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1 and R.spread(texts).rdd.getNumPartitions() == n
    keywords = R.extract_keywords(texts, ["id"], R.F.col("hay"), 2)
    keywords.collect()
    assert keywords._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") and keywords.rdd.getNumPartitions() == n


def test_unique_tokens_where_they_lie(spark):
    """First spellings in their order, without a row for each token."""
    df = spark.createDataFrame([(1, "The cat, the CAT 一二 x_1 X_1 é-the"), (2, " .,"), (3, None), (4, "b B a")], "id int, text string")
    got = R.unique_tokens(df, "id", "text")
    assert {r["id"]: r["tokens"] for r in got.collect()} == {1: "The cat 一二 x_1", 4: "b a"}
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_hints_and_signals_share_one_search(spark, sf):
    plan = plans.QUERIES["hinted_topics"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_hinted_scores_are_scores_with_hints(spark):
    r = spark.createDataFrame([(1, "r", "D", "T", "alpha beta", "gamma delta", "omega law", 1, False)], RULES)
    samples = spark.createDataFrame([(1, "alpha beta", "", "gamma rotor"), (2, "rotor stator", "", ""), (3, None, None, None)], SAMPLES)
    hints = spark.createDataFrame([("D", "T", ["rotor stator", "rotor gamma"], ["rotor", "law", ""]), ("D", "other", ["rotor stator"], ["rotor"])], "domain string, topic string, phrases array<string>, terms array<string>")
    signals = R.topic_signals(r)
    want = R.with_hints(R.topic_scores(samples, signals), R.topic_hints(samples, hints))
    rows = lambda df: sorted(tuple(x) for x in df.select("id", "domain", "topic", "score", "anchored").collect())
    got = rows(R.topic_scores(samples, signals, hints))
    assert got == rows(want) and len(got) == 3


@pytest.mark.parametrize("name", ["quota_select", "applicable_specs"])
def test_what_is_found_stays_dealt_by_id(spark, sf, name):
    """After the search nothing is shuffled by id a second time, where Spark would put parts together by their few bytes."""
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(id#" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)


def test_question_without_taking_all_lines_apart(spark, tmp_path):
    texts = ["one", "", "\nsecond", "first\nsecond\n", "first\r\n\n", None]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    df = roles.samples(spark, str(tmp_path))
    assert [r["question"] for r in df.orderBy("id").collect()] == ["one", "", "", "first", "first\r", None]
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()
