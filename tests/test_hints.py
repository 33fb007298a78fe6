"""Classes of rules, symbols and scenes, and budgets, on cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from rulespan.operators import hints as H


@pytest.mark.parametrize(
    ("symbol", "strong"),
    [("R_E", True), ("dt", True), ("q", False), ("ab", False), ("ISS", True), ("emf", False), ("V2", True), ("a1b", True), ("ABC", True), ("Abc", False), ("velo", True), ("x/y", True), ("", False), (None, False), ("的", False)],
)
def test_strong_symbols(spark, symbol, strong):
    assert spark.createDataFrame([(symbol,)], "s string").select(H.strong_symbol(F.col("s"))).first()[0] == strong


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (("sin and cos", "", None), (True, False, False, "meta")), (("sin and cos", "of a coil", ""), (False, False, False, "domain")), (("sin", "", ""), (False, False, False, "domain")),
        (("Binary System", "双星", ""), (False, True, False, "meta")), (("binary system", "", ""), (False, False, False, "domain")), (("read graph", "", ""), (False, False, True, "domain")), ((None, None, None), (False, False, False, "domain")),
    ],
)
def test_profiles(spark, texts, want):
    df = spark.createDataFrame([texts], "title string, trigger string, check_logic string")
    assert tuple(H.retrieval_profile(df).select("generic_math", "narrow", "meta_hint", "scope").first()) == want


def test_scenes(spark):
    scenes = ["coil in a magnetic field", "verify it", "this or that", "mass", "spring", "spring", "orbit of a satellite", "something very long without it", "", None, "open the circuit", "短时"]
    got = H.refined_scenes(spark.createDataFrame([("T", s) for s in scenes], "topic string, scene string")).orderBy("place").collect()
    assert [r["scene"] for r in got] == ["orbit of a satellite", "coil in a magnetic field", "spring"]
    assert H.refined_scenes(spark.createDataFrame([("T", f"spring{i}") for i in range(30)], "topic string, scene string")).count() == 16


def test_lifts(spark):
    rows = [("D", "A", "heat flows", None, "shared"), ("D", "A", "heat stays", "", "shared"), ("D", "B", "light bends", "", "shared"), ("D", "C", "sound", "energy", "")]
    got = {(r["topic"], r["term"]): (r["n"], r["lift"], r["class"]) for r in H.contrastive_terms(spark.createDataFrame(rows, "domain string, topic string, title string, trigger string, check_logic string")).collect()}
    assert got["A", "heat"] == (2, round((2.5 / 3) / (0.5 / 3), 6), "narrow") and got["C", "energy"][2] == "generic"
    assert got["A", "shared"] == (2, round((2.5 / 3) / (1.5 / 3), 6), "generic") and ("C", "shared") not in got


def test_budgets_take_whole_items(spark):
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([3, 4, 5, 1])] + [(2, 0, "x" * 99)], "k int, i int, item string")
    got = H.within_budget(df, "k", ["i"], F.length("item"), 3, 11).orderBy("i").collect()
    assert [(r["k"], len(r["item"])) for r in got] == [(1, 3), (1, 4)]
    assert H.within_budget(df, "k", ["i"], F.length("item"), 1, 99).count() == 2


def test_summary(spark):
    texts = spark.createDataFrame([(1, "v_max is m then v_max"), (2, None), (3, "")], "key int, text string")
    parsed = spark.createDataFrame([(1, 0, 0, "a = b"), (1, 1, 0, "c = d")], "key int, line int, no int, raw string")
    got = {r["key"]: (r["symbols"], r["formulas"], r["preview"]) for r in H.context_summary(texts, parsed, "key", "text", formulas=1, budget=9).collect()}
    assert got == {1: (["v_max:2"], ["a = b"], "v_max is "), 2: ([], [], ""), 3: ([], [], "")}


def test_capitals_letter_by_letter(spark):
    from rulespan.functions import text as T

    rows = [("erßie ﬁ Éa\n🙂ǰ",), ("",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").select(T.upper(F.col("x"))).collect()] == ["ERẞIE ﬁ ÉA\n🙂ǰ", "", None]


def test_queries_on_sharp_s_and_own_titles(spark, tmp_path):
    """Rules with ß in their words, and titles that are replaced before their symbols are read, as in the SQL."""
    import duckdb

    from rulespan import plans
    from tests.test_queries import rows

    texts = [(i, f"erßie {w} vier word{i} and more of it") for i, w in enumerate(["plain", "alpha", "ßa", "bare", "quiet", "x", "y", "long"] * 8)]
    spark.createDataFrame(texts, "item_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    for name in ("flat_library", "strong_symbols", "topic_quality"):
        assert rows(plans.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(duck.sql(plans.ORACLES[name]).df()), name
