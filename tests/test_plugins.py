"""Plugins in their three forms, and stand-in checks."""

import pytest
from pyspark.sql import functions as F

from rulespan.operators import plugins as U


def found(df):
    return sorted((r["id"], r["rule"], r["severity"], r["message"], r["quote"], r["failed"]) for r in df.collect())


def long(n):
    return F.when(F.length("prediction") > n, F.array(F.struct(F.lit("error").alias("severity"), F.lit("long").alias("message"), F.col("prediction").alias("quote"))))


def test_plugins_run_together(spark):
    s = spark.createDataFrame([(1, "no violation"), (2, "abcdef"), (3, None)], "id int, prediction string")
    own = U.Registry(U.Plugin("long", column=lambda: long(5)), U.Plugin("first", check=lambda x: [{"message": x["prediction"][0]}, {"severity": "info"}]), U.says_nothing(), U.Plugin("all", table=lambda t: t.select("id", F.lit("warning").alias("severity"), F.lit("m").alias("message"), F.lit("q").alias("quote"))))
    assert own.ids() == ["all", "first", "long", "says_nothing"] and own.get("none") is None
    every = [(i, "all", "warning", "m", "q", False) for i in (1, 2, 3)]
    first = [(1, "first", "error", "n", "", False), (1, "first", "info", "", "", False), (2, "first", "error", "a", "", False), (2, "first", "info", "", "", False), (3, "first", "info", "TypeError", "", True)]
    nothing = [(i, "says_nothing", "info", "says that nothing is wrong", "", False) for i in (1, 3)]
    assert found(own.run(s)) == sorted([*every, *first, *nothing, (1, "long", "error", "long", "no violation", False), (2, "long", "error", "long", "abcdef", False)])
    assert found(own.run(s, ["all"])) == every and found(own.run(s, [])) == [] and found(own.run(s.limit(0))) == []
    own.register(U.Plugin("long", column=lambda: long(99)))
    assert found(own.run(s, ["long"])) == []
    with pytest.raises(KeyError):
        own.run(s, ["none"])


def test_a_plugin_has_one_form():
    for forms in ({}, {"check": len, "table": len}):
        with pytest.raises(ValueError, match="exactly one"):
            U.Plugin("x", **forms)


def test_stand_in_checks(spark):
    s = spark.createDataFrame([(1, "Q of Energy", None, None), (2, None, None, None)], "id int, question string, context string, prediction string")
    r = spark.createDataFrame([("a", "an it", "Energy flows", None), ("b", "Flow", "energy", ""), ("c", None, None, None)], "rule_id string, title string, trigger string, check_logic string")
    pairs = spark.createDataFrame([(i, x) for i in (1, 2) for x in "abc"] + [(1, "unknown")], "id int, rule_id string")
    got = sorted((x["id"], x["rule_id"], x["result"], x["evidence"]) for x in U.fallback_checks(s, r, pairs).collect())
    assert got == [(1, "a", "fail", "energy"), (1, "b", "fail", "energy"), (1, "c", "inconclusive", None), (2, "a", "inconclusive", None), (2, "b", "inconclusive", None), (2, "c", "inconclusive", None)]
