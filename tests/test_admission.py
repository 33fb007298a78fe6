"""Admission of written checks, case by case and in a table."""

import pytest

from rulespan import plans
from rulespan.operators import admission as N

GOOD = "def f(sample):\n    return {'result': 'pass'}"


@pytest.mark.parametrize(
    ("code", "said"),
    [
        (GOOD, "ok"),
        ("x = re.compile('a')\n" + GOOD, "ok"),
        (None, "must_contain_exactly_one_function"),
        ("", "must_contain_exactly_one_function"),
        (GOOD + "\n" + GOOD, "must_contain_exactly_one_function"),
        ("def f(sample:", "syntax_error"),
        ("def f(sample):\0", "syntax_error"),
        (GOOD.replace("f(", "g("), "function_name_mismatch: g"),
        (GOOD.replace("sample", "a, b"), "invalid_signature_args: ['a', 'b']"),
        ("import os\n" + GOOD, "banned_node: Import"),
        ("class A: pass\n" + GOOD, "banned_node: ClassDef"),
        ("def f(sample):\n    return eval('1')", "banned_call: eval"),
        ("def f(sample):\n    return sample['no']", "runtime_error: 'no'"),
        ("def f(sample):\n    raise SystemExit(1)", "runtime_error: 1"),
        ("def f(sample):\n    return 1", "probe_not_dict"),
        ("def f(sample):\n    return {'result': 'maybe'}", "probe_bad_result"),
    ],
)
def test_verdict(code, said):
    assert N.verdict("f", code).startswith(said)


def test_a_check_that_never_ends():
    for code in ("while True: pass\n" + GOOD, "def f(sample):\n    while True: pass"):
        assert N.verdict("f", code, 1.0) == "probe_timeout"


def test_all_faults_with_their_lines():
    code = "def g(a):\n    import os\n    eval('1')\nclass B: pass\n"
    assert N.faults("f", code) == [(1, "function_name_mismatch: g"), (1, "invalid_signature_args: ['a']"), (4, "banned_node: ClassDef"), (2, "banned_node: Import"), (3, "banned_call: eval")]


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("import os; x = 1\n" + GOOD, "import os; x = 1\n" + GOOD),
        ("import numpy as np\n" + GOOD, "import numpy as np\n" + GOOD),
        ("é = 1\nif é:\n    import re\n    def ü(sample): return é", "é = 1\nif é:\n\n    def f(sample): return é"),
        ("text = 'def g(x)'\ndef h(sample): pass", "text = 'def g(x)'\ndef f(sample): pass"),
        ("def g(sample:", "def g(sample:"),
    ],
)
def test_tidy(code, want):
    assert N.tidy("f", code) == want


def test_tidied(spark):
    rows = [("f", "```python\nimport re\nfrom a import b\ndef g (sample):\n    return g_x  \n```"), (None, "def g(s): pass"), ("f", None), ("f", "no function")]
    got = [r.code for r in N.tidied(spark.createDataFrame(rows, "name string, code string")).collect()]
    assert got == ["def f(sample):\n    return g_x", "def g(s): pass", "", "no function"]


def test_admitted_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "f", GOOD, "old", "x"), (1, "f", GOOD, "old", "x"), (2, None, None, None, None)], "id int, name string, code string, reason string, `__code` string")
    got = N.admitted(df)
    assert got.columns == ["id", "name", "code", "__code", "reason", "admitted"]
    assert [(r.id, r.admitted) for r in got.orderBy("id").collect()] == [(1, True), (1, True), (2, False)]
    assert N.admitted(df.limit(0)).isEmpty()


def test_query(spark, sf):
    got = {r.rule_id: r for r in plans.QUERIES["admitted_checks"](spark, sf).collect()}
    for rule, r in got.items():
        k = int(rule[4:]) % 7
        assert r.admitted == (k < 2), r
        assert r.reason.startswith(["ok", "ok", "probe_bad_result", "banned_call: eval", "invalid_signature_args: ['text']", "syntax_error", "runtime_error: 'missing'"][k])
    assert len(got) == spark.read.parquet(f"{sf}/benchmark.parquet").count()
