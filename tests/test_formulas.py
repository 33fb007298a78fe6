"""Formulas against Python's own arithmetic, equalities and exponents known by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rulespan.operators import formulas as A

VALUES = {"x": 1.7, "y": 0.6, "z": 2.3, "v_max": 1.2}


def values(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, formula string").withColumn("postfix", A.postfix("formula"))
    value = F.create_map(*(F.lit(v) for kv in VALUES.items() for v in kv))
    return [r["v"] for r in df.withColumn("v", A.evaluate(F.col("postfix"), lambda t: F.get(F.array(value), F.lit(0))[t])).orderBy("i").collect()]


def random_term(rng, depth=4):
    """(LaTeX, Python) of one term."""
    if depth == 0 or rng.random() < 0.15:
        name = rng.choice([*VALUES, "2", "0.5"])
        return (name if name[0] != "v" else "v_{max}"), name
    (a, pa), (b, pb) = random_term(rng, depth - 1), random_term(rng, depth - 1)
    return rng.choice([
        (f"({a} + {b})", f"({pa} + {pb})"), (rf"{{{a}}} \cdot ({b})", f"({pa}) * ({pb})"), (rf"\frac{{{a}}}{{{b}}}", f"(({pa}) / ({pb}))"), (rf"\sqrt{{{a}}}", f"sqrt({pa})"),
        (rf"\left({a}\right)^2", f"(({pa}) ** 2)"), (rf"(-({a}) - {{{b}}})", f"(-({pa}) - ({pb}))"), (rf"\sin({a})", f"sin({pa})"), (rf"({a})({b})", f"(({pa}) * ({pb}))"), (f"{{{a}}}/({b})", f"({pa}) / ({pb})"),
    ])


def test_terms_as_python_counts_them(spark):
    rng = random.Random(8)
    pairs = [random_term(rng) for _ in range(300)]
    for (tex, code), got in zip(pairs, values(spark, [t for t, _ in pairs]), strict=True):
        try:
            want = eval(code, {"sqrt": math.sqrt, "sin": math.sin}, VALUES)  # of our own terms
        except (ValueError, ZeroDivisionError, OverflowError):
            want = None
        assert got == (want if want is None else pytest.approx(want, rel=1e-9)), tex


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("2x y", 2 * 1.7 * 0.6), ("-x^2", -(1.7**2)), ("x^{-1}", 1 / 1.7), ("2^x^y", 2 ** (1.7**0.6)), (r"\sin^2 x + \cos^2 x", 1), (r"\sqrt[3]{z}", 2.3 ** (1 / 3)), ("x - y - z", 1.7 - 0.6 - 2.3), ("x / y / z", 1.7 / 0.6 / 2.3), (r"2\pi", 2 * math.pi), (r"\log 100", 2),
        (r"\mathrm{v}_{max}", 1.2), (r"v_{\mathrm{max}}.", 1.2), ("x = y", 1.7 - 0.6), (r"x \approx y,", 1.7 - 0.6), ("x = y = z", None), ("x <", None), ("(x", None), ("", None), ("x +", None), ("|x|", None), (r"\frac{x}", None), ("1/0", None), (r"\ln(y - y)", None), (None, None), ("((" * 2000, None),
    ],
)
def test_forms(spark, text, value):
    (got,) = values(spark, [text])
    assert got == (value if value is None else pytest.approx(value))


CLASSES = [
    [r"F = m a", r"a = \frac{F}{m}", "2F = 2 m a", "m = F / a", r"F - a \cdot m = 0", r"\frac{F}{m a} = 1"],
    ["F = m + a", "a = F - m"],
    [r"E_k = \frac{1}{2} m v^2", r"E_k = m v^2 / 2", r"2 E_k = m v^2"],
    [r"T = 2 \pi \sqrt{L / g}", r"T = 2\pi \sqrt{\frac{L}{g}}"],
    ["y^2 = x^2"], ["y = x", "x = y", "2y - x = y"], ["y = x^3", r"y = x \cdot x^2"],
    ["(a + b)^2", "a^2 + 2 a b + b^2"], ["a^2 + b^2"], [r"\sin(2 t)", r"2 \sin t \cos t"],
    ["x = = y"],
]


def test_classes(spark):
    rows = [(f,) for c in CLASSES for f in c] + [("y = x",), (None,)]
    got = {r["formula"]: r for r in A.formula_classes(spark.createDataFrame(rows, "formula string")).collect()}
    assert {f: r["class"] for f, r in got.items()} == {f: min(c) for c in CLASSES for f in c}
    assert got["y = x"]["n"] == 2 and not got["x = = y"]["readable"]


def test_equivalent_to_forms(spark):
    forms = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CLASSES)] + [(99, None)], "form_id int, form string")
    rows = [(k, f) for k, f in enumerate(f for c in CLASSES for f in c)] + [(-1, None), (-2, "F = q E")]
    got = A.equivalent(spark.createDataFrame(rows, "key int, formula string"), forms).collect()
    readable = [i for i, c in enumerate(CLASSES) for _ in c if c[0] != "x = = y"]
    assert sorted((r["key"], r["form_id"]) for r in got) == list(enumerate(readable))


@pytest.mark.parametrize(
    ("formula", "dependent", "independent", "exponent"),
    [("T = k r^{1.5}", "T", "r", 1.5), (r"T = 2\pi\sqrt{L/g}", "T", "g", -0.5), ("F = m a", "a", "m", -1.0), ("F = m a", "F", "F", None), ("y = x + b", "y", "x", None), ("y = x^2 - x", "y", "x", None), (r"E = \frac{1}{2} m v^2", "v", "m", -0.5), ("F = m a", "F", "q", None), ("y x", "y", "x", None), ("?", "y", "x", None)],
)
def test_power_laws(spark, formula, dependent, independent, exponent):
    df = spark.createDataFrame([(formula, dependent, independent)], "formula string, dependent string, independent string")
    (row,) = A.power_laws(df.withColumn("postfix", A.postfix("formula"))).collect()
    assert row["exponent"] == exponent


def test_no_formulas(spark):
    none = spark.createDataFrame([], "formula string")
    assert A.formula_classes(none).isEmpty()


def test_queries_of_formulas(spark, sf):
    """Classes and exponents of the formulas of whole tables, against the shapes that they are written from."""
    from rulespan.plans import structure as S

    written = S._written(spark, sf).collect()
    shape = {r["formula"]: (r["shape"], r["k"]) for r in written}
    got = S.formula_classes(spark, sf).collect()
    assert shape.keys() <= {r["formula"] for r in got}
    for r in got:
        if r["formula"] in shape:
            same = [g["formula"] for g in got if g["class"] == r["class"] and g["formula"] in shape]
            assert {shape[f] for f in same} == {shape[r["formula"]]} and r["class"] == min(g["formula"] for g in got if g["class"] == r["class"])
            assert {f for f in shape if shape[f] == shape[r["formula"]]} == set(same)
    powers = {0: {("F", "m"): 1, ("a", "m"): -1, ("m", "F"): 1}, 1: {("T", "L"): 0.5, ("T", "g"): -0.5, ("g", "T"): -2}, 2: {("E_k", "v"): 2, ("v", "E_k"): 0.5, ("m", "v"): -2}, 3: {("y", "x"): None, ("b", "y"): None}}
    found = {(shape[r["formula"]][0], r["dependent"], r["independent"]): r["exponent"] for r in S.power_laws(spark, sf).collect()}
    for no, known in powers.items():
        for (a, b), p in known.items():
            assert found[no, a, b] == p, (no, a, b)
