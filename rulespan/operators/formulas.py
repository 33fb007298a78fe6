r"""Algebra of formulas: parsing to postfix, values, equivalence by fingerprints, exponents of power laws.

Only the parser is Python, in Arrow batches over distinct formulas. A parsed formula is an array of strings in postfix order that
a fold over the array evaluates inside the JVM, so that values, roots and exponents of millions of formulas are plain columns.
Formulas are never compared in pairs: equal ones meet in a join on fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Relations that count as equality, functions, commands that are only layout, and constants.
EQUALITY = [r"\approx", r"\sim", r"\propto", "≈", "∼", "∝", "~"]
FUNCTIONS = ["sqrt", "sin", "cos", "tan", "ln", "log", "exp", "abs"]
LAYOUT = [r"\left", r"\right", r"\,", r"\;", r"\!", r"\:", r"\quad", "$"]
CONSTANTS = {"pi": "3.141592653589793", "π": "3.141592653589793"}

_TOKEN = re.compile(r"\\(?:mathrm|text|mathbf|vec|hat)\s*\{\s*(\w+)\s*\}|(\d+(?:\.\d+)?|\.\d+)|\\([A-Za-z]+)|(" + "|".join(FUNCTIONS) + r")(?![A-Za-z_])|([^\W\d_])|([-+*/^(){}\[\]_|])|\s+|(.)", re.DOTALL)
_SUBSCRIPT = re.compile(r"\s*_\s*(?:\{\s*\\(?:mathrm|text)\s*\{\s*([\w,]+)\s*\}\s*\}|\{\s*([\w,]+)\s*\}|(\w+))")
_TIMES, _OVER = {"cdot", "times"}, {"frac", "dfrac", "tfrac"}
_CLOSING = {"(": ")", "{": "}", "[": "]"}


def _tokens(side: str) -> list[tuple[str, str]]:
    """(kind, text) of one side of a formula: number, name, function, frac or sign."""
    out, at = [], 0
    while at < len(side):
        m = _TOKEN.match(side, at)
        at = m.end()
        wrapped, number, command, function, letter, sign, other = m.groups()
        if other:
            raise ValueError(other)
        if number:
            out.append(("number", number))
        elif function or command in FUNCTIONS:
            out.append(("function", function or command))
        elif command in _TIMES:
            out.append(("sign", "*"))
        elif command in _OVER:
            out.append(("frac", ""))
        elif (wrapped or command or letter) in CONSTANTS:
            out.append(("number", CONSTANTS[wrapped or command or letter]))
        elif wrapped or command or letter:
            name = wrapped or command or letter
            sub = _SUBSCRIPT.match(side, at)
            if sub:
                name, at = f"{name}_{sub[sub.lastindex]}", sub.end()
            out.append(("name", name))
        elif sign:
            out.append(("sign", sign))
    return out


class _Parser:
    """Precedence climbing over the tokens of one side; ``out`` is the postfix."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at, self.out = tokens, 0, []

    def next_sign(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "sign" else ""

    def take(self, sign: str) -> None:
        if self.next_sign() != sign:
            raise ValueError(f"{sign} expected")
        self.at += 1

    def total(self) -> None:
        self.product()
        while (sign := self.next_sign()) in ("+", "-"):
            self.at += 1
            self.product()
            self.out.append(sign)

    def product(self) -> None:
        self.signed()
        while self.at < len(self.tokens):
            sign = self.next_sign()
            if sign in ("*", "/"):
                self.at += 1
                self.signed()
                self.out.append(sign)
            elif not sign or sign in _CLOSING:  # side by side: a product
                self.power()
                self.out.append("*")
            else:
                break

    def signed(self) -> None:
        if (sign := self.next_sign()) in ("+", "-"):
            self.at += 1
            self.signed()
            if sign == "-":
                self.out.append("neg")
        else:
            self.power()

    def power(self) -> None:
        self.atom()
        self.raised()

    def raised(self) -> None:
        if self.next_sign() == "^":
            self.at += 1
            self.signed()
            self.out.append("^")

    def group(self) -> None:
        opening = self.next_sign()
        if opening not in _CLOSING:
            raise ValueError("group expected")
        self.at += 1
        self.total()
        self.take(_CLOSING[opening])

    def atom(self) -> None:
        if self.at >= len(self.tokens):
            raise ValueError("end of formula")
        kind, text = self.tokens[self.at]
        if kind in ("number", "name"):
            self.at += 1
            self.out.append(text)
        elif kind == "frac":
            self.at += 1
            self.group()
            self.group()
            self.out.append("/")
        elif kind == "function":
            self.at += 1
            self.applied(text)
        else:
            self.group()

    def applied(self, function: str) -> None:
        """A function of the next factor; an exponent or a root's degree may stand before it."""
        late: list[str] = []
        own, self.out = self.out, []
        if function == "sqrt" and self.next_sign() == "[":
            self.group()
            late, self.out = ["1", *self.out, "/", "^"], []
        elif self.next_sign() == "^":
            self.at += 1
            self.signed()
            late, self.out = [*self.out, "^"], []
        if self.next_sign() in _CLOSING:
            self.group()
        else:
            self.power()
        own += self.out if function == "sqrt" and late[:1] == ["1"] else [*self.out, function]
        self.out = own + late


def parsed(formula: str) -> list[str] | None:
    """The postfix of a formula, with ``=`` last if it is an equation; None if it is none that can be read."""
    text = formula
    for sign in EQUALITY:
        text = text.replace(sign, "=")
    for layout in LAYOUT:
        text = re.sub(re.escape(layout) + (r"(?![A-Za-z])" if layout[-1].isalpha() else ""), " ", text)
    sides = text.strip().rstrip(".,").split("=")
    if len(sides) > 2:
        return None
    out: list[str] = []
    try:
        for side in sides:
            parser = _Parser(_tokens(side))
            parser.total()
            if parser.at < len(parser.tokens):
                return None
            out += parser.out
    except (ValueError, RecursionError):
        return None
    return [*out, "="] if len(sides) == 2 else out


@F.pandas_udf(ArrayType(StringType()))
def postfix(formula: pd.Series) -> pd.Series:
    """:func:`parsed` as a column function; null for null."""
    return formula.map(lambda f: None if f is None else parsed(f))


_BINARY, _UNARY = ["+", "-", "*", "/", "^", "="], ["neg", *FUNCTIONS]


def names(code: Column) -> Column:
    """The distinct names in a postfix, sorted."""
    return F.array_sort(F.array_distinct(F.filter(code, lambda t: t.rlike(r"^[^\W\d]") & ~t.isin(_UNARY))))


def evaluate(code: Column, value: Callable[[Column], Column]) -> Column:
    """The value of a postfix where a name has a ``value``; an equation's is left side less right side. Null where it is not
    defined in real numbers."""

    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        a, b = F.get(stack, n - 2), F.get(stack, n - 1)
        two = F.when(t == "+", a + b).when(t.isin("-", "="), a - b).when(t == "*", a * b).when(t == "/", F.try_divide(a, b)).otherwise(F.pow(a, b))
        one = F.when(t == "neg", -b).when(t == "sqrt", F.sqrt(b)).when(t == "sin", F.sin(b)).when(t == "cos", F.cos(b)).when(t == "tan", F.tan(b)).when(t == "ln", F.ln(b)).when(t == "log", F.log10(b)).when(t == "exp", F.exp(b)).otherwise(F.abs(b))
        number = t.rlike(r"^[.\d]")
        leaf = F.when(number, t.try_cast("double")).otherwise(value(t))
        return F.when(t.isin(_BINARY), F.concat(F.slice(stack, 1, F.greatest(n - 2, F.lit(0))), F.array(two))).when(t.isin(_UNARY), F.concat(F.slice(stack, 1, F.greatest(n - 1, F.lit(0))), F.array(one))).otherwise(F.concat(stack, F.array(leaf)))

    found = F.aggregate(code, F.array().cast("array<double>"), step, lambda s: F.get(s, F.lit(0)))
    return F.when(~F.isnan(found) & (F.abs(found) < 1e150), found)


def root(code: Column, name: Column, value: Callable[[Column], Column], sign: Column, octaves: int = 30, steps: int = 52) -> Column:
    """A value of ``name`` of the given ``sign`` at which an equation holds, by bisection; null if none is found.

    Of the octaves 2^-30 to 2^30 in which the equation's two sides change places the one nearest to 1 is halved. A place where
    they jump, as at a pole, is no root.
    """
    at = lambda x: evaluate(code, lambda t: F.when(t == name, x).otherwise(value(t)))
    once = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))
    tried = F.transform(F.sequence(F.lit(-octaves), F.lit(octaves)), lambda j: once(sign * F.pow(F.lit(2.0), j), lambda x: F.struct(F.abs(j).alias("j"), x.alias("x"), at(x).alias("f"))))

    def halved(t: Column) -> Column:
        change = lambda p, q: p["f"] * q["f"] <= 0
        pairs = F.zip_with(F.slice(t, 1, 2 * octaves), F.slice(t, 2, 2 * octaves), lambda p, q: F.when(change(p, q), F.struct(F.least(p["j"], q["j"]).alias("j"), p["x"].alias("a"), q["x"].alias("b"), p["f"].alias("fa"), F.greatest(F.abs(p["f"]), F.abs(q["f"])).alias("size"))))
        first = F.array_min(F.filter(pairs, lambda p: p.isNotNull()))

        def step(s: Column, _: Column) -> Column:
            def half(x: Column) -> Column:
                same = F.signum(at(x)) == F.signum(s["fa"])
                return F.struct(s["j"].alias("j"), F.when(same, x).otherwise(s["a"]).alias("a"), F.when(same, s["b"]).otherwise(x).alias("b"), s["fa"].alias("fa"), s["size"].alias("size"))

            return F.when(s.isNotNull(), once((s["a"] + s["b"]) / 2, half))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step, lambda s: once((s["a"] + s["b"]) / 2, lambda x: F.when(F.abs(at(x)) <= 1e-6 * s["size"], x)))

    return once(tried, halved)


def point(name: Column, k: Column) -> Column:
    """A number between 1/2 and 5/2 that depends on a name and on the number of a point only."""
    return 0.5 + F.conv(F.substring(F.md5(F.concat(name, F.lit("#"), k.cast("string"))), 1, 7), 16, 10).cast("double") / float(16**7) * 2


def fingerprints(df: DataFrame, code: str = "postfix", points: int = 4) -> DataFrame:
    """``df`` with fingerprint, one row for each that a formula has: a formula without = has its values at some points, an
    equation for each of its names the value of that name where it holds. Equal formulas share one, whatever
    their form; rows without a postfix or a value have none and are left out.

    Half of the roots are looked for from below zero, so that ``y^2 = x^2`` and ``y = x`` differ.
    """
    c, every = F.col(code), F.sequence(F.lit(0), F.lit(points - 1))
    digits = lambda x: F.when(x.isNull(), "-").when(F.abs(x) < 1e-9, "0").otherwise(F.format_string("%.6e", x))
    df = df.where(c.isNotNull()).withColumn("__names", names(c))
    is_equation = F.element_at(c, -1) == "="
    own = df.withColumn("__solved", F.explode_outer(F.when(is_equation, F.col("__names"))))
    value = lambda k: lambda t: point(t, k)
    found = F.transform(every, lambda k: F.when(is_equation, root(c, F.col("__solved"), value(k), F.when(k % 2 == 0, 1.0).otherwise(-1.0))).otherwise(evaluate(c, value(k))))
    seen = own.withColumn("__values", F.transform(found, digits)).where(F.exists("__values", lambda v: v != "-") & (~is_equation | F.col("__solved").isNotNull()))
    key = F.concat_ws(" ", F.array_join("__names", ","), F.coalesce("__solved", F.lit("=")), F.array_join("__values", " "))
    return seen.withColumn("fingerprint", F.md5(key)).drop("__names", "__solved", "__values")


def formula_classes(df: DataFrame) -> DataFrame:
    """(formula, n, readable, class) of the distinct formulas of a table with a column ``formula``: how often each stands there,
    whether it can be read, and the smallest formula that is equal to it (itself if none is). Null formulas are left out."""
    counted = df.where("formula IS NOT NULL").groupBy("formula").agg(F.count("*").alias("n")).withColumn("postfix", postfix("formula"))
    prints = fingerprints(counted.select("formula", "postfix")).select("formula", "fingerprint").distinct()
    least = prints.groupBy("fingerprint").agg(F.min("formula").alias("least"))
    classes = prints.join(least, "fingerprint").groupBy("formula").agg(F.min("least").alias("least"))
    return counted.join(classes, "formula", "left").select("formula", "n", F.col("postfix").isNotNull().alias("readable"), F.coalesce("least", "formula").alias("class"))


def equivalent(df: DataFrame, forms: DataFrame) -> DataFrame:
    """Rows of ``df`` (…, formula) with each form_id of ``forms`` (form_id, form) that is equal to the formula as an
    equation or as a term. Distinct formulas and forms are parsed once and meet by fingerprint."""
    prints = lambda d, c: fingerprints(d.select(F.col(c).alias("__f")).where("__f IS NOT NULL").distinct().withColumn("postfix", postfix("__f"))).select("__f", "fingerprint").distinct()
    both = prints(df, "formula").join(prints(forms, "form").withColumnRenamed("__f", "__g"), "fingerprint").select("__f", "__g").distinct()
    return df.join(both, F.col("formula") == F.col("__f")).join(forms, F.col("__g") == F.col("form")).drop("__f", "__g", "form")


def power_laws(df: DataFrame, code: str = "postfix") -> DataFrame:
    """``df`` (…, dependent, independent) with exponent: p where an equation makes ``dependent`` a constant times
    ``independent`` to the power p, all other names being 1; else null. The ratio of its values must be the same at two places."""
    c, dep, ind = F.col(code), F.col("dependent"), F.col("independent")
    at = lambda x: root(c, dep, lambda t: F.when(t == ind, x).otherwise(1.0), F.lit(1.0))
    y = F.transform(F.array(*(F.lit(x) for x in (1.0, 2.0, 1.7, 3.4))), at)
    seen = df.withColumn("__y", F.when((F.element_at(c, -1) == "=") & F.array_contains(c, dep) & F.array_contains(c, ind) & (dep != ind), y))
    ratio = lambda a, b: F.try_divide(F.get("__y", F.lit(b)), F.get("__y", F.lit(a)))
    same = F.abs(ratio(0, 1) - ratio(2, 3)) <= 1e-7 * F.abs(ratio(0, 1))
    return seen.withColumn("exponent", F.when(same & (ratio(0, 1) > 0), F.round(F.log2(ratio(0, 1)), 6) + 0.0)).drop("__y")
