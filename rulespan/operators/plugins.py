"""Rules as plugins: registered under an id, run together over one scan of the samples, each with the same columns of findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from ..functions import text as T
from .phrase_index import found_sets
from .retrieval import spread

_FINDING = StructType().add("rule", StringType()).add("severity", StringType()).add("message", StringType()).add("quote", StringType()).add("failed", BooleanType())
_SQL = "array<struct<severity:string,message:string,quote:string>>"


@dataclass(frozen=True)
class Plugin:
    """A rule in one of three forms: ``column`` makes an array of (severity, message, quote) out of the samples' columns, ``check`` lists
    dictionaries with these keys for one sample, ``table`` makes rows (id, severity, message, quote) of all samples."""

    id: str
    title: str = ""
    description: str = ""
    column: Callable[[], Column] | None = None
    check: Callable[[dict], list[dict]] | None = None
    table: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        if sum(form is not None for form in (self.column, self.check, self.table)) != 1:
            raise ValueError(f"plugin {self.id} needs exactly one of column, check and table")


class Registry:
    """Plugins by id; a later one takes the place of an earlier one with its id."""

    def __init__(self, *plugins: Plugin):
        self._own: dict[str, Plugin] = {}
        for plugin in plugins:
            self.register(plugin)

    def register(self, plugin: Plugin) -> None:
        self._own[plugin.id] = plugin

    def get(self, rule_id: str) -> Plugin | None:
        return self._own.get(rule_id)

    def ids(self) -> list[str]:
        return sorted(self._own)

    def run(self, samples: DataFrame, ids: list[str] | None = None) -> DataFrame:
        """(id, rule, severity, message, quote, failed) of the plugins ``ids`` (all, if none are named) on ``samples`` (id, …).

        Columns and checks share one scan; all checks go through Python in one pass. A check that raises on a sample gives one
        row with failed and the name of the error, and costs no other row. An id that is not registered is a KeyError.
        """
        chosen = [self._own[i] for i in (self.ids() if ids is None else ids)]
        columns, checks, tables = ([p for p in chosen if getattr(p, form)] for form in ("column", "check", "table"))
        marked = [_marked(p) for p in columns]
        if checks:
            marked.append(_checked({p.id: p.check for p in checks})(F.struct(*samples.columns)))
        found = [samples.select("id", F.explode(F.concat(*marked)).alias("f")).select("id", "f.*")] if marked else []
        found += [p.table(samples).select("id", F.lit(p.id).alias("rule"), "severity", "message", "quote", F.lit(False).alias("failed")) for p in tables]
        if not found:
            return samples.select("id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in _FINDING)).limit(0)
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def _marked(plugin: Plugin) -> Column:
    """A plugin's column with its id in every finding."""
    own = F.coalesce(plugin.column().cast(_SQL), F.array().cast(_SQL))
    return F.transform(own, lambda x: F.struct(F.lit(plugin.id).alias("rule"), x["severity"].alias("severity"), x["message"].alias("message"), x["quote"].alias("quote"), F.lit(False).alias("failed")))


def _checked(checks: dict[str, Callable[[dict], list[dict]]]):
    @F.pandas_udf(ArrayType(_FINDING))
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.to_dict("records"):
            found = []
            for rule, check in checks.items():
                try:
                    own = [{"rule": rule, "severity": str(d.get("severity") or "error"), "message": str(d.get("message") or ""), "quote": str(d.get("quote") or ""), "failed": False} for d in check(dict(row))]
                except Exception as e:  # a faulty plugin must not stop a batch
                    own = [{"rule": rule, "severity": "info", "message": type(e).__name__, "quote": "", "failed": True}]
                found += own
            out.append(found)
        return pd.Series(out)

    return run


def fallback_keys(rules: DataFrame) -> DataFrame:
    """``rules`` (title, trigger, check_logic, …) with keys: the first six words of three characters or more, in lower case."""
    said = F.lower(F.trim(F.concat_ws(" ", "title", "trigger", "check_logic")))
    return rules.withColumn("keys", F.slice(F.filter(F.split(said, r"(?U)\s+"), lambda w: F.length(w) >= 3), 1, 6))


def fallback_checks(samples: DataFrame, rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rule_id, result, evidence) for each of ``pairs`` (id, rule_id): what stands in for a check that nobody wrote. It fails
    with the first of its rule's :func:`fallback_keys` that stands in the sample, and is inconclusive without one.

    ``samples`` (id, question, context, prediction). Each distinct key is looked for once in a text.
    """
    hay = F.lower(F.concat_ws(" ", "question", "prediction", "context"))
    keyed = fallback_keys(rules).select("rule_id", "keys")
    found = found_sets(spread(samples.select("id", hay.alias("hay"))), keyed.select(F.explode("keys").alias("phrase")), alone=False)
    both = pairs.select("id", "rule_id").join(keyed, "rule_id").join(found, "id")
    first = F.get(F.array_intersect("keys", "found"), F.lit(0))
    return both.select("id", "rule_id", F.when(first.isNotNull(), "fail").otherwise("inconclusive").alias("result"), first.alias("evidence"))


def graph_consistency(formulas: Callable[[DataFrame], DataFrame]) -> Plugin:
    """Self-references, undefined symbols and conflicting definitions as a plugin; ``formulas`` gives (id, finding, symbol, n)."""
    message = F.concat(F.col("finding"), F.lit(" of "), F.col("symbol"), F.lit(": "), F.col("n").cast("string"))
    return Plugin("graph_consistency", "Symbol graph", "definitions and uses of symbols agree", table=lambda s: formulas(s).select("id", F.lit("warning").alias("severity"), message.alias("message"), F.col("symbol").alias("quote")))


def says_nothing() -> Plugin:
    """Predictions that only say that nothing is wrong."""
    blank = F.array(F.struct(F.lit("info").alias("severity"), F.lit("says that nothing is wrong").alias("message"), F.lit("").alias("quote")))
    return Plugin("says_nothing", column=lambda: F.when(T.is_negative(F.col("prediction"), F.lit("")), blank))
