"""JSON out of free text: whole, fenced, embedded or cut off; and the normal forms of what it holds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The severities of a diagnostic; anything else counts as info.
SEVERITIES = ["error", "warning", "info"]
#: The inside of a JSON string. Unrolled, so that long strings do not recurse in the JVM's matcher.
STRING = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
DIAGNOSTICS = "struct<diagnostics: array<struct<severity: string, rule: string, symbol: string, message: string, detail: string, evidence: struct<quote: string>>>>"


def _close(text: str) -> str:
    """The first object or array of ``text``, with what a cut-off end leaves open closed again."""
    first = re.search(r"[{\[]", text)
    if not first:
        return text
    text, waiting, cut = text[first.start() :].rstrip(), [], ""
    for m in re.finditer(r'"(?:\\.|[^"\\])*("?)|[{}\[\]]', text, re.S):
        if m[0][0] == '"':
            cut = "" if m[1] else text[: m.end()] + '"'
        elif m[0] in "{[":
            waiting.append("}" if m[0] == "{" else "]")
        elif waiting:
            waiting.pop()
            if not waiting:
                return text[: m.end()]
    text = cut or text
    if waiting and waiting[-1] == "}":  # a key without its value goes
        text = re.sub(r'([{,]\s*)"(?:\\.|[^"\\])*"\s*:?\s*$', r"\1", text)
    return re.sub(r",\s*$", "", text) + "".join(reversed(waiting))


def _readings(text: str) -> Iterator[str]:
    """What may be the JSON of a text, the plainest reading first."""
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", text.strip(), flags=re.I) if text.lstrip().startswith("```") else text.strip()
    yield body
    for pattern in (r"```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", r"(\{.*\})", r"(\[.*\])"):
        if m := re.search(pattern, body, re.S | re.I):
            yield m[1]


def _object(text: str | None, key: str, repair: bool) -> str | None:
    readings = list(_readings(text or ""))
    for reading in [*readings, *[_close(readings[0])] * repair]:
        try:
            value = json.loads(reading)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
        if key and isinstance(value, list):
            return json.dumps({key: value}, ensure_ascii=False)
    return None


def json_object(x: Column, list_key: str = "", repair: bool = False) -> Column:
    """The JSON object in a text, as JSON, or null: the whole text, else a fenced block, else the widest braces.

    With ``list_key`` an array counts too, as an object with that one key. With ``repair`` a text whose end is missing
    is closed: its last string, array and object.
    """

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _object(t, list_key, repair))

    return read(x)


def _unescaped(x: Column) -> Column:
    """The text of a JSON string, white space collapsed; as it stands where its escapes are faulty."""
    return T.norm_text(F.coalesce(F.from_json(F.concat(F.lit('{"v":"'), x, F.lit('"}')), "v string")["v"], x))


def scraped_errors(x: Column) -> Column:
    """Distinct (error, quote, paragraph_index) of a text that holds objects but is no JSON.

    Innermost braces with an "error" count; where none has one, every "error" outside them. Missing quotes are empty,
    missing indexes -1; items without a text go.
    """
    of = lambda block, name: _unescaped(F.regexp_extract(block, rf'(?s)"{name}"\s*:\s*{STRING}', 1))
    index = lambda block: F.coalesce(F.regexp_extract(block, r'"paragraph_index"\s*:\s*([0-9]+)', 1).try_cast("int"), F.lit(-1))
    item = lambda e, q, p: F.struct(e.alias("error"), q.alias("quote"), p.alias("paragraph_index"))
    stated = lambda items: F.array_distinct(F.filter(items, lambda i: i["error"] != ""))
    text = F.coalesce(x, F.lit(""))
    blocks = stated(F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*+\}"), F.lit(0)), lambda b: item(of(b, "error"), of(b, "quote"), index(b))))
    loose = stated(F.transform(F.regexp_extract_all(text, F.lit(rf'(?s)"error"\s*:\s*{STRING}'), F.lit(1)), lambda e: item(_unescaped(e), F.lit(""), F.lit(-1))))
    return F.when(F.size(blocks) > 0, blocks).otherwise(loose)


def stated_diagnostics(x: Column) -> Column:
    """(message, quote) of the diagnostics of a JSON object; those with neither go."""
    trim = lambda c: F.trim(F.coalesce(c, F.lit("")))
    items = F.transform(F.from_json(x, DIAGNOSTICS)["diagnostics"], lambda d: F.struct(trim(d["message"]).alias("message"), trim(d["evidence"]["quote"]).alias("quote")))
    return F.coalesce(F.filter(items, lambda d: (d["message"] != "") | (d["quote"] != "")), F.array().cast("array<struct<message: string, quote: string>>"))


def clamped_diagnostics(x: Column) -> Column:
    """(severity, rule, symbol, message, quote) of the diagnostics of a JSON object: an unknown severity is info, an
    empty message is taken from detail."""

    def item(d: Column) -> Column:
        severity, message = F.lower(d["severity"]), F.coalesce(F.nullif(d["message"], F.lit("")), d["detail"], F.lit(""))
        return F.struct(F.when(severity.isin(SEVERITIES), severity).otherwise("info").alias("severity"), d["rule"].alias("rule"), d["symbol"].alias("symbol"), message.alias("message"), d["evidence"]["quote"].alias("quote"))

    items = F.filter(F.from_json(x, DIAGNOSTICS)["diagnostics"], lambda d: d.isNotNull())
    return F.coalesce(F.transform(items, item), F.array().cast("array<struct<severity: string, rule: string, symbol: string, message: string, quote: string>>"))
