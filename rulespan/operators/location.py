"""Where a quote stands in a text, and how texts fall into paragraphs."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import spread

SPAN = "struct<start:int, end:int, confidence:double, how:string, ambiguous:boolean>"


def locate_exact(df: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """``df`` with start (code points from 0, or -1) and confidence: 1.0 exact, 0.9 without regard to case, 0 not found."""
    exact = F.expr(f"locate(`{quote}`, `{text}`)")
    loose = F.expr(f"locate(lower(`{quote}`), lower(`{text}`))")
    empty = F.coalesce(F.length(quote) == 0, F.lit(True))
    return df.withColumn("start", F.when(empty, -1).when(exact > 0, exact - 1).when(loose > 0, loose - 1).otherwise(-1)).withColumn("confidence", F.when(empty, 0.0).when(exact > 0, 1.0).when(loose > 0, 0.9).otherwise(0.0))


def _fuzzy(text: str, quote: str) -> tuple[int, int, float, str, bool] | None:
    words = quote.split()
    if not words:
        return None
    loose = [m.span() for m in re.finditer(r"\s+".join(map(re.escape, words)), text, re.I)]
    if loose:
        return *loose[0], 0.75, "whitespace", len(loose) > 1
    kept = [(c.lower(), i) for i, c in enumerate(text) if c.isalnum()]
    plain, wanted = "".join(c[0] for c, _ in kept), "".join(c.lower()[0] for c in quote if c.isalnum())
    at = plain.find(wanted) if wanted else -1
    if at < 0:
        return None
    return kept[at][1], kept[at + len(wanted) - 1][1] + 1, 0.7, "normalised", plain.find(wanted, at + 1) >= 0


def locate(df: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """``df`` with span: exact, else without regard to case, else with any white space, else letters and digits alone.

    Only rows that the native steps leave open go through Python.
    """
    found = locate_exact(df, text, quote)
    n = F.length(quote)
    again = F.when(F.col("confidence") == 1.0, F.expr(f"locate(`{quote}`, `{text}`, start + 2)")).otherwise(F.expr(f"locate(lower(`{quote}`), lower(`{text}`), start + 2)"))
    how = F.when(F.col("confidence") == 1.0, "exact").otherwise("case")
    native = found.where("confidence > 0").withColumn("span", F.struct(F.col("start").alias("start"), (F.col("start") + n).alias("end"), F.col("confidence").alias("confidence"), how.alias("how"), (again > 0).alias("ambiguous")).cast(SPAN)).drop("start", "confidence")

    @F.pandas_udf(SPAN)
    def fuzzy(texts: pd.Series, quotes: pd.Series) -> pd.DataFrame:
        rows = [(_fuzzy(t or "", q or "") or (-1, -1, 0.0, "not_found", False)) for t, q in zip(texts, quotes, strict=True)]
        return pd.DataFrame(rows, columns=["start", "end", "confidence", "how", "ambiguous"])

    rest = found.where("confidence = 0").drop("start", "confidence").withColumn("span", fuzzy(F.col(text), F.col(quote)))
    return native.unionByName(rest)


#: Where a paragraph may end: after a mark that ends a sentence before white space, and after line feeds.
_ENDS = re.compile(r"[。！？!?；;](?:\s+|$)|\n+")


def paragraph_bounds(text: str, target: int = 220, least: int = 120, most: int = 360) -> list[tuple[int, int]]:
    """Greedy paragraphs without the white space around them: each ends at the boundary nearest ``target`` between ``least``
    and ``most``, or at ``most``; a rest of ``most`` or less is the last one. Blank ones are left out."""
    ends = sorted({0, len(text), *(m.end() for m in _ENDS.finditer(text))})
    out, start = [], 0
    while start < len(text):
        stop = len(text)
        if stop - start > most:
            near = ends[bisect_left(ends, start + least) : bisect_right(ends, start + most)]
            stop = min(near, key=lambda e: abs(e - start - target)) if near else start + most
        own = text[start:stop]
        if own.strip():
            first = start + len(own) - len(own.lstrip())
            out.append((first, first + len(own.strip())))
        start = stop
    return out


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph, start, end) of every paragraph of every text, counted from 1; a blank text has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, a, b) for k, t in zip(f[key], f[text], strict=True) for i, (a, b) in enumerate(paragraph_bounds(t or ""), 1)]
            yield pd.DataFrame(rows, columns=[key, "paragraph", "start", "end"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, paragraph int, start int, end int")


def paragraph_of(spans: DataFrame, bounds: DataFrame, key: str = "sample") -> DataFrame:
    """``spans`` (key, start, …) with the paragraph that holds their start, or null: a range join inside a key."""
    b = bounds.select(key, "paragraph", F.col("start").alias("__s"), F.col("end").alias("__e"))
    on = (spans[key] == b[key]) & (F.col("__s") <= spans["start"]) & (spans["start"] < F.col("__e"))
    return spans.join(b, on, "left").select(*(spans[c] for c in spans.columns), "paragraph")


def context_window(text: Column, start: Column, end: Column, left: int = 90, right: int = 120, most: int = 320) -> Column:
    """A struct (start, end): a span with ``left`` and ``right`` characters around it, grown to whole words by less than 50
    characters, cut to ``most`` around the middle, without white space at its ends; -1 for an invalid span."""
    n, at = F.length(text), lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    room = lambda used, limit: F.greatest(F.lit(0), F.lit(limit + 50) - used)

    def grown(w: Column) -> Column:
        s, e = w["s"], w["e"]
        back = F.length(F.regexp_extract(F.substring(text, F.greatest(F.lit(1), s - room(start - s, left) + 1), F.least(s, room(start - s, left))), r"(?U)\S*$", 0))
        ahead = F.length(F.regexp_extract(F.substring(text, e + 1, room(e - end, right)), r"(?U)^\S*", 0))
        return at(s - back, e + ahead)

    def shortened(w: Column) -> Column:
        middle = F.greatest(F.lit(0), F.floor((start + end) / 2).cast("int") - most // 2)
        wide = w["e"] - w["s"] > most
        return at(F.when(wide, middle).otherwise(w["s"]), F.when(wide, F.least(n, middle + most)).otherwise(w["e"]))

    def trimmed(w: Column) -> Column:
        s, e = w["s"], w["e"]
        own = F.substring(text, s + 1, e - s)
        lead, tail = F.length(F.regexp_extract(own, r"(?U)^\s*", 0)), F.length(F.regexp_extract(own, r"(?U)\s*$", 0))
        ok = (start >= 0) & (end > start) & (n > 0) & (lead < e - s)
        return F.struct(F.when(ok, s + lead).otherwise(-1).cast("int").alias("start"), F.when(ok, e - tail).otherwise(-1).cast("int").alias("end"))

    # Each step is computed once as an element of an array: written out at every use, the code of a row is more than is compiled.
    w = F.array(at(F.greatest(F.lit(0), start - left), F.least(n, end + right)))
    for step in (grown, shortened, trimmed):
        w = F.transform(w, step)
    return F.get(w, F.lit(0))


def infer_paragraph(items: DataFrame, bounds: DataFrame, texts: DataFrame, key: str = "sample") -> DataFrame:
    """``items`` (key, no, declared, start, words) with paragraph and source: the declared one if the text has it, else the
    one that holds the start of the span, else the one that shares most words with the item, the first of these."""
    b = bounds.join(texts.select(key, "text"), key).select(key, "paragraph", F.col("start").alias("__s"), F.col("end").alias("__e"), evaluator_tokens(F.expr("substring(text, start + 1, end - start)")).alias("__w"))
    both = items.join(b, key, "left")
    holds = (F.col("__s") <= F.col("start")) & (F.col("start") < F.col("__e"))
    shared = F.size(F.array_intersect("words", "__w"))
    g = both.groupBy(key, "no").agg(F.max(F.when(F.col("paragraph") == F.col("declared"), F.col("paragraph"))).alias("d"), F.min(F.when(holds, F.col("paragraph"))).alias("s"), F.max(F.when(shared > 0, F.struct(shared.alias("n"), (-F.col("paragraph")).alias("p")))).alias("w"))
    at = F.coalesce("d", "s", -F.col("w.p"))
    source = F.when(F.col("d").isNotNull(), "declared").when(F.col("s").isNotNull(), "span").when(at.isNotNull(), "words").otherwise("none")
    return g.select(key, "no", at.alias("paragraph"), source.alias("source"))


def evaluator_tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and underscores of three or more, in lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= 3))


def span_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two spans; 0 for empty ones."""
    both = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    union = (e1 - s1) + (e2 - s2) - both
    return F.when(union > 0, both / union).otherwise(0.0)


#: Characters of a stretch, and of one for paragraphs; two spans that overlap have one in common.
STRETCH, WIDE_STRETCH = 64, 256
#: The first stretch of a span that touches none.
_NEVER = 1 << 40


def stretches(start: Column, end: Column) -> Column:
    """The numbers of the stretches that a span touches; none for an empty or unknown span or one before the text."""
    at = lambda c: F.floor(c / STRETCH)
    return F.when((end > start) & (start >= 0), F.sequence(at(start), at(end - 1))).otherwise(F.array().cast("array<bigint>"))


def match_candidates(truth: DataFrame, found: DataFrame, key: str = "sample") -> DataFrame:
    """(key, gt, pred, iou, coverage, span_score, paragraph_score) of the pairs of one sample that may match: spans that
    overlap score IoU and a hundredth of the better coverage; paragraphs that overlap, or have one number, score shared
    words, their own IoU and a twentieth of the better coverage.

    Both sides: key, no, start, end, paragraph, p_start, p_end, words; nulls where a span or paragraph is unknown. Only
    what shares a stretch of text or a paragraph number meets, at the first that it shares.
    """
    g, p = (df.select(key, *(F.col(c).alias(f"{side}_{c}") for c in ("no", "start", "end", "paragraph", "p_start", "p_end", "words"))) for side, df in (("g", truth), ("p", found)))
    c = F.col

    def overlap(name: str, a: str, b: str) -> dict[str, Column]:
        """What two spans share, and whether they overlap, as columns: written out at every use it is more code than is compiled."""
        both = F.coalesce(F.least(c(f"g_{b}"), c(f"p_{b}")) - F.greatest(c(f"g_{a}"), c(f"p_{a}")), F.lit(0))
        return {name: both, f"{name}_ok": F.coalesce((both > 0) & (c(f"g_{a}") >= 0) & (c(f"p_{a}") >= 0), F.lit(False))}

    def shares(name: str, a: str, b: str) -> tuple[Column, Column]:
        """IoU, and the better coverage, of spans that overlap."""
        wide = F.greatest(c(f"g_{b}"), c(f"p_{b}")) - F.least(c(f"g_{a}"), c(f"p_{a}"))
        return c(name) / wide, F.greatest(c(name) / (c(f"g_{b}") - c(f"g_{a}")), c(name) / (c(f"p_{b}") - c(f"p_{a}")))

    def touched(name: str, a: Column, b: Column, ok: Column, size: int) -> dict[str, Column]:
        """The first and last stretch of a span as columns; of an unknown one such that it shares none."""
        ok = ok & (b > a) & (a >= 0)
        return {f"{name}_first": F.when(ok, F.floor(a / size)).otherwise(_NEVER), f"{name}_last": F.when(ok, F.floor((b - 1) / size)).otherwise(-1)}

    # A place is one number: three times that of a stretch of the span, of a stretch of the paragraph plus 1, or of the paragraph plus 2.
    def placed(df: DataFrame, side: str) -> DataFrame:
        own, number = lambda x: c(f"{side}_{x}"), c(f"{side}_paragraph")
        df = df.withColumns(touched(f"{side}_span", own("start"), own("end"), F.lit(True), STRETCH) | touched(f"{side}_region", own("p_start"), own("p_end"), number >= 1, WIDE_STRETCH))
        none = F.array().cast("array<bigint>")
        run = lambda x, kind: F.when(own(f"{x}_last") >= 0, F.sequence(3 * own(f"{x}_first") + kind, 3 * own(f"{x}_last") + kind, F.lit(3).cast("bigint"))).otherwise(none)
        return df.withColumn("__place", F.explode(F.concat(run("span", 0), run("region", 1), F.when(number >= 1, F.array(3 * number.cast("bigint") + 2)).otherwise(none))))

    low = lambda x: F.greatest(f"g_{x}_first", f"p_{x}_first")
    share = lambda x: low(x) <= F.least(f"g_{x}_last", f"p_{x}_last")
    first = F.when(share("span"), 3 * low("span")).when(share("region"), 3 * low("region") + 1).otherwise(3 * c("g_paragraph").cast("bigint") + 2)
    met = placed(g, "g").join(placed(p, "p"), [key, "__place"]).where(c("__place") == first)
    met = met.withColumns(overlap("__span", "start", "end") | overlap("__region", "p_start", "p_end"))
    known = (c("g_paragraph") >= 1) & (c("p_paragraph") >= 1)
    near = known & (c("__region_ok") | (c("g_paragraph") == c("p_paragraph")))
    rows = met.withColumn("__near", F.coalesce(near, F.lit(False))).where("__span_ok OR __near")
    iou, cov = shares("__span", "start", "end")
    r_iou, r_cov = shares("__region", "p_start", "p_end")
    rows = rows.withColumns({"iou": F.when(c("__span_ok"), iou).otherwise(0.0), "coverage": F.when(c("__span_ok"), cov).otherwise(0.0), "__region_score": F.when(c("__region_ok"), r_iou + 0.05 * r_cov).otherwise(0.0)})
    score = F.size(F.array_intersect("g_words", "p_words")) + c("__region_score")
    return rows.select(key, c("g_no").alias("gt"), c("p_no").alias("pred"), "iou", "coverage", F.when(c("__span_ok"), c("iou") + 0.01 * c("coverage")).alias("span_score"), F.when(c("__near"), score.cast("double")).alias("paragraph_score"))


def greedy_match(pairs: DataFrame, key: str = "sample", least_iou: float = 0.5, least_coverage: float = 0.6) -> DataFrame:
    """(key, gt, pred, iou, kind): one-to-one matches of :func:`match_candidates`.

    Each truth in its order takes the free prediction of the best span, the first on a tie; only where no free one
    overlaps its span, the best paragraph. A span counts with enough IoU or coverage; one that does not, blocks the
    paragraph. The order matters, so that a sample's pairs go through one task in order; of these the task keeps only which
    predictions are taken and the best pairs of one truth.
    """
    names = [key, "gt", "pred", "iou", "coverage", "span_score", "paragraph_score"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, span, near = None, set(), None, None  # the truth whose pairs come, and the best free ones of it

        def settled() -> list[tuple]:
            if span and (span[1] >= least_iou or span[2] >= least_coverage):
                row = (*at, *span[:2], "span")
            elif near and not span:
                row = (*at, near[0], 0.0, "paragraph")
            else:
                return []
            used.add(row[2])
            return [row]

        for f in frames:
            out = []
            for sample, truth, pred, iou, coverage, s, p in zip(*(f[c].tolist() for c in names), strict=True):
                if (sample, truth) != at:
                    out += settled()
                    if at is None or at[0] != sample:
                        used = set()
                    at, span, near = (sample, truth), None, None
                if pred in used:
                    continue
                if s == s:  # not a NaN
                    if span is None or s > span[3]:
                        span = (pred, iou, coverage, s)
                elif p == p and (near is None or p > near[1]):
                    near = (pred, p)
            yield pd.DataFrame(out, columns=[key, "gt", "pred", "iou", "kind"])
        yield pd.DataFrame(settled(), columns=[key, "gt", "pred", "iou", "kind"])

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    ordered = spread(pairs.select(*names), key).sortWithinPartitions(key, "gt", "pred", "iou", "coverage")
    return ordered.mapInPandas(run, f"`{key}` {kind[key]}, gt {kind['gt']}, pred {kind['pred']}, iou double, kind string")


def quotes_of(rules: DataFrame, n: int = 40) -> DataFrame:
    """(rule_id, quote): the first ``n`` characters of each rule's trigger."""
    return rules.select("rule_id", F.substring(T.norm_text(F.col("trigger")), 1, n).alias("quote")).where(F.length("quote") == n)
