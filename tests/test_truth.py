"""Ground truth of mixed age against a restatement in Python."""

import json
import random

from rulespan.operators import location as L
from rulespan.operators import truth as G
from rulespan.plans import truth as P
from tests.test_verify import window


def whole(v):
    try:
        return int(v)
    except (TypeError, ValueError):
        return None


def entries_by_hand(sample, row):
    out = []
    new = isinstance(row, dict) and isinstance(row.get("physics_error_gt"), list)
    items = row.get("physics_error_gt" if new else "physics_error_examples") if isinstance(row, dict) else []
    for i, e in enumerate(items if isinstance(items, list) else [], 1):
        if not isinstance(e, dict):
            continue
        text = str((new and e.get("error_text") or "").strip() or (e.get("error") or "").strip())
        if not text:
            continue
        if not new:
            out.append((sample, i, f"{sample}_legacy_e{i}", text, "", -1, -1, False, -1, False))
            continue
        start, end, part = whole(e.get("start_char")), whole(e.get("end_char")), whole(e.get("paragraph_index"))
        span = bool(e.get("span_valid")) or (start is not None and end is not None and 0 <= start < end)
        quote = (e.get("answer_quote") or "").strip() or (e.get("quote") or "").strip()
        out.append((sample, i, e.get("error_id") or f"{sample}_e{i}", text, quote, -1 if start is None else start, -1 if end is None else end, span, -1 if part is None else part, bool(e.get("paragraph_valid")) or (part is not None and part >= 1)))
    return out


COLUMNS = ["sample", "no", "error_id", "error_text", "quote", "start", "end", "span_valid", "paragraph", "paragraph_valid"]


def test_entries_of_random_rows(spark):
    rng = random.Random(5)
    pick = lambda *v: rng.choice(v)
    rows = []
    for i in range(150):
        entry = lambda: pick(None, 3, "x", {"error_text": pick("", " a "), "error": pick("b", "", " "), "quote": pick("q", ""), "answer_quote": pick("", " p "), "start_char": pick(None, 0, 5, "7", "x", -3), "end_char": pick(None, 9, "12", 5), "span_valid": pick(True, False), "paragraph_index": pick(None, 0, 1, "2"), "paragraph_valid": pick(True, False), "error_id": pick("", "own", None)}, {"error": "only"})
        row = pick({"physics_error_gt": [entry() for _ in range(3)], "physics_error_examples": [{"error": "no"}]}, {"physics_error_examples": [entry() for _ in range(3)]}, {"physics_error_gt": "none", "physics_error_examples": [entry()]}, {"physics_error_gt": []}, {}, [1])
        rows.append((i, json.dumps(row)))
    bad = [(900, "{"), (901, None), (902, "")]
    got = G.gt_entries(spark.createDataFrame(rows + bad, "sample int, json string")).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(e for i, j in rows for e in entries_by_hand(i, json.loads(j)))


def located(text, quote):
    for hay, needle, how in ((text, quote, "exact"), (text.lower(), quote.lower(), "case")):
        if needle in hay:
            return hay.index(needle), hay.index(needle) + len(quote), how
    found = L._fuzzy(text, quote)
    return (found[0], found[1], found[3]) if found else None


def fill_by_hand(e, text):
    e, bounds, source = dict(e), L.paragraph_bounds(text), None
    if not e["span_valid"] and e["quote"].strip():
        found = located(text, e["quote"])
        if found:
            e.update(start=found[0], end=found[1], span_valid=True, span_source=f"fallback_{found[2]}", line=-1)
            source = "from_quote_context"
    if e["span_valid"] and e["line"] <= 0 and e["start"] >= 0:
        e["line"] = text[: e["start"]].count("\n") + 1
    if e["span_valid"] and not e["paragraph_valid"]:
        inside = [k for k, (a, b) in enumerate(bounds, 1) if a <= e["start"] < b]
        if inside:
            w = window(text, e["start"], e["end"])
            e.update(paragraph=inside[0], paragraph_start=w[0], paragraph_end=w[1], paragraph_valid=True, paragraph_source=source or "from_span_context")
    if not e["paragraph_valid"] and 1 <= e["paragraph"] <= len(bounds):
        a, b = bounds[e["paragraph"] - 1]
        e.update(paragraph_start=a, paragraph_end=b, paragraph_valid=True, paragraph_source=e["paragraph_source"] or "model_declared")
    e["locatable"] = e["span_valid"] or e["paragraph_valid"]
    return e


def test_filled_as_by_hand(spark, sf):
    texts = {r["sample"]: r["text"] for r in P._rows(spark, sf).collect()}
    before = [r.asDict() for r in P.gt_entries(spark, sf).collect()]
    got = {(r["sample"], r["no"]): r.asDict() for r in P.gt_filled(spark, sf).collect()}
    assert len(got) == len(before) and any(r["paragraph_source"] == "from_quote_context" for r in got.values())
    for e in before:
        assert got[e["sample"], e["no"]] == fill_by_hand(e, texts[e["sample"]])


def test_filled_declared_paragraphs_and_lost_texts(spark):
    text = "One two three.\n\nFour five six.\n\n" + "Seven eight nine. " * 40
    schema = "sample int, no int, quote string, start int, end int, line int, span_valid boolean, span_source string, paragraph int, paragraph_start int, paragraph_end int, paragraph_valid boolean, paragraph_source string, more string"
    rows = [(1, 1, "", -1, -1, -1, False, "", 2, -1, -1, False, "", "x"), (1, 2, "", -1, -1, -1, False, "", 99, -1, -1, False, "", "x"), (1, 3, "four  FIVE", -1, -1, -1, False, "", -1, -1, -1, False, "", None), (2, 1, "four", -1, -1, -1, False, "", 1, -1, -1, False, "", "x"), (3, 1, "a", 4, 9, -1, True, "m", -1, -1, -1, False, "", "x")]
    df = spark.createDataFrame(rows, schema)
    got = {(r["sample"], r["no"]): r.asDict() for r in G.filled(df, spark.createDataFrame([(1, text), (3, None)], "sample int, text string")).collect()}
    assert len(got) == 5
    for r in rows:
        e = dict(zip(df.columns, r, strict=True))
        if e["sample"] == 1:
            assert got[1, e["no"]] == fill_by_hand(e, text)
    assert not got[2, 1]["locatable"] and got[3, 1]["locatable"] and got[3, 1]["start"] == 4
    assert G.filled(df.limit(0), spark.createDataFrame([(1, text)], "sample int, text string")).isEmpty()


def test_texts_are_read_before_paragraphs(spark, sf):
    """The texts, and the paragraphs of these, are read once: what is joined twice is written without them."""
    from rulespan import plans

    plan = plans.QUERIES["gt_filled"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "text" not in plan.replace("error_text", "").replace("text_from", "").replace("context", "")
