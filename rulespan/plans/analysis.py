"""Queries over diagnostics, evaluations, the catalog, vectors and samples; each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import admission as N
from ..operators import analysis as A
from ..operators import location as L
from ..operators.roles import RULES_SQL, SAMPLES_SQL, rules, samples, table


def _located(spark: SparkSession, d: str) -> DataFrame:
    """Quotes of samples in their own text: 40 characters from a third of it, with the case swapped for odd ids."""
    n = F.length("prediction")
    s = samples(spark, d).where(n >= 60)
    quote = F.substring("prediction", (n / 3).cast("int") + 1, F.lit(40))
    return s.select("id", F.col("prediction").alias("text"), F.when(F.col("id") % 2 == 1, F.translate(quote, "abcdefgh", "ABCDEFGH")).otherwise(quote).alias("quote"))


def quote_locate_exact(spark: SparkSession, d: str) -> DataFrame:
    return L.locate_exact(_located(spark, d)).select("id", "start", "confidence")


def quote_locate_cascade(spark: SparkSession, d: str) -> DataFrame:
    loose = _located(spark, d).withColumn("quote", F.regexp_replace("quote", " ", "  "))
    return L.locate(loose).select("id", "span.*")


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return L.paragraphs(samples(spark, d), "id", "prediction")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """(sample, no, gs, ge, ps, pe): spans of 60 characters every 80 over the whole text, and others shifted by the id."""
    n = F.length("prediction")
    s = samples(spark, d).where(n >= 100).select("id", n.alias("n"))
    no = F.explode(F.sequence(F.lit(0), (F.col("n") / 100).cast("int")))
    return s.select(F.col("id").alias("sample"), no.alias("no"), (F.col("id") % 17).alias("shift")).select("sample", "no", (F.col("no") * 80).alias("gs"), (F.col("no") * 80 + 60).alias("ge"), (F.col("no") * 80 + F.col("shift")).alias("ps"), (F.col("no") * 80 + 60 + F.col("shift")).alias("pe"))


def span_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d)
    side = lambda name, a, b: s.select("sample", F.col("no").alias(name), a, b, F.explode(L.stretches(F.col(a), F.col(b))).alias("stretch"))
    met = side("gt", "gs", "ge").join(side("pred", "ps", "pe"), ["sample", "stretch"])
    first = F.floor(F.greatest("gs", "ps") / L.STRETCH)  # where both have begun: one of the stretches that they share
    return met.where("gs < pe AND ps < ge").where(F.col("stretch") == first).select("sample", "gt", "pred", F.round(L.span_iou(F.col("gs"), F.col("ge"), F.col("ps"), F.col("pe")), 6).alias("iou"))


def greedy_span_match(spark: SparkSession, d: str) -> DataFrame:
    s = _spans(spark, d).withColumn("words", F.array().cast("array<string>"))
    none = {c: F.lit(None).cast("int") for c in ("paragraph", "p_start", "p_end")}
    side = lambda a, b: s.select("sample", "no", F.col(a).alias("start"), F.col(b).alias("end"), "words").withColumns(none)
    return L.greedy_match(L.match_candidates(side("gs", "ge"), side("ps", "pe")))


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Candidate diagnostics from the turns of conversations: sample, pos, rule, paragraph, quote, score."""
    t = table(spark, d, "conversations").where("text is not null")
    return t.select(F.col("conv_id").alias("sample"), F.col("turn").alias("pos"), F.concat(F.lit("r"), F.col("turn") % 3).alias("rule"), (F.col("turn") % 2).alias("paragraph"), T.fold(T.norm_text(F.col("text"))).alias("quote"), (F.length("text") % 10).cast("double").alias("score"))


def diag_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return A.dedupe_best(_diagnostics(spark, d), ["sample", "quote", "paragraph"], [F.desc("score"), F.col("pos")]).select("sample", "pos", "quote", "score")


def diag_caps(spark: SparkSession, d: str) -> DataFrame:
    return A.capped(_diagnostics(spark, d), "sample", "paragraph", [F.desc("score"), F.col("pos")], 2, 3).select("sample", "pos", "paragraph", F.coalesce("dropped", F.lit("kept")).alias("state"))


def symbolic_primitives(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).select("id", "prediction", F.slice(T.symbol_set(F.col("question")), 1, 3).alias("symbols"))
    return A.required_symbols(s, "prediction", "symbols").select("id", "n_present", "result")


def experience_checks(spark: SparkSession, d: str) -> DataFrame:
    checks = {
        "has_units": lambda s: {"result": "pass" if " cm" in s["prediction"] or " kg" in s["prediction"] else "inconclusive"},
        "long_enough": lambda s: {"result": "pass" if len(s["prediction"]) > 400 else "fail", "message": str(len(s["prediction"]))},
        "faulty": lambda s: s["missing"],
    }
    return A.run_checks(samples(spark, d).select("id", "prediction"), checks)


#: Bodies of written checks, the admissible ones first.
WRITTEN = [
    "def check_{no}(sample):\n    return {{'result': 'pass' if sample['prediction'] else 'inconclusive'}}",
    "```python\nimport re\ndef other(sample):\n    return {{'result': 'fail' if re.search('kg', sample['prediction']) else 'pass'}}\n```",
    "def check_{no}(sample):\n    return {{'result': 'maybe'}}",
    "def check_{no}(sample):\n    return eval('1')",
    "def check_{no}(text):\n    return {{'result': 'pass'}}",
    "def check_{no}(sample:\n    return 1",
    "def check_{no}(sample):\n    return sample['missing']",
]


def admitted_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which of the checks written for the rules may run: one for each rule, tidied and tried."""
    no = F.col("rule_no")
    code = F.element_at(F.array(*(F.lit(w.format(no="{no}")) for w in WRITTEN)), (no % len(WRITTEN) + 1).cast("int"))
    df = rules(spark, d).select("rule_id", F.concat(F.lit("check_"), no).alias("name"), F.replace(code, F.lit("{no}"), no.cast("string")).alias("code"))
    return N.admitted(N.tidied(df)).select("rule_id", "reason", "admitted")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


def confusion_strict(spark: SparkSession, d: str) -> DataFrame:
    return A.confusion(_judged(spark, d), F.col("toxic") == 1, F.col("quality") == 0, ["lang"])


def question_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = A.confusion(_judged(spark, d), F.col("toxic") == 1, F.col("quality") == 0)
    return m.select("*", F.round(1 - A.ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("precision_proxy"))


def domain_type_cube(spark: SparkSession, d: str) -> DataFrame:
    c = rules(spark, d).cube("domain", "error_type").agg(F.count("*").alias("n"))
    return c.select(F.coalesce("domain", F.lit("*")).alias("domain"), F.coalesce("error_type", F.lit("*")).alias("error_type"), "n")


def fingerprint_distill(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).select("id", F.sha1(T.fold(T.norm_text(F.col("prediction")))).alias("fingerprint"), F.length("prediction").alias("n"))
    return s.groupBy("fingerprint").agg(F.count("*").alias("n_samples"), F.min(F.struct("n", "id")).alias("m")).where("n_samples >= 2").select("fingerprint", "n_samples", F.col("m.id").alias("shortest_id"))


def exact_dup_merge(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    again = r.where("rule_no % 3 = 0").withColumns({"rule_no": F.col("rule_no") + 1000, "rule_id": F.concat("rule_id", F.lit("c")), "title": F.upper("title")})
    return A.exact_duplicates(r.unionByName(again), ["domain", "topic", "title", "trigger", "check_logic", "error_type"])


def heuristic_clusters(spark: SparkSession, d: str) -> DataFrame:
    return A.heuristic_clusters(rules(spark, d), 3, 1)


def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules(spark, d).agg(F.count_distinct("domain").alias("n_domains"), F.count_distinct("domain", "topic").alias("n_topics"), F.count("*").alias("n_rules"), F.count_if("is_meta").alias("n_meta"))


def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    side = lambda c, name: r.where(c).groupBy("topic").agg(F.collect_set("rule_id").alias(name))
    both = side(F.col("rule_no") % 3 != 0, "a").join(side(F.col("rule_no") % 4 != 0, "b"), "topic", "full_outer")
    n = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    shared = F.size(F.array_intersect(F.coalesce("a", F.array().cast("array<string>")), F.coalesce("b", F.array().cast("array<string>"))))
    return both.select("topic", n("a").alias("n_old"), n("b").alias("n_new"), shared.alias("n_shared"))


def catalog_validate(spark: SparkSession, d: str) -> DataFrame:
    """Violations: topics without enough rules, empty check logic, titles that several rules share."""
    r = rules(spark, d)
    thin = r.groupBy("topic").agg(F.count("*").alias("n")).where("n < 4").select(F.lit("thin_topic").alias("violation"), F.col("topic").alias("subject"))
    empty = r.where("check_logic = ''").select(F.lit("empty_logic").alias("violation"), F.col("rule_id").alias("subject"))
    title = r.groupBy(T.fold(F.col("title")).alias("k")).agg(F.count("*").alias("n"), F.min("rule_id").alias("subject")).where("n > 1").select(F.lit("shared_title").alias("violation"), "subject")
    return thin.unionByName(empty).unionByName(title)


def orphan_rules(spark: SparkSession, d: str) -> DataFrame:
    r = rules(spark, d)
    skeleton = table(spark, d, "region").select(F.concat(F.lit("T"), F.col("r_regionkey") * 2).alias("topic"))
    return r.join(skeleton, "topic", "left_anti").select("rule_id", "topic")


def residual_chunks(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("domain").orderBy("rule_no"))
    return rules(spark, d).select("domain", "rule_id", F.floor((place - 1) / 4).cast("int").alias("chunk"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def cosine_edges(spark: SparkSession, d: str) -> DataFrame:
    return A.cosine_edges(_vectors(spark, d), "label", 0.35)


def embedding_components(spark: SparkSession, d: str) -> DataFrame:
    return A.topic_components(_vectors(spark, d), "label", 0.35)


def _formula_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts with formulas: whole documents, and lines of formulas that differ by document."""
    no = F.col("doc_id")
    return table(spark, d, "documents").select(no.alias("key"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nF_net = m * a\nso v ≈ "), no % 3, F.lit(" + x_"), no % 5, F.lit(" and F_net = q * E\nx_1 < x_2, T ∝ L\nx_1 + v_max > 3.\n"), F.when(no % 2 == 0, "v_max = 2 * v_max").otherwise("done")).alias("text"))


def formula_parse(spark: SparkSession, d: str) -> DataFrame:
    f = A.formulas(_formula_texts(spark, d), "key", "text")
    return f.select("key", "line", "no", "relation", "lhs", "rhs", "head", F.array_join("symbols", " ").alias("symbols"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = _formula_texts(spark, d)
    f = A.formulas(t, "key", "text")
    return f, A.symbol_table(t, "key", "text", f)


def symbol_table(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[1]


def symbol_graph(spark: SparkSession, d: str) -> DataFrame:
    """Self-references, symbols used and not defined, and conflicting definitions."""
    return A.graph_findings(*_graph(spark, d), "key")


PRIMITIVES = [("formula_pattern", "er|the"), ("equation_equivalence", "er|in|an"), ("power_law", "qx|er"), ("compliance_phrase", "ing the"), ("required_symbols", "zq|the")]


def primitive_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each of the five primitives on every document, with words as symbols."""
    specs = F.explode(F.array(*(F.struct(F.lit(p).alias("primitive"), F.split(F.lit(w), r"\|").alias("w")) for p, w in PRIMITIVES))).alias("s")
    texts = A.read_once(samples(spark, d).select("id", "prediction"), "prediction").drop("prediction")
    df = texts.select("id", "low", "norm", specs).select("id", "low", "norm", "s.primitive", F.col("s.w").alias("required_symbols"), F.slice("s.w", 1, 1).alias("dependent"), F.slice("s.w", 2, 1).alias("independent"), F.col("s.w").alias("phrases"), F.array(F.lit("then the")).alias("canonical"))
    return A.primitive(df, "low").select("id", "primitive", "result")


def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    return A.embedding_clusters(embedding_components(spark, d), "label", 4)


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).select("id", A.hash_rank("42", F.col("id")).alias("rank")).orderBy("rank", "id").limit(50)


def stratified_splits(spark: SparkSession, d: str) -> DataFrame:
    return A.stratified_splits(table(spark, d, "documents"), "doc_id", "lang", {"smoke": 2, "test": 5, "val": 3}, "7")


def prefix_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(A.hash_rank("1", F.col("doc_id")), "doc_id"))
    df = table(spark, d, "documents").select("lang", "doc_id", rank.alias("r")).where("r <= 20")
    return df.select("lang", F.explode(F.filter(F.array(F.lit(5), F.lit(10), F.lit(20)), lambda n: n >= F.col("r"))).alias("size"), "doc_id").groupBy("lang", "size").agg(F.count("*").alias("n"), F.sum("doc_id").alias("sum_ids"))


def eval_audit_median(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.median("n_chars").alias("median_chars"))


def rollout_p95(spark: SparkSession, d: str) -> DataFrame:
    """The value at the half-even rounded index of the 95th percentile, per source; ranked inside each source."""
    # counted by value first: a window then runs over distinct values, not over the rows of a hot source
    seen = table(spark, d, "documents").groupBy("source", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source")
    df = seen.select("source", "n_chars", "c", F.sum("c").over(w.orderBy("n_chars")).alias("upto"), F.sum("c").over(w).alias("n"))
    at = F.bround(0.95 * (F.col("n") - 1)).cast("int")
    return df.where((at < F.col("upto")) & (at >= F.col("upto") - F.col("c"))).select("source", F.col("n_chars").alias("p95_chars"), "n")


def dialogue_samples(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn")
    q = F.lag("text").over(before)
    return t.select("conv_id", "turn", "role", F.length(q).alias("n_question"), F.length("text").alias("n_answer")).where("role = 'assistant'")


def ext_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: hourly counts of events, as its streaming form computes them with a watermark."""
    from ..streaming.events import windowed

    return windowed(table(spark, d, "events"))


FUNCTIONS = [quote_locate_exact, quote_locate_cascade, paragraphs, span_iou_pairs, greedy_span_match, diag_dedupe, diag_caps, symbolic_primitives, primitive_checks, formula_parse, symbol_table, embedding_clusters, experience_checks, admitted_checks, confusion_strict, question_metrics, domain_type_cube, fingerprint_distill, exact_dup_merge, heuristic_clusters, catalog_counts, catalog_diff, catalog_validate, orphan_rules, residual_chunks, cosine_edges, embedding_components, symbol_graph, hash_sample, stratified_splits, prefix_checkpoints, eval_audit_median, rollout_p95, dialogue_samples, ext_event_windows]

_LOC = f"""WITH {SAMPLES_SQL}, q0 AS (SELECT id, prediction AS text, substr(prediction, CAST(floor(length(prediction) / 3) AS INT) + 1, 40) AS q FROM samples WHERE length(prediction) >= 60),
q AS (SELECT id, text, CASE WHEN id % 2 = 1 THEN translate(q, 'abcdefgh', 'ABCDEFGH') ELSE q END AS quote FROM q0)"""
_SPANS = f"""WITH {SAMPLES_SQL}, s AS (SELECT id AS sample, unnest(range(0, 1 + CAST(floor(length(prediction) / 100) AS INT))) AS no, id % 17 AS shift FROM samples WHERE length(prediction) >= 100),
spans AS (SELECT sample, no, no * 80 AS gs, no * 80 + 60 AS ge, no * 80 + shift AS ps, no * 80 + 60 + shift AS pe FROM s)"""
_DIAG = r"""WITH diag AS (SELECT conv_id AS sample, turn AS pos, 'r' || (turn % 3) AS rule, turn % 2 AS paragraph,
    replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS quote, (length(text) % 10)::DOUBLE AS score FROM conversations WHERE text IS NOT NULL)"""
_PRF = """tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall,
    round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 6)::DOUBLE AS f1,
    round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6)::DOUBLE AS accuracy"""
_CONF = "count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn FROM labels JOIN documents USING (doc_id)"
_R = f"WITH {RULES_SQL}"
_NORM = r"trim(regexp_replace(regexp_replace(lower({}), '\\[a-z]+', ' ', 'g'), '[\\{{}}$^_~`\s]+', ' ', 'g'))"
_SYM = r"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(question, '\\?([a-zA-Z][a-zA-Z0-9_]*)', 1), lambda s: length(s) <= 20 AND lower(s) NOT IN (" + ", ".join(f"'{x}'" for x in T.NOT_SYMBOLS) + ") AND NOT (length(s) >= 4 AND NOT regexp_matches(s, '[^a-z]'))), lambda s: lower(s))))[1:3]"
_IS = "length(s) <= 20 AND lower(s) NOT IN (" + ", ".join(f"'{x}'" for x in T.NOT_SYMBOLS) + ") AND NOT (length(s) >= 4 AND NOT regexp_matches(s, '[^a-z]'))"
_SYMS = "list_distinct(list_filter(regexp_extract_all({}, '" + A._SYMBOL + "', 1), lambda s: " + _IS + "))"
_F = rf"""WITH texts AS (SELECT doc_id AS key, coalesce(text, '') || chr(10) || 'F_net = m * a' || chr(10) || 'so v ≈ ' || (doc_id % 3) || ' + x_' || (doc_id % 5) || ' and F_net = q * E' || chr(10) || 'x_1 < x_2, T ∝ L' || chr(10) || 'x_1 + v_max > 3.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'v_max = 2 * v_max' ELSE 'done' END AS text FROM documents),
    raw_lines AS (SELECT key, unnest(string_split(text, chr(10))) AS raw_x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM texts), lines AS (SELECT key, line, trim(raw_x, ' ') AS x FROM raw_lines),
    c AS (SELECT key, line, x, list_filter(list_transform(regexp_extract_all(x, '{A._CANDIDATE.replace("'", "''")}', 1), lambda c: trim(c, ' .,;:')), lambda c: c <> '') AS p FROM lines WHERE regexp_matches(x, '{A.RELATIONS}')),
    u AS (SELECT key, line, unnest(CASE WHEN len(p) > 0 THEN p ELSE [x] END) AS raw, generate_subscripts(CASE WHEN len(p) > 0 THEN p ELSE [x] END, 1) - 1 AS no FROM c),
    v AS (SELECT *, strpos(translate(raw, '=≈~∝', '~~~~'), '~') AS pos FROM u),
    w AS (SELECT key, line, no, CASE WHEN pos > 0 THEN substr(raw, pos, 1) ELSE 'unknown' END AS relation, CASE WHEN pos > 0 THEN trim(substr(raw, 1, pos - 1)) END AS lhs, CASE WHEN pos > 0 THEN trim(substr(raw, pos + 1)) ELSE raw END AS rhs FROM v),
    f AS (SELECT *, regexp_extract(coalesce(lhs, ''), '[A-Za-z][A-Za-z0-9_]*') AS head, list_sort({_SYMS.format("concat_ws(' ', lhs, rhs)")}) AS symbols FROM w)"""
_G = rf"""{_F}, found AS (SELECT DISTINCT key, unnest({_SYMS.format("raw_x")}) AS symbol FROM raw_lines),
    seen AS (SELECT key, symbol, count(*) AS n FROM (SELECT key, unnest(list_distinct(list_filter(regexp_extract_all(raw_x, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Za-z][A-Za-z0-9_]*$')))) AS symbol FROM raw_lines) GROUP BY ALL),
    used AS (SELECT key, symbol, count(*) AS n, count(*) FILTER (lhs IS NOT NULL AND head = symbol) AS d FROM (SELECT key, lhs, head, unnest(symbols) AS symbol FROM f) GROUP BY key, symbol),
    tab AS (SELECT found.key, found.symbol, coalesce(seen.n, 0) AS n_lines, coalesce(used.n, 0) AS n_used, coalesce(used.d, 0) AS n_defined FROM found LEFT JOIN seen ON seen.key = found.key AND seen.symbol = found.symbol LEFT JOIN used ON used.key = found.key AND used.symbol = found.symbol)"""
_E = """e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35),
        r(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, e.b FROM r JOIN e ON r.reached = e.a)"""
SQL = {
    "quote_locate_exact": f"""{_LOC} SELECT id, CASE WHEN strpos(text, quote) > 0 THEN strpos(text, quote) - 1 WHEN strpos(lower(text), lower(quote)) > 0 THEN strpos(lower(text), lower(quote)) - 1 ELSE -1 END AS start,
        CASE WHEN strpos(text, quote) > 0 THEN 1.0 WHEN strpos(lower(text), lower(quote)) > 0 THEN 0.9 ELSE 0 END::DOUBLE AS confidence FROM q""",
    "span_iou_pairs": f"""{_SPANS}, p AS (SELECT a.sample, a.no AS gt, b.no AS pred, a.gs, a.ge, b.ps, b.pe, greatest(0, least(a.ge, b.pe) - greatest(a.gs, b.ps)) AS i FROM spans a JOIN spans b USING (sample) WHERE a.gs < b.pe AND b.ps < a.ge)
        SELECT sample, gt, pred, round(i / ((ge - gs) + (pe - ps) - i), 6) AS iou FROM p""",
    "diag_dedupe": f"{_DIAG} SELECT sample, pos, quote, score FROM (SELECT *, row_number() OVER (PARTITION BY sample, quote, paragraph ORDER BY score DESC, pos) AS r FROM diag) WHERE r = 1",
    "diag_caps": f"""{_DIAG}, a AS (SELECT *, row_number() OVER (PARTITION BY sample, paragraph ORDER BY score DESC, pos) AS rp FROM diag),
        b AS (SELECT *, CASE WHEN rp <= 2 THEN row_number() OVER (PARTITION BY sample, rp <= 2 ORDER BY score DESC, pos) END AS rs FROM a),
        c AS (SELECT *, coalesce(rs <= 3, false) AS keep FROM b), e AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY sample, paragraph) AS kept FROM c)
        SELECT sample, pos, paragraph, CASE WHEN keep THEN 'kept' WHEN kept >= 2 THEN 'over_paragraph_cap' ELSE 'over_sample_cap' END AS state FROM e""",
    "symbolic_primitives": f"""WITH {SAMPLES_SQL}, s AS (SELECT id, {_NORM.format("prediction")} AS norm, {_SYM} AS symbols FROM samples),
        n AS (SELECT id, len(symbols) AS k, len(list_filter(symbols, lambda x: regexp_matches(norm, '(^|[^a-z0-9])' || replace(x, '_', ' ') || '([^a-z0-9]|$)'))) AS n_present FROM s)
        SELECT id, n_present, CASE WHEN k = 0 THEN 'inconclusive' WHEN n_present = k THEN 'pass' WHEN n_present = 0 THEN 'fail' ELSE 'inconclusive' END AS result FROM n""",
    "confusion_strict": f"WITH c AS (SELECT lang, {_CONF} GROUP BY lang) SELECT lang, {_PRF} FROM c",
    "question_metrics": f"WITH c AS (SELECT {_CONF}) SELECT {_PRF}, round(1 - coalesce(fp / nullif(fp + tn, 0), 0), 6)::DOUBLE AS precision_proxy FROM c",
    "domain_type_cube": f"{_R} SELECT coalesce(domain, '*') AS domain, coalesce(error_type, '*') AS error_type, count(*) AS n FROM rules GROUP BY CUBE (domain, error_type)",
    "fingerprint_distill": rf"""WITH {SAMPLES_SQL}, s AS (SELECT id, sha1(replace(lower(trim(regexp_replace(coalesce(prediction, ''), '\s+', ' ', 'g'))), 'ß', 'ss')) AS fingerprint, length(prediction) AS n FROM samples)
        SELECT fingerprint, count(*) AS n_samples, arg_min(id, n * 1000000000 + id) AS shortest_id FROM s GROUP BY fingerprint HAVING count(*) >= 2""",
    "exact_dup_merge": f"""{_R}, every AS (SELECT rule_no, rule_id, domain, topic, title, "trigger", check_logic, error_type, support FROM rules UNION ALL SELECT rule_no + 1000, rule_id || 'c', domain, topic, upper(title), "trigger", check_logic, error_type, support FROM rules WHERE rule_no % 3 = 0)
        SELECT arg_min(rule_id, rule_no) AS rule_id, count(*) AS n, CASE WHEN sum(support) > 0 THEN sum(support) ELSE count(*) END::BIGINT AS support, string_agg(rule_id, ',' ORDER BY rule_no) AS members
        FROM every GROUP BY lower(domain), lower(topic), replace(lower(title), 'ß', 'ss'), replace(lower("trigger"), 'ß', 'ss'), replace(lower(check_logic), 'ß', 'ss'), error_type""",
    "heuristic_clusters": f"{_R}, b AS (SELECT *, count(*) OVER (PARTITION BY domain, topic) AS c FROM rules) SELECT domain, topic, 'cluster_' || error_type AS cluster_id, count(*) AS n FROM b WHERE c >= 3 GROUP BY domain, topic, error_type HAVING count(*) >= 1",
    "catalog_counts": f"{_R} SELECT count(DISTINCT domain) AS n_domains, count(DISTINCT (domain, topic)) AS n_topics, count(*) AS n_rules, count(*) FILTER (is_meta) AS n_meta FROM rules",
    "catalog_diff": f"""{_R}, a AS (SELECT topic, list(rule_id) AS a FROM rules WHERE rule_no % 3 <> 0 GROUP BY topic), b AS (SELECT topic, list(rule_id) AS b FROM rules WHERE rule_no % 4 <> 0 GROUP BY topic)
        SELECT topic, coalesce(len(a), 0) AS n_old, coalesce(len(b), 0) AS n_new, coalesce(len(list_intersect(a, b)), 0) AS n_shared FROM a FULL JOIN b USING (topic)""",
    "catalog_validate": f"""{_R} SELECT 'thin_topic' AS violation, topic AS subject FROM rules GROUP BY topic HAVING count(*) < 4 UNION ALL SELECT 'empty_logic', rule_id FROM rules WHERE check_logic = ''
        UNION ALL SELECT 'shared_title', min(rule_id) FROM rules GROUP BY replace(lower(title), 'ß', 'ss') HAVING count(*) > 1""",
    "orphan_rules": f"{_R} SELECT rule_id, topic FROM rules WHERE topic NOT IN (SELECT 'T' || (r_regionkey * 2) FROM region)",
    "residual_chunks": f"{_R} SELECT domain, rule_id, CAST(floor((row_number() OVER (PARTITION BY domain ORDER BY rule_no) - 1) / 4) AS INT) AS chunk FROM rules",
    "cosine_edges": "SELECT x.label, x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.35",
    "embedding_components": f"""WITH RECURSIVE {_E} SELECT label, r.id, min(reached) AS component FROM r JOIN embeddings ON vec_id = r.id GROUP BY label, r.id""",
    "formula_parse": f"{_F} SELECT key, line, no, relation, lhs, rhs, head, array_to_string(symbols, ' ') AS symbols FROM f",
    "symbol_table": f"{_G} SELECT key, symbol, n_lines, n_used, n_defined FROM tab",
    "symbol_graph": f"""{_G} SELECT key, 'self_reference' AS finding, head AS symbol, count(*) AS n FROM f WHERE relation IN ('=', '≈', '~') AND head <> '' AND list_contains(symbols, head) AND len(symbols) > 1 GROUP BY key, head
        UNION ALL SELECT key, 'used_not_defined', symbol, n_used FROM tab WHERE (length(symbol) <= 3 OR contains(symbol, '_')) AND n_defined = 0 AND n_used >= 2 AND n_lines >= 2
        UNION ALL SELECT key, 'conflict', head, count(DISTINCT rhs) FROM f WHERE relation IN ('=', '≈', '~') AND head <> '' AND rhs <> '' GROUP BY key, head HAVING count(DISTINCT rhs) >= 2""",
    "primitive_checks": f"""WITH {SAMPLES_SQL}, s AS (SELECT id, lower(coalesce(prediction, '')) AS low, {_NORM.format("coalesce(prediction, '')")} AS norm, p, string_split(w, '|') AS req FROM samples, (VALUES {", ".join(f"('{p}', '{w}')" for p, w in PRIMITIVES)}) v(p, w)),
        h AS (SELECT *, len(list_filter(req, lambda x: regexp_matches(norm, '(^|[^a-z0-9])' || x || '([^a-z0-9]|$)'))) AS n, regexp_matches(norm, '(^|[^a-z0-9])' || req[1] || '([^a-z0-9]|$)') AS dep, coalesce(regexp_matches(norm, '(^|[^a-z0-9])' || req[2] || '([^a-z0-9]|$)'), false) AS ind, contains(low, req[1]) AS said FROM s)
        SELECT id, p AS primitive, coalesce(CASE p WHEN 'formula_pattern' THEN CASE WHEN n = len(req) THEN 'pass' END WHEN 'equation_equivalence' THEN CASE WHEN contains(norm, 'then the') THEN 'pass' WHEN n >= 2 THEN 'fail' END
            WHEN 'power_law' THEN CASE WHEN dep <> ind THEN 'fail' END WHEN 'compliance_phrase' THEN CASE WHEN said THEN 'pass' END WHEN 'required_symbols' THEN CASE WHEN n = len(req) THEN 'pass' WHEN n = 0 THEN 'fail' END END, 'inconclusive') AS result FROM h""",
    "embedding_clusters": f"""WITH RECURSIVE {_E}, c AS (SELECT label, r.id, min(reached) AS component FROM r JOIN embeddings ON vec_id = r.id GROUP BY label, r.id),
        s AS (SELECT label, component, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, component) AS no FROM (SELECT label, component, count(*) AS n FROM c GROUP BY ALL)), p AS (SELECT *, row_number() OVER (PARTITION BY label, component ORDER BY id) AS place FROM c)
        SELECT p.label, id, CASE WHEN n >= 4 THEN 'embedding_cluster_' || lpad(no::VARCHAR, 2, '0') END AS cluster_id, place, n >= 4 AND place <= 5 AS is_example FROM p JOIN s USING (label, component)""",
    "hash_sample": "SELECT doc_id AS id, sha1('42' || doc_id) AS rank FROM documents ORDER BY rank, id LIMIT 50",
    "stratified_splits": """SELECT doc_id, lang, CASE WHEN r <= 2 THEN 'smoke' WHEN r <= 7 THEN 'test' ELSE 'val' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('7' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10""",
    "prefix_checkpoints": """WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha1('1' || doc_id), doc_id) AS r FROM documents) SELECT lang, size, count(*) AS n, sum(doc_id)::BIGINT AS sum_ids FROM r, (VALUES (5), (10), (20)) s(size) WHERE r <= size GROUP BY ALL""",
    "eval_audit_median": "SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, median(n_chars) AS median_chars FROM documents GROUP BY lang",
    "rollout_p95": """WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
        SELECT source, n_chars AS p95_chars, n FROM r WHERE r - 1 = round_even(0.95 * (n - 1), 0)::INT""",
    "dialogue_samples": "SELECT conv_id, turn, role, n_question, n_answer FROM (SELECT conv_id, turn, role, length(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS n_question, length(text) AS n_answer FROM conversations) WHERE role = 'assistant'",
    "ext_event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
