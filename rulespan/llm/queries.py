"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, embedding_dedup, filter_audit, html_extract, license_scan, line_dedup, minhash_dedup, packing, periodic_runs, quality_classifier, quality_rules, toxicity, url_filter
from .shared import SPACE_CLASS

#: Fixed values of the url query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labelled = docs.where(~held_out).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return toxicity.fit(labelled).score(docs.withColumn("held_out", held_out)).select("doc_id", "held_out", "score", "predicted")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe_codec.encode(table(spark, sf_dir, "documents"), path, pattern, from_files=True, tokens=True)
    return bpe_codec.digests(encoded, path)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = quality_rules.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", SPACE_CLASS + "+"), lambda w: w != ""))
    docs = docs.select("doc_id", "text", "g", words.alias("w")).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long")), lambda i: F.get("w", place(i).cast("int"))), " ")
    runs = periodic_runs.periodic_runs(docs.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = [F.col(f"densest.{c}").alias(c) for c in ("start", "length", "period")]
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.floor(1000 * F.col("densest.length") / F.col("densest.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labelled = docs.where(~held_out).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return quality_classifier.fit(labelled).score(docs.withColumn("held_out", held_out)).select("doc_id", "held_out", "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands beside the package, whose other queries do without it

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_minhash_dedup, op3_toxicity, op4_url_filter, op5_embedding_dedup, op6_packing, op7_bpe_codec, op8_line_dedup, op9_license_scan, op10_quality_rules, op11_filter_audit, op12_periodic_runs, op13_quality_classifier, pipeline)}

ORACLES = {
    "op8_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
        ), k AS (
            SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), shared AS (
            SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), judged AS (
            SELECT k.*, shared.key IS NOT NULL AS gone FROM k LEFT JOIN shared ON k.key = shared.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op10_quality_rules": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), word AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t
        ), win AS (
            SELECT doc_id, i, [word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d] AS five, lead(word, 4) OVER d AS last
            FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM win WHERE last IS NOT NULL) WHERE n > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id
        ), line AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t
        ), judged AS (
            SELECT doc_id, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS full_line,
                length(translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) AS chars,
                len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
                length(line) - length(translate(line, '|', '')) AS pipes, length(line) - length(translate(line, '#*$%&<>', '')) AS signs
            FROM line
        ), failing AS (
            SELECT *, (pipes >= 2 AND 5 * pipes >= words) OR (10 * signs >= chars AND chars > 0)
                OR (words >= 3 AND regexp_matches(line, '\p{Lu}') AND NOT regexp_matches(line, '\p{Ll}'))
                OR (words <= 12 AND regexp_matches(lower(line), 'all rights reserved|cookie|click here|subscribe|sign up|log in|terms of (use|service)|privacy policy|javascript|lorem ipsum|read more|share this|back to top'))
                OR (words >= 10 AND NOT regexp_matches(line, '[.!?:;,…。！？]')) AS fails
            FROM judged
        ), lines AS (
            SELECT doc_id, count(*) FILTER (full_line) - count(DISTINCT line) FILTER (full_line) AS n_dup_lines, coalesce(sum(chars) FILTER (fails), 0) AS lost, sum(chars) AS word_chars
            FROM failing GROUP BY doc_id
        ), base AS (
            SELECT t.doc_id, len(w) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, lost
            FROM t LEFT JOIN covered ON t.doc_id = covered.doc_id LEFT JOIN lines ON t.doc_id = lines.doc_id
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * word_chars AS kept
        FROM base""",
    "op11_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), labelled AS (
            SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
        ), judged AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(text) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
            FROM t LEFT JOIN labelled ON t.doc_id = labelled.doc_id
        ), counts AS (
            SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, mask
        ), one(f, bit) AS (
            VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
        ), orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM one a, one b, one c, one d, one e
            WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
        ), steps AS (
            SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before FROM orders, range(1, 6) AS r(s)
        ), judged_steps AS (
            SELECT part, filter_order, step, bit,
                coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
            FROM counts, steps GROUP BY part, filter_order, step, bit, before
        )
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM judged_steps""",
}
