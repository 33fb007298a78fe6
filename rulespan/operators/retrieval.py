"""Scoring and selection of topics and rules for samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .phrase_index import found_bits, found_sets, has_bit, listed, numbered

#: Signals and rules of a catalog that may be broadcast; a larger catalog is joined with a shuffle.
MOST_SIGNALS = 50_000


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """``df`` dealt by its key: what follows it by that key needs no further shuffle, and no core idles because a file
    has fewer parts than there are cores. The number of parts is that of shuffles and is given, so that Spark does not put
    parts together by their bytes: what is made of a text is many times larger, and costs more, than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def small(df: DataFrame, most: int = MOST_SIGNALS) -> DataFrame:
    """``df`` with a broadcast hint if it has no more than ``most`` rows: it is counted, and never read past that."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def extract_keywords(df: DataFrame, key: list[str], text: Column, most: int) -> DataFrame:
    """(key, keyword, n, rank): the ``most`` commonest tokens of each key, ties by first place, in their first spelling."""
    df = spread(df.select(*key, text.alias("__text")), key[0]) if len(key) == 1 else df.select(*key, text.alias("__text"))
    seen = df.select(*key, F.posexplode(T.tokens(F.col("__text"))).alias("pos", "token")).where(T.keep_token(F.col("token")))
    order = F.struct(*([F.col("rule_no")] if "rule_no" in df.columns and "rule_no" in key else []), F.col("pos"), F.col("token"))
    counted = seen.groupBy(*key, T.fold(F.col("token")).alias("folded")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min_by("token", order).alias("keyword"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first", "folded"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select(*key, "folded", "keyword", "n", "rank")


def unique_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens): the distinct tokens of each text in their first spelling and order, joined by blanks; a text without tokens
    has no row. What folding changes in a token are capitals A-Z alone, so that a text is read in one pass where it lies."""
    token = re.compile(T.TOKEN)

    def first(words: list[str]) -> str:
        own: dict[str, str] = {}
        for w in words:
            own.setdefault(w.lower(), w)
        return " ".join(own.values())

    joined = F.pandas_udf(lambda texts: texts.map(lambda t: first(token.findall(t))), "string")
    return spread(df.where(F.col(text).rlike(T.TOKEN)).select(key, text), key).select(key, joined(text).alias("tokens"))


def topic_signals(rules: DataFrame) -> DataFrame:
    """(domain, topic, type, signal): keywords, scenes, symbols and aliases of each topic."""
    key = ["domain", "topic"]
    words = rules.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "title", "trigger"))), lambda r: F.concat_ws(" ", r["title"], r["trigger"])), " ").alias("t"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_no", "check_logic"))), lambda r: r["check_logic"]), " ").alias("c"))
    keyword = extract_keywords(words, key, F.col("t"), 8).select(*key, F.lit("keyword").alias("type"), F.col("folded").alias("signal"), "rank")
    scene = extract_keywords(words, key, F.col("c"), 4).select(*key, F.lit("scene").alias("type"), F.col("folded").alias("signal"), "rank")
    symbol = words.select(*key, F.lit("symbol").alias("type"), F.explode(T.symbol_set(F.col("t"))).alias("signal"), F.lit(1).alias("rank")).where(F.length("signal") <= 2)
    alias = keyword.where("rank = 1").withColumn("type", F.lit("alias"))
    name = words.select(*key, F.lit("alias").alias("type"), F.lower("topic").alias("signal"), F.lit(0).alias("rank"))
    return keyword.unionByName(scene).unionByName(symbol).unionByName(alias).unionByName(name).select(*key, "type", "signal").distinct()


def signal_df(signals: DataFrame) -> DataFrame:
    """(type, signal, df): how many topics have a signal."""
    return signals.groupBy("type", "signal").agg(F.count_distinct("domain", "topic").alias("df"))


def df_weight(df: Column, strong: float, weak: float) -> Column:
    """Strong for a signal of one topic, down to weak for one of many."""
    return F.when(df <= 1, strong).when(df <= 3, 0.75 * strong).when(df <= 8, (strong + weak) / 2).otherwise(weak)


def weighted_signals(signals: DataFrame) -> DataFrame:
    """``signals`` with w, without those too common to count."""
    df = F.col("df")
    symbol = F.when((F.length("signal") == 1) & (df > 6), 0.0).when(df <= 2, 1.0).when(df <= 6, 0.5).otherwise(0.25)
    w = F.when(F.col("type") == "scene", df_weight(df, 3.5, 0.75)).when(F.col("type") == "keyword", df_weight(df, 2.0, 0.35)).when(F.col("type") == "symbol", symbol).otherwise(6.0)
    weak = (F.col("type") == "keyword") & (F.col("signal").rlike("^[a-z]{1,2}$") | F.col("signal").isin(T.LOW_SIGNAL) | ((df > 18) & (F.length("signal") <= 8)))
    return signals.join(small(signal_df(signals)), ["type", "signal"]).where(~weak).withColumn("w", w)


def retrieval_text(df: DataFrame) -> DataFrame:
    """``df`` with hay: question, context and up to 4000 characters of the prediction, folded."""
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("question", "context")] + [F.substring("prediction", 1, 4000)]
    return df.withColumn("hay", T.fold(F.concat_ws("\n", *parts)))


def rule_text(df: DataFrame) -> DataFrame:
    """``df`` with hay: question, context and the whole prediction, folded; where they hold LaTeX layout, followed by the
    same text without it, so that a signal may stand in either."""
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("question", "context", "prediction")]
    raw = F.concat_ws("\n", *parts)
    return df.withColumn("hay", T.fold(F.when(raw.rlike(r"[\\~]"), F.concat_ws("\n", raw, T.surface(raw))).otherwise(raw)))


def _hint_signals(hints: DataFrame) -> DataFrame:
    """(domain, topic, type, signal, w, words): the terms of ``hints``, and each word of a phrase with the phrase's words."""
    empty, key = F.array().cast("array<string>"), ["domain", "topic"]
    terms = hints.select(*key, F.explode(F.array_distinct(F.transform(F.coalesce("terms", empty), lambda t: T.fold(T.norm_text(t))))).alias("signal")).where("signal <> ''")
    loose = hints.select(*key, F.explode(F.array_distinct(F.transform(F.coalesce("phrases", empty), T.loose_words))).alias("words"))
    words = loose.select(*key, F.explode("words").alias("signal"), "words").groupBy(*key, "signal", "words").agg(F.count("*").cast("double").alias("w"))
    terms = terms.select(*key, F.lit("term").alias("type"), "signal", F.lit(1.0).alias("w"), F.lit(None).cast("array<string>").alias("words"))
    return terms.unionByName(words.select(*key, F.lit("word").alias("type"), "signal", "w", "words"))


def _hint(p: Column, t: Column) -> Column:
    """What so many phrases and terms add to a score."""
    return F.least(p * 3.0, F.lit(6.0)) + F.least(t * 0.8, F.lit(5.0))


def _loosely() -> Column:
    """Whether the words of a phrase that were found, ``word`` of them, are enough."""
    return F.coalesce(F.col("word") >= F.greatest(F.lit(2), (F.size("words") * 0.45 + 0.5).cast("int")), F.lit(False))


def topic_hints(samples: DataFrame, hints: DataFrame) -> DataFrame:
    """(id, domain, topic, hint): what the hints of a language model add to a topic's score, where they add anything.

    ``hints`` (domain, topic, phrases, terms), one row a topic; a phrase is found loosely, a term as it is. Null lists
    are empty ones. Each distinct word and term is looked for once in a text; what is found is joined with the phrases
    and terms that have it, once for both.
    """
    own, key = _hint_signals(hints), ["id", "domain", "topic"]
    hits = found_sets(spread(retrieval_text(samples).select("id", "hay")), own.select(F.col("signal").alias("phrase")).distinct()).select("id", F.explode("found").alias("signal"))
    total = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("w")).otherwise(0.0)).alias(kind)
    per = hits.join(small(own, 4 * MOST_SIGNALS), "signal").groupBy(*key, "words").agg(total("term"), total("word"))
    return per.groupBy(*key).agg(_hint(F.count_if(_loosely()), F.sum("term")).alias("hint")).where("hint > 0")


def with_hints(scores: DataFrame, found: DataFrame) -> DataFrame:
    """``scores`` of topics raised by what :func:`topic_hints` found."""
    both = scores.join(found, ["id", "domain", "topic"], "left")
    return both.withColumn("score", F.round(F.col("score") + F.coalesce("hint", F.lit(0.0)), 6)).drop("hint")


def topic_scores(samples: DataFrame, signals: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(id, domain, topic, score, anchored) of every sample and topic; anchored if a name, an alias or a scene is hit.
    ``hints`` as in :func:`topic_hints` raise the scores, by the same search.

    Each distinct signal is looked for once in a text, by :mod:`phrase_index`; what is found is then joined with the
    topics that have it. A mark that every topic has gives the topics without a hit their zero. Texts are dealt by id
    before the search, and what is found behind it, as Spark forgets there how rows are dealt; sums and ranks by id follow
    without a shuffle, and no text goes beyond the search.
    """
    key, w = ["id", "domain", "topic"], weighted_signals(signals)
    topics, own = w.select("domain", "topic").distinct(), w.select("domain", "topic", "type", "signal", "w")
    if hints is not None:
        own = own.unionByName(_hint_signals(hints).join(topics, ["domain", "topic"], "left_semi"), allowMissingColumns=True)
    found = spread(found_sets(spread(retrieval_text(samples).select("id", "hay")), own.select(F.col("signal").alias("phrase")).distinct()))
    hits = found.select("id", F.explode(F.concat(F.array(F.lit("")), "found")).alias("signal"))
    marks = topics.select("domain", "topic", F.lit("none").alias("type"), F.lit("").alias("signal"), F.lit(0.0).alias("w"))
    per = hits.join(small(own.unionByName(marks, allowMissingColumns=True), 4 * MOST_SIGNALS), "signal")
    n = lambda kind: F.count_if(F.col("type") == kind)
    total = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("w")).otherwise(0.0))
    sums = {"n_alias": n("alias"), "n_scene": n("scene"), "n_keyword": n("keyword"), "scene": total("scene"), "keyword": total("keyword"), "symbol": total("symbol")}
    if hints is not None:  # the words of a phrase are counted first
        per = per.groupBy(*key, "words").agg(*(c.alias(k) for k, c in (sums | {"term": total("term"), "word": total("word")}).items()))
        sums = {k: F.sum(k) for k in sums}
    anchored = (sums["n_alias"] > 0) | (sums["n_scene"] > 0)
    symbol = F.when(anchored | (sums["n_keyword"] >= 2), F.least(sums["symbol"], F.lit(3.0))).otherwise(0.0)
    score = F.round(F.when(sums["n_alias"] > 0, 6.0).otherwise(0.0) + F.least(sums["scene"], F.lit(12.0)) + F.least(sums["keyword"], F.lit(8.0)) + symbol, 6)
    if hints is not None:
        score = F.round(score + _hint(F.count_if(_loosely()), F.sum("term")), 6)
    return per.groupBy(*key).agg(score.alias("score"), anchored.alias("anchored"))


def symbol_boost(scores: DataFrame, samples: DataFrame, required: DataFrame, per_hit: float = 0.45, most: float = 2.2) -> DataFrame:
    """``scores`` with overlap and a score raised by it: ``per_hit`` for each symbol of the prediction that the topic
    requires, ``most`` in all. ``required`` (domain, topic, symbols in lower case)."""
    own = samples.select("id", T.symbol_set(F.col("prediction")).alias("__s"))
    both = scores.join(own, "id").join(small(required), ["domain", "topic"], "left")
    overlap = F.coalesce(F.size(F.array_intersect("__s", "symbols")), F.lit(0))
    return both.withColumn("overlap", F.greatest(overlap, F.lit(0))).select("id", "domain", "topic", "overlap", F.round(F.col("score") + F.least(F.lit(most), F.col("overlap") * per_hit), 6).alias("score"))


def top_topics(scores: DataFrame, most: int = 3) -> DataFrame:
    """The best topics of each sample by score, domain and topic; topics of score zero fill up."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "domain", "topic"))
    return scores.withColumn("topic_rank", rank).where(F.col("topic_rank") <= most)


def rule_features(rules: DataFrame) -> DataFrame:
    """(rule_no, …, features): up to six trigger words and four words of the check logic, folded, and symbols."""
    trigger = extract_keywords(rules, ["rule_no"], F.col("trigger"), 6).groupBy("rule_no").agg(F.sort_array(F.collect_list("folded")).alias("t"))
    objects = extract_keywords(rules, ["rule_no"], F.col("check_logic"), 4).groupBy("rule_no").agg(F.sort_array(F.collect_list("folded")).alias("o"))
    empty = F.array().cast("array<string>")
    return rules.join(trigger, "rule_no", "left").join(objects, "rule_no", "left").withColumns({"t": F.coalesce("t", empty), "o": F.coalesce("o", empty), "s": T.symbol_set(F.col("title"))})


def rule_scores(samples: DataFrame, topics: DataFrame, rules: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(id, topic_rank, topic_score, domain, topic, anchored, rule_id, is_meta, t_hits, o_hits, s_hits, neg_hits, llm_hits,
    generic_only, score) of the rules of each sample's topics.

    ``hints`` (rule_no, negatives, phrases, terms): keywords that speak against a rule, and a language model's phrases and
    terms; a rule without a row, or with null lists, has none. generic_only: something is hit, but no trigger or object
    but generic ones.
    """
    empty = F.array().cast("array<string>")
    folded = lambda c: F.array_distinct(F.transform(F.coalesce(c, empty), lambda x: T.fold(T.norm_text(x))))
    f = rule_features(rules)
    if hints is None:
        f = f.withColumns({"__neg": empty, "__terms": empty, "__phrases": F.array().cast("array<array<string>>")})
    else:
        own = hints.select("rule_no", folded("negatives").alias("__neg"), folded("terms").alias("__terms"), F.array_distinct(F.transform(F.coalesce("phrases", empty), T.loose_words)).alias("__phrases"))
        f = f.join(small(own), "rule_no", "left")
    f = f.withColumn("__special", F.filter(F.concat("t", "o"), lambda s: ~T.is_generic(s)))
    lists = ["t", "o", "s", "__neg", "__terms", "__special", "__phrases"]
    f = f.select("domain", "topic", "rule_id", "is_meta", "support", *lists)
    every = f.select(F.explode(F.concat("t", "o", "s", F.coalesce("__neg", empty), F.coalesce("__terms", empty), F.flatten(F.coalesce("__phrases", F.array().cast("array<array<string>>"))))).alias("phrase")).distinct()
    texts, own = spread(rule_text(samples).select("id", "hay")), listed(every)
    if own is None:
        found, has = found_sets(texts, every), lambda s: F.array_contains("found", s)
    else:  # few enough for numbers: the rules have lists of them, each text the bits of what stands in it
        found, has = found_bits(texts, own), lambda n: has_bit(F.col("found"), n)
        places = numbered(samples.sparkSession, own)
        f = f.withColumns({"__lists": places(F.array(*(F.coalesce(c, empty) for c in lists[:-1]))), "__phrases": places("__phrases")})
        f = f.withColumns({c: F.get("__lists", F.lit(i)) for i, c in enumerate(lists[:-1])}).drop("__lists")
    pairs = topics.withColumnRenamed("score", "topic_score").join(spread(found), "id").join(small(f), ["domain", "topic"])
    hits = lambda c: F.greatest(F.size(F.filter(c, has)), F.lit(0))  # noqa: E731  (of a null list: 0)
    loose = F.filter("__phrases", lambda p: T.enough(F.size(F.filter(p, has)), p))
    key = ["id", "topic_rank", "topic_score", "domain", "topic", "anchored", "rule_id", "is_meta"]
    df = pairs.select(*key, "support", hits("t").alias("t_hits"), hits("o").alias("o_hits"), hits("s").alias("s_hits"), hits("__neg").alias("neg_hits"), hits("__terms").alias("__n_terms"), F.greatest(F.size(loose), F.lit(0)).alias("__n_phrases"), F.coalesce(F.exists("__special", has), F.lit(False)).alias("__specific"))
    only = (F.col("t_hits") + F.col("o_hits") + F.col("s_hits") > 0) & ~F.col("__specific")
    df = df.select("*", (F.col("__n_terms") + F.col("__n_phrases")).alias("llm_hits"), only.alias("generic_only")).drop("__specific")
    t, o, s, n = F.col("t_hits"), F.col("o_hits"), F.col("s_hits"), F.col("support")
    prior = F.when((n > 0) & ((t > 0) | (s > 0) | ((t + o + s >= 2) & (o > 0))), F.least(F.log2(n + 1.0), F.lit(3.0))).otherwise(0.0)
    hint = (F.least(F.col("__n_phrases") * 2.5, F.lit(7.5)) + F.least(F.col("__n_terms") * 1.0, F.lit(4.0))) * F.when(t + o + s == 0, 0.35).otherwise(1.0)
    raw = F.least(3 * t, F.lit(9)) + F.least(2 * o, F.lit(6)) + F.least(2 * s, F.lit(4)) + prior + hint
    raw = F.greatest(raw - F.least(F.col("neg_hits") * 2.0, F.lit(8.0)), F.lit(0.0))
    meta = F.greatest(raw - 1.5, F.lit(0.0))
    score = F.when(~F.col("is_meta"), raw).when((t == 0) & (o == 0), F.greatest(meta - 0.5, F.lit(0.0))).otherwise(meta)
    return df.withColumn("score", F.round(score, 6)).drop("support", "__n_terms", "__n_phrases")


def rule_context(scored: DataFrame, min_delta: float = 0.0, bonus_delta: float = 0.0) -> DataFrame:
    """``scored`` with gap, min_score, adjusted and margin, from how far a rule's topic lies behind the best one. Rules
    about form and rules with generic hits only need more, the latter more yet in a topic that is not anchored. The
    deltas are those of a tuning."""
    per = Window.partitionBy("id")
    top1 = F.max(F.when(F.col("topic_rank") == 1, F.col("topic_score"))).over(per)
    top2 = F.coalesce(F.max(F.when(F.col("topic_rank") == 2, F.col("topic_score"))).over(per), F.lit(0.0))
    gap = F.greatest(F.lit(0.0), top1 - F.col("topic_score"))
    first = F.col("topic_rank") == 1
    least = F.when(first, 1.0).when(gap <= 0.5, 4.0).when(gap <= 1.5, 6.0).when(gap <= 3, 7.0).otherwise(8.0)
    bonus = F.when(first, 1.5).when(gap <= 0.5, 0.0).when(gap <= 1.5, -0.75).when(gap <= 3, -1.75).otherwise(-2.5)
    meta, generic, adrift = F.col("is_meta").cast("int"), F.col("generic_only").cast("int"), (F.col("generic_only") & ~F.col("anchored")).cast("int")
    least = least + 0.5 * meta + generic + 2.0 * adrift + min_delta
    bonus = bonus - 0.75 * meta - generic - 1.5 * adrift + bonus_delta
    return scored.select("*", F.round(gap, 6).alias("gap"), least.alias("min_score"), F.round(F.col("score") + bonus, 6).alias("adjusted"), F.round(top1 - top2, 6).alias("margin"))


def select_rules(context: DataFrame, most: int = 6, offline: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rules of each sample under quotas for topics behind the best one, with their place. ``offline``: as a report on
    the matching takes them, by adjusted score and without regard to their least score. ``carry`` names further columns.

    margin >= 3: rules of the best topic only (or two others if it has none). Else a rule of another topic stays while
    its rank among them is within the quota of the margin, or while the best topic leaves room.
    """
    ok = context.where((F.col("score") > 0) if offline else (F.col("score") > 0) & (F.col("score") >= F.col("min_score")) & (F.col("adjusted") > 0))
    order = [F.col("is_meta").cast("int"), F.desc("adjusted" if offline else "score"), F.col("domain"), F.col("topic"), F.col("rule_id")]
    first = F.col("topic_rank") == 1
    ok = ok.withColumn("is_first", first)
    ok = ok.withColumn("n_first", F.sum(F.col("is_first").cast("int")).over(Window.partitionBy("id"))).withColumn("r_side", F.row_number().over(Window.partitionBy("id", "is_first").orderBy(*order)))
    quota = F.least(F.when(F.col("margin") > 1.5, 1).when(F.col("margin") > 0.5, 2).otherwise(most), F.lit(most))
    far = F.col("margin") >= 3
    keep = F.when(far, F.col("is_first") | ((F.col("n_first") == 0) & (F.col("r_side") <= min(2, most)))).otherwise(F.col("is_first") | (F.col("n_first") < F.greatest(most - quota, F.lit(0))) | (F.col("r_side") <= quota))
    place = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return ok.where(keep).withColumn("place", place).where(F.col("place") <= most).select("id", "place", "topic_rank", "rule_id", "score", "adjusted", *carry)
