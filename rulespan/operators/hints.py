"""What sets a topic apart: classes of rules and symbols, scenes in order of use, terms by their lift; and contexts under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import small

# Words of rules of mere algebra, words of physical settings, groups of words of rules that apply narrowly,
# symbols that are telling however short, words of actions, and scenes too common alone.
ALGEBRA = "cos cot csc identity root sec sin sqrt substitution tan 三角 代换 恒等式 根式".split()
SETTINGS = ["ammeter", "atom", "battery", "beam", "black hole", "camera", "capacitor", "charge", "circuit", "coil", "collision", "current", "dipole", "disc", "earth", "electric", "electron", "field", "flux", "frog", "gas", "gravity", "induction", "interferometer", "laser", "lens", "loop", "magnetic", "mass", "orbit", "particle", "pinhole", "planet", "pressure", "relativity", "resistor", "rod", "satellite", "spring", "string", "superconduct", "torque", "voltage", "wave"]
NARROW = [["binary system", "双星"], ["gravitational scattering", "引力散射", "impact parameter", "偏转角", "掠过"], ["collision orbit", "碰撞后", "变轨", "近地点", "r_p"], ["cherenkov", "切伦科夫"], ["mirage", "蜃景", "虚幻湖面", "maupertuis", "fermat"]]
STRONG_SYMBOLS, SHORT_SYMBOLS = ["R_E", "r_p", "dE", "dr", "dx", "dt", "EMF", "ISS"], ["ISS", "EMF"]
ACTIONS = "apply assume calculate check compute confirm derive determine ensure given judge open opening show solve verify 出现 判断 处理 要求 计算 证明 给出 设 说明 需要".split()
COMMON_SCENES = "resistance length time mass current".split()


def _hits(text: Column, hints: list[str]) -> Column:
    """How many of the hints stand in a folded text."""
    return sum(T.contains_phrase(text, F.lit(h)).cast("int") for h in hints)


def retrieval_profile(rules: DataFrame) -> DataFrame:
    """``rules`` (title, trigger, check_logic, …) with generic_math, narrow, meta_hint and scope.

    generic_math: two words of algebra or more and no physical setting. narrow: two words of a group of narrow rules, or all of
    them. meta_hint: a word of rules about form. scope is meta for the first two, else domain. Null texts are empty.
    """
    text = T.fold(F.trim(F.concat_ws(" ", *(T.norm_text(F.col(c)) for c in ("title", "trigger", "check_logic")))))
    df = rules.withColumn("__text", text)
    t = F.col("__text")
    in_group = lambda group: sum(F.contains(t, F.lit(h)).cast("int") for h in group)
    narrow = in_group(NARROW[0]) >= min(2, len(NARROW[0]))
    for group in NARROW[1:]:
        narrow = narrow | (in_group(group) >= min(2, len(group)))
    algebra = (_hits(t, ALGEBRA) >= 2) & (_hits(t, SETTINGS) == 0)
    df = df.withColumns({"generic_math": algebra, "narrow": narrow, "meta_hint": T.is_meta(t)}).drop("__text")
    return df.withColumn("scope", F.when(F.col("generic_math") | F.col("narrow"), "meta").otherwise("domain"))


def strong_symbol(symbol: Column) -> Column:
    """Whether a symbol is telling: known as such, with a sign or digit, of four characters or more, or three capitals."""
    s = T.norm_text(symbol)
    weak = s.rlike("^[A-Za-z]{1,2}$") & ~F.upper(s).isin(SHORT_SYMBOLS)
    telling = s.rlike(r"[_/\\()^0-9]") | (F.length(s) >= 4) | ((F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) >= 3))
    return F.when(s == "", False).when(s.isin(STRONG_SYMBOLS), True).when(weak | (F.length(s) == 1), False).otherwise(telling)


def in_setting(token: Column) -> Column:
    """Whether a token is a word of a physical setting, a part of one, or holds one."""
    t = T.fold(T.norm_text(token))
    near = t.isin(SETTINGS)
    for hint in (h for h in SETTINGS if " " not in h):
        near = near | F.contains(F.lit(hint), t) | F.contains(t, F.lit(hint))
    return (t != "") & near


def refined_scenes(scenes: DataFrame, most: int = 16) -> DataFrame:
    """``scenes`` (key…, scene) worth searching for, with place: at most ``most`` of each key (all columns but scene).

    Left out are signals too common, scenes without tokens, with ``or``, long ones without enough physical setting, and those
    about what to do rather than what there is. First come scenes with two words of a setting, then those of two or three
    tokens, short ones, and the alphabet.
    """
    key = [c for c in scenes.columns if c != "scene"]
    x, low = T.norm_text(F.col("scene")), T.fold(F.col("scene"))
    kept = F.filter(T.tokens(F.col("scene")), T.keep_token)
    df = scenes.withColumns({"__n": F.size(kept), "__long": F.length(x), "__all": F.size(F.filter(T.tokens(F.col("scene")), in_setting)), "__set": F.size(F.filter(kept, in_setting))})
    n, long, context = F.col("__n"), F.col("__long"), F.col("__set")
    acts = F.exists(F.array(*map(F.lit, ACTIONS)), lambda a: F.contains(low, a))
    idle = (
        T.fold(x).isin([*T.LOW_SIGNAL, *COMMON_SCENES]) | (n == 0) | (low.endswith("时") & (context < 2)) | F.contains(low, F.lit(" or ")) | F.contains(low, F.lit(" 或 ")) | ((n >= 5) & (context < 2)) | ((long >= 20) & (context == 0))
        | (acts & (context < 2) & (F.contains(F.col("scene"), F.lit(" ")) | (long >= 10))) | (acts & (context < 3) & (n >= 3)) | (F.col("scene").rlike("[一-鿿]") & (context < 2) & (long >= 8))
    )
    order = [F.desc(F.least("__all", F.lit(2))), F.desc(n.between(2, 3)), F.col("__long"), low, F.col("scene")]
    one = df.where(~idle).dropDuplicates([*key, "scene"])
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return one.withColumn("place", place).where(F.col("place") <= most).select(*key, "scene", "place")


def contrastive_terms(rules: DataFrame, most: int = 20) -> DataFrame:
    """(domain, topic, term, n, n_topics, lift, class, place): the terms that set a topic apart from all others.

    lift is the share of the topic's rules with the term over that of all other rules, each with half a rule added. One
    table of (topic, term) counts gives topic, term and grand totals. Terms above 1 come by lift, number and the alphabet, at
    most ``most``. class: narrow for a term of one topic, generic for a low signal or a term of half of the topics or more, else
    strong. Common words are no terms; a rule counts a term once.
    """
    key = ["domain", "topic"]
    text = F.concat_ws(" ", "title", "trigger", "check_logic")
    seen = rules.select(*key, F.explode(F.array_distinct(F.transform(F.filter(T.tokens(text), T.keep_token), T.fold))).alias("term"))
    count = seen.groupBy(*key, "term").agg(F.count("*").alias("n"))
    sizes = rules.groupBy(*key).agg(F.count("*").alias("__rules"))
    every = sizes.agg(F.sum("__rules").alias("__all"), F.count("*").alias("__topics"))  # one row
    terms = count.groupBy("term").agg(F.sum("n").alias("__total"), F.count("*").alias("n_topics"))
    df = count.join(small(terms), "term").join(small(sizes), key).join(F.broadcast(every))
    own, rest = (F.col("n") + 0.5) / (F.col("__rules") + 1), (F.col("__total") - F.col("n") + 0.5) / (F.col("__all") - F.col("__rules") + 1)
    df = df.withColumn("lift", F.round(own / rest, 6)).where("lift > 1")
    kind = F.when(F.col("term").isin(T.LOW_SIGNAL) | ((F.col("n_topics") > 1) & (2 * F.col("n_topics") >= F.col("__topics"))), "generic").when(F.col("n_topics") == 1, "narrow").otherwise("strong")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("lift"), F.desc("n"), "term"))
    return df.withColumn("class", kind).withColumn("place", place).where(F.col("place") <= most).select(*key, "term", "n", "n_topics", "lift", "class", "place")


def within_budget(items: DataFrame, key: str, order: list[str], cost: Column, most: int, budget: int) -> DataFrame:
    """The first ``items`` of each ``key`` by ``order``, whole ones only: at most ``most``, and at most ``budget`` of ``cost`` in all."""
    per = Window.partitionBy(key).orderBy(*order)
    n, used = F.row_number().over(per), F.sum(cost).over(per.rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("__n", n).withColumn("__used", used).where((F.col("__n") <= most) & (F.col("__used") <= budget)).drop("__n", "__used")


def context_summary(texts: DataFrame, parsed: DataFrame, key: str, text: str, symbols: int = 50, formulas: int = 20, budget: int = 1200) -> DataFrame:
    """(key, symbols, formulas, preview): what a reader of each text is shown, whole items within ``budget`` characters for each list.

    symbols in order of their first place in the text, as ``name:occurrences``; formulas (``parsed``: key, line, no, raw) in order;
    preview is the text's first ``budget`` characters. A text without symbols or formulas has empty lists.
    """
    seen = texts.select(key, F.posexplode(T.symbols(F.col(text))).alias("at", "name")).groupBy(key, "name").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    named = within_budget(seen.withColumn("item", F.concat_ws(":", "name", "n")), key, ["at"], F.length("item"), symbols, budget)
    stated = within_budget(parsed.select(key, "line", "no", F.col("raw").alias("item")), key, ["line", "no"], F.length("item"), formulas, budget)
    listed = lambda df, *by: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*by, "item"))), lambda s: s["item"]).alias("items"))
    empty = F.array().cast("array<string>")
    both = texts.select(key, F.substring(F.coalesce(text, F.lit("")), 1, budget).alias("preview")).join(listed(named, "at").withColumnRenamed("items", "symbols"), key, "left").join(listed(stated, "line", "no").withColumnRenamed("items", "formulas"), key, "left")
    return both.select(key, F.coalesce("symbols", empty).alias("symbols"), F.coalesce("formulas", empty).alias("formulas"), "preview")
