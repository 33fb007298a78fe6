"""Text functions: columns in, columns out. Every one stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without a signal of their own, signals too common to count, hints of rules about form, patterns of
# error types and of diagnostics that find nothing, words that are no symbols, signals that say little of a rule, and
# other spellings of symbols.
STOPWORDS = "a an and are as at be by can check checks correct derive description determine domain equation error errors for form from given if in into is it its logic must of on or physics problem process result rule rules should solution such that the their them then this those through to topic under use using verify when where which with without 题目 公式 关系 分析 出现 判断 前提 利用 可能 必须 条件 检查 根据 正确 注意 涉及 过程 逻辑 结果 要求 计算 证明 验证 解答 说明 需要".split()
LOW_SIGNAL = "about all area being body center com constant current dynamics energy equal field fields function initial first length mass model models motion number numbers object objects per physical results surface sum system systems term terms theory time total use used vec no relations relation applications principles second".split()
META_HINTS = ["chart", "data extraction", "diagram", "dimensional", "distinguish given", "figure", "graph", "known/unknown", "notation", "read graph", "semantic", "table", "unit consistency", "区分给定", "区分已知", "区分给定演化规律", "区分待求", "图区", "图像", "图表", "图表数据", "已知", "待求", "数据提取", "文字描述", "标注", "量纲", "量纲一致", "表格", "读图", "语义"]
ERROR_TYPES = [
    ("units", r"\b(unit|units|dimensional|dimension|si\b|kg|meter|metre|cm\b|mm\b|quantity|量纲|单位)\b"),
    ("calculation", r"\b(numerical|arithmetic|compute|calculat|round|approximat|≈|=\s*[\d.]|\d+\.\d+|value\s+is\s+wrong|mistake\s+in\s+the\s+calculation)\b"),
    ("modeling", r"\b(model|assumption|approximat|boundary|frame\s+of\s+reference|reference\s+frame|idealiz|scenario|situation|applicab|valid\s+when|cannot\s+apply)\b"),
    ("concept", r"\b(misunderstand|concept|definition|physical\s+meaning|interpret|confus|incorrectly\s+assumes|wrong\s+physical)\b"),
    ("logic", r"\b(therefore|thus|implies|inconsistent|contradict|missing\s+step|does\s+not\s+follow|chain|reasoning|logic)\b"),
]
NEGATIVE = [
    r"\bno violation\b", r"\bnot triggered\b", r"\bnot trigger(?:ed|ing)?\b", r"\btrigger condition (?:is )?not met\b", r"\bcondition (?:is )?not met\b", r"\bdoes not apply\b", r"\bnot applicable\b",
    r"\bunrelated to\b", r"\bnot relevant\b", r"\bcomplies with\b", r"\bcompliant\b", r"\bno direct contradiction\b", r"\bno violation (?:exists|is present|can be assessed)\b", r"\bno .* violation .* found\b",
    r"\btherefore,? .* no violation\b", r"未(?:发现|构成|触发|违反)", r"没有(?:发现)?(?:明显)?(?:违规|违反|错误)", r"不(?:适用|相关|触发|违反)", r"无法(?:判断|确认|确定)", r"证据不足", r"条件不足",
]
NOT_SYMBOLS = "the of a an is in on for with and or not sin cos tan log ln exp".split()
GENERIC_SIGNALS = ["sin", "cos", "tan", "cot", "sec", "csc", "sqrt", "根式", "代换", "恒等式", "三角", "三角代换", "根式方程"]
ALIASES = {"tau": ["τ"], "omega": ["ω"], "theta": ["θ"], "phi": ["φ"], "pi": ["π"], "delta": ["δ"], "gamma": ["γ"], "lambda": ["λ"], "rms": ["effective", "有效值"], "avg": ["average", "mean", "平均值"]}
TOKEN = "[A-Za-z0-9_一-鿿]+"


def norm_text(x: Column) -> Column:
    """White space runs as one blank, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def fold(x: Column) -> Column:
    """Case folding as far as both engines agree."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def upper(x: Column) -> Column:
    """Capitals letter by letter, as DuckDB has them: a letter whose capital is more than one stays, but ß becomes ẞ."""
    up = lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    return F.array_join(F.transform(F.split(x, ""), up), "")


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(norm_text(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def answer_norm(x: Column) -> Column:
    """An answer without layout commands, braces, dollar signs and white space, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\\boxed|\\left|\\right", ""), r"[{}$\s]", ""))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(TOKEN), F.lit(0))


def keep_token(t: Column) -> Column:
    """Neither a number, nor a single ASCII character, nor a stop word."""
    return ~t.rlike("^[0-9]+$") & ~t.rlike("^[\x21-\x7e]$") & ~F.lower(t).isin(STOPWORDS)


def contains_phrase(hay: Column, needle: Column) -> Column:
    """Substring match of folded texts; a single ASCII letter must stand alone."""
    alone = F.regexp_like(hay, F.concat(F.lit("(^|[^a-z0-9_])"), needle, F.lit("([^a-z0-9_]|$)")))
    return F.when(F.length(needle) == 0, False).when(needle.rlike("^[a-z]$"), alone).otherwise(F.contains(hay, needle))


def looks_like_symbol(s: Column) -> Column:
    """At most 20 characters, no stop word, and no lower-case word of four letters or more."""
    return (F.length(s) <= 20) & ~F.lower(s).isin(NOT_SYMBOLS) & ~s.rlike("^[a-z]{4,}$")


def symbols(x: Column) -> Column:
    """Words that look like symbols, in order, a leading backslash left out."""
    return F.filter(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\\?([a-zA-Z][a-zA-Z0-9_]*)"), F.lit(1)), looks_like_symbol)


def symbol_set(x: Column) -> Column:
    """Distinct symbols in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(symbols(x), F.lower)))


def surface(x: Column) -> Column:
    """A text without \\mathrm{}, \\text{}, thin spaces and ties, its white space as single blanks."""
    plain = F.regexp_replace(F.regexp_replace(norm_text(x), r"(?i)\\mathrm\{([^}]*)\}", "$1"), r"(?i)\\text\{([^}]*)\}", "$1")
    return norm_text(F.regexp_replace(plain, r"\\,|~", " "))


def is_generic(signal: Column) -> Column:
    """Whether a folded signal holds a term that says little of a rule."""
    return signal.rlike("|".join(GENERIC_SIGNALS))


def loose_words(phrase: Column) -> Column:
    """The words of four or more letters by which a phrase is found loosely, folded."""
    return F.transform(F.filter(tokens(norm_text(phrase)), lambda t: keep_token(t) & (F.length(t) >= 4)), fold)


def enough(hits: Column, words: Column, least: int = 2, share: float = 0.45) -> Column:
    """Whether so many hits are enough of a phrase's words: 45 %, and two or more."""
    return (F.size(words) > 0) & (hits >= F.greatest(F.lit(least), (F.size(words) * share + 0.5).cast("int")))


def holds_loosely(hay: Column, words: Column, least: int = 2, share: float = 0.45) -> Column:
    """Whether enough of a phrase's :func:`loose_words` stand in a folded text: 45 %, and two or more."""
    return enough(F.size(F.filter(words, lambda t: F.contains(hay, t))), words, least, share)


def matches_loosely(hay: Column, phrase: Column, least: int = 2, share: float = 0.45) -> Column:
    """Whether enough of a phrase's words stand in a folded text."""
    return holds_loosely(hay, loose_words(phrase), least, share)


def math_text(x: Column) -> Column:
    """A formula without \\left, \\right, braces, dollar signs and blanks, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"\\left|\\right|[{}$ ]", ""))


def spellings(symbol: Column) -> Column:
    """A symbol as :func:`math_text` has it, and its other spellings."""
    base = math_text(symbol)
    out = F.array(base)
    for name, others in ALIASES.items():
        out = F.when(base.isin([name, *others]), F.array_distinct(F.concat(F.array(base), F.array(*map(F.lit, [name, *others]))))).otherwise(out)
    return F.filter(out, lambda v: v != "")


def has_symbol(text: Column, symbol: Column) -> Column:
    """Whether a spelling of a symbol stands in a text; a single ASCII letter must stand alone."""
    hay = math_text(text)
    alone = lambda v: F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), F.concat(F.lit("(^|[^a-z0-9_])"), v, F.lit("([^a-z0-9_]|$)")))
    return F.exists(spellings(symbol), lambda v: F.when(v.rlike("^[a-z]$"), alone(v)).otherwise(F.contains(hay, v)))


def error_type(x: Column) -> Column:
    """The first type whose pattern is found; logic if none is."""
    out = None
    for label, pattern in ERROR_TYPES:
        hit = F.coalesce(x, F.lit("")).rlike("(?i)" + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("logic")


def is_negative(x: Column, severity: Column) -> Column:
    """Whether a diagnostic says that nothing is wrong; so do those of severity info and empty ones."""
    return says_nothing(norm_text(x), severity)


def says_nothing(text: Column, severity: Column) -> Column:
    """:func:`is_negative` of a text as :func:`norm_text` has it."""
    return (F.lower(severity) == "info") | (text == "") | text.rlike("(?i)" + "|".join(NEGATIVE))


def is_meta(x: Column) -> Column:
    """Whether a rule is about the form of a task rather than its content."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.exists(F.array(*(F.lit(h) for h in META_HINTS)), lambda h: F.contains(low, h))
