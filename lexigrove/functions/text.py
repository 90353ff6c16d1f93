"""Column expressions over text: cleaning, counting, identifiers, query analysis.

Everything here is a built-in expression (no Python per row) except ``compatibility``,
``casefold``, ``fold_any`` and ``sequence_ratio``, for which Spark has no counterpart.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns, word lists and weights that decide results.
CJK = r"㐀-鿿"
HAN = r"一-鿿"
STANDARD = r"(?iU)\b(?:GB|JGJ|CECS|DBJ|CJJ|DL|TB|JG)\s*[-—]?\s*\d{2,6}(?:\s*[-—]\s*\d{4})?\b"
CLAUSE = r"(?:第\s*)?([0-9]+(?:\.[0-9]+){1,5})(?:\s*条)?"
LEADING_CLAUSE = r"(?i)^(?:第\s*)?(\d+(?:\.\d+){1,4})(?:\s*条)?(?:[\s、：:.)）-].*)?$"
HEADING = r"^(?:第\s*\d+\s*[章节篇]|\d+(?:\.\d+){0,3}\s+|附录).{0,120}$"
LIST_ITEM = r"^(?:（\d+）|\d+[.)）]|[①②③④⑤⑥⑦⑧⑨⑩]|[A-Za-z][.)）])\s+"
TERMINAL = r"[。！？；.!?;]$"
STOP_WORDS = ["如何", "怎么", "怎样", "哪些", "什么", "需要", "进行", "可以", "是否", "以及", "关于", "应该", "要求", "情况", "相关", "问题"]
TABLE_TERMS = ["表格", "表中", "见表", "查表", "哪一列", "哪一行", "对应值", "取值表"]
TABLE_HINTS = ["数据", "项目", "规定", "要求", "值"]
NUMERIC_TERMS = ["限值", "阈值", "范围", "最小", "最大", "允许值", "数值", "多少", "厚度", "宽度", "长度", "强度"]
UNIT = r"(?iU)(?:\d+(?:\.\d+)?\s*)?(?:mm|cm|m|mpa|kpa|pa|kn|n|%|℃|°c|kg|t)\b"
RISK_TERMS = ["风险", "危险", "不得", "禁止", "严禁", "避免", "失效", "事故", "条件", "情形", "当", "如果", "否则", "前提"]
PARAPHRASE_TERMS = ["为什么", "如何处理", "如何判断", "有哪些", "怎么做"]
WEB_RULES = [
    (r"联网|网上|网页|互联网|web\s*search|搜索一下|查一下最新", True),
    (r"检测结果|第\s*\d+\s*次检测|图片.*检测", False),
    (r"最新|现行|目前|最近|今年|20\d{2}年|发布|更新", True),
]
FAILURE_SIGNS = {
    "incomplete_structured_output": ["eof while parsing", "unterminated string", "unexpected end of json", "unexpected end of data"],
    "invalid_structured_output": ["validation error", "invalid json", "jsondecodeerror", "identity mismatch", "unknown source markers"],
    "provider_unavailable": ["responses api", "timeout", "timed out", "connection", "http ", "api key", "未配置 responses", "service unavailable"],
}
OTHER_FAILURE = "generation_processing_error"


def _accents() -> tuple[str, str]:
    """Characters of the basic plane that decompose into one base character and marks, then all marks; and the bases, so that marks go."""
    old, new, marks = [], [], []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c and not 0xD800 <= code < 0xE000 and not 0xF900 <= code < 0xFB00:
            old.append(c)
            new.append(base[0])
    return "".join(old + marks), "".join(new)


ACCENTED, UNACCENTED = _accents()


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def clean(value: Column) -> Column:
    """No-break space and carriage return gone, every run of white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(_text(value), " \r", " "), r"(?U)\s+", " "))


def clean_lines(value: Column) -> Column:
    """As ``clean`` but line by line; empty lines go."""
    lines = F.split(F.translate(_text(value), " \r", " "), "\n")
    kept = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " "))), lambda x: x != "")
    return F.array_join(kept, "\n")


def index_clean(value: Column) -> Column:
    """Ideographic space to space, line ends unified, runs of blank, tab and newline one space."""
    unified = F.replace(F.replace(F.replace(_text(value), F.lit("　"), F.lit(" ")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.trim(F.regexp_replace(unified, "[ \t\n]+", " "))


def display(value: Column) -> Column:
    """Runs of blanks one space, newlines kept."""
    return F.trim(F.regexp_replace(F.translate(_text(value), " \r", " "), "[ \t]+", " "))


def usable(value: Column) -> Column:
    """Has any word or CJK character."""
    return _text(value).rlike(rf"(?U)[\w{CJK}]")


def visible_at_least(value: Column, count: int = 12) -> Column:
    return F.length(F.regexp_replace(_text(value), r"(?U)\s", "")) >= count


def token_count(value: Column) -> Column:
    """CJK characters, ASCII words, and a quarter of the punctuation marks, rounded up."""
    whole, marks = token_parts(value)
    return (whole + F.floor((marks + 3) / 4)).cast("long")


def token_parts(value: Column) -> tuple[Column, Column]:
    """CJK characters and ASCII words together, and punctuation marks."""
    t = _text(value)
    return F.regexp_count(t, F.lit(f"[{CJK}]")) + F.regexp_count(t, F.lit("[A-Za-z0-9_]+")), F.regexp_count(t, F.lit(rf"(?U)[^\w{CJK}\s]"))


def char_count(value: Column) -> Column:
    """The larger of word or CJK characters and non-space characters."""
    t = _text(value)
    return F.greatest(F.regexp_count(t, F.lit(rf"(?U)[\w{CJK}]")), F.regexp_count(t, F.lit(r"(?U)\S"))).cast("long")


def encoding_anomaly(value: Column) -> Column:
    """Replacement characters (doubled ones count again) reach max(2, length / 8)."""
    t = _text(value)
    found = F.regexp_count(t, F.lit("�")) + F.regexp_count(t, F.lit("��"))
    return found >= F.greatest(F.lit(2), F.floor(F.length(t) / 8))


def fold(value: Column) -> Column:
    """Lower case without accents in any script: composed letters by table, combining marks dropped."""
    return F.lower(F.translate(_text(value), ACCENTED, UNACCENTED))


def index_tokens(value: Column) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(value), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


def normal_standard(value: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(_text(value), r"(?U)\s+", ""), F.lit("—"), F.lit("-")))


def normal_title(value: Column) -> Column:
    """File name without suffix and copy number; digits, a-z and Han only."""
    stem = F.lower(F.regexp_replace(_text(value), r"(?i)\.(?:pdf|docx?|txt|md)$", ""))
    return F.regexp_replace(F.trim(F.regexp_replace(stem, r"(?:\(\d+\)|（\d+）)$", "")), f"[^0-9a-z{HAN}]+", "")


def clauses(value: Column, most: int | None = 8) -> Column:
    """Distinct dotted numbers in order; a question gives ``most`` of them, None all (documents)."""
    found = F.array_distinct(F.regexp_extract_all(_text(value), F.lit(CLAUSE), F.lit(1)))
    return found if most is None else F.slice(found, 1, most)


def standards(value: Column, most: int = 8) -> Column:
    found = F.regexp_extract_all(_text(value), F.lit(f"({STANDARD})"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, normal_standard)), 1, most)


def normal_warning(value: Column) -> Column:
    """Warning text without its page prefix and punctuation."""
    bare = F.regexp_replace(F.lower(_text(value)), r"^\s*(?:page|第)?\s*\d+\s*(?:页)?\s*[:：-]?\s*", "")
    return F.regexp_replace(bare, rf"(?U)[^\w{CJK}]+", "")


def explicit_terms(value: Column) -> Column:
    """ASCII words, dotted numbers and Han runs of two characters or more, lower-cased, in order, once each; clauses last."""
    found = F.regexp_extract_all(_text(value), F.lit(rf"([A-Za-z][A-Za-z0-9_-]*|\d+(?:\.\d+)+|[{HAN}]+)"), F.lit(1))
    kept = F.filter(F.transform(found, F.lower), lambda x: F.length(x) >= 2)
    all_clauses = F.array_distinct(F.regexp_extract_all(_text(value), F.lit(CLAUSE), F.lit(1)))
    return F.slice(F.array_distinct(F.concat(kept, all_clauses)), 1, 24)


def fallback_terms(value: Column) -> Column:
    """Short Han runs and their two- and three-character windows, stop words out."""
    runs = F.regexp_extract_all(_text(value), F.lit(f"([{HAN}]+)"), F.lit(1))
    stops = F.array(*[F.lit(s) for s in STOP_WORDS])

    def windows(run: Column) -> Column:
        def of(width: int) -> Column:
            every = F.when(F.length(run) >= width, F.transform(F.sequence(F.lit(1), F.length(run) - (width - 1)), lambda i: F.substring(run, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))
            return F.filter(every, lambda x: ~F.array_contains(stops, x))

        whole = F.when(F.length(run).between(2, 6), F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.concat(whole, of(2), of(3))

    return F.slice(F.array_except(F.array_distinct(F.flatten(F.transform(runs, windows))), explicit_terms(value)), 1, 48)


def query_terms(value: Column, most: int = 72) -> Column:
    return F.slice(F.array_distinct(F.concat(explicit_terms(value), fallback_terms(value))), 1, most)


def has_any(value: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(value, F.lit(w))
    return out


def route(value: Column, top_k: int = 30) -> Column:
    """Query type with its channel weights, reserves and expansion policy, as a struct."""
    t = F.trim(_text(value))
    k = max(1, top_k)

    def one(kind: str, lexical: float, vector: float, reserve: int, semantic: int, title: float, policy: str, reason: str) -> Column:
        return F.struct(
            F.lit(kind).alias("query_type"), F.lit(lexical).alias("bm25_weight"), F.lit(vector).alias("vector_weight"), F.lit(min(k, reserve)).alias("lexical_reserve"),
            F.lit(min(k, semantic)).alias("semantic_reserve"), F.lit(title).alias("title_weight"), F.lit(policy).alias("hierarchy_policy"), F.array(F.lit(reason)).alias("reasons"),
        )

    half = max(1, k // 2)
    return (
        F.when((F.size(standards(t)) > 0) | (F.size(clauses(t)) > 0), one("exact_identifier", 1.8, 0.55, 24, 6, 0.10, "off", "structured_identifier"))
        .when(has_any(t, TABLE_TERMS) | (F.contains(t, F.lit("表")) & has_any(t, TABLE_HINTS)), one("table_query", 1.6, 0.85, 22, 8, 0.15, "off", "table_language"))
        .when(t.rlike(UNIT) | has_any(t, NUMERIC_TERMS), one("numeric_unit", 1.6, 0.85, 22, 8, 0.10, "off", "numeric_or_unit_anchor"))
        .when(has_any(t, RISK_TERMS), one("risk_condition", 1.15, 1.65, 17, 13, 0.10, "auto", "risk_or_condition_language"))
        .when((F.length(t) >= 16) | has_any(t, PARAPHRASE_TERMS), one("natural_semantic", 0.9, 2.35, 12, 18, 0.10, "off", "natural_language_paraphrase"))
        .otherwise(one("general", 1.1, 1.75, half, max(1, k - half), 0.10, "auto", "balanced_default"))
    )


def leading_clause(value: Column) -> Column:
    return F.regexp_extract(clean(value), LEADING_CLAUSE, 1)


def heading_of(value: Column) -> Column:
    """The text if it reads as a heading, else an empty string."""
    t = clean(value)
    substantive = (leading_clause(value) != "") & (F.length(t) > 24)
    shaped = t.rlike(HEADING) | ((F.length(t) <= 80) & F.startswith(t, F.lit("第")))
    return F.when(~t.rlike(TERMINAL) & ~substantive & shaped, t).otherwise("")


def block_kind(text: Column, block_type: Column) -> Column:
    return F.when(text.rlike(LIST_ITEM), "list").when(F.startswith(block_type, F.lit("ocr")), "image_ocr").otherwise("paragraph")


def redact(value: Column) -> Column:
    """Key-like strings, bearer tokens, e-mail addresses and long digit runs masked."""
    out = _text(value)
    for pattern, mark in SECRETS:
        out = F.regexp_replace(out, pattern, mark)
    return out


#: What counts as a secret, and its mask.
SECRETS = [
    (r"sk-[A-Za-z0-9_-]{16,}", "[KEY]"),
    (r"[Bb]earer [A-Za-z0-9._-]{16,}", "[TOKEN]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[MAIL]"),
    (r"[0-9]{13,19}", "[NUMBER]"),
]


def has_secret(value: Column) -> Column:
    return _text(value).rlike("|".join(f"(?:{p})" for p, _ in SECRETS))


def basename(value: Column) -> Column:
    """Last part of a Windows or POSIX path."""
    return F.regexp_extract(_text(value), r"([^/\\]*)[/\\]*$", 1)


def unwrap_url(value: Column, parameter: str = "uddg") -> Column:
    """Target of a redirect URL that carries it in a parameter, else the URL itself."""
    inner = F.regexp_extract(_text(value), rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(_text(value))


def needs_web(value: Column) -> Column:
    """The first rule of WEB_RULES that the question meets decides; none means no."""
    t = F.lower(_text(value))
    return F.coalesce(*[F.when(t.rlike(pattern), answer) for pattern, answer in WEB_RULES], F.lit(False))


def failure_kind(value: Column) -> Column:
    """Category of a generation error: the first of FAILURE_SIGNS with a sign in its text."""
    t = F.lower(F.trim(F.regexp_replace(_text(value), r"(?U)\s+", " ")))
    return F.coalesce(*[F.when(has_any(t, signs), kind) for kind, signs in FAILURE_SIGNS.items()], F.lit(OTHER_FAILURE))


#: Accepted spellings of damage levels, and their order.
LEVELS = ["undetermined", "low", "medium", "high", "critical"]
LEVEL_ALIASES = {
    "undetermined": "undetermined", "待判定": "undetermined", "未判定": "undetermined", "未证实": "undetermined", "未證實": "undetermined",
    "低": "low", "低风险": "low", "低風險": "low", "low": "low", "中": "medium", "中等": "medium", "中风险": "medium", "中風險": "medium", "medium": "medium",
    "高": "high", "高风险": "high", "高風險": "high", "high": "high", "严重": "critical", "嚴重": "critical", "危急": "critical", "critical": "critical",
}


def damage_level(value: Column) -> Column:
    """Level of an alias; raises on anything else."""
    names = F.create_map(*[F.lit(x) for pair in LEVEL_ALIASES.items() for x in pair])
    key = F.lower(F.trim(_text(value)))
    return F.coalesce(F.element_at(names, key), F.raise_error(F.concat(F.lit("unsupported damage level: "), key)).cast("string"))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 1


def traditional_to_simplified(value: Column, old: str, new: str, protected: Column | None = None) -> Column:
    """One-to-one character map, left out where ``protected`` holds."""
    mapped = F.translate(_text(value), old, new)
    return mapped if protected is None else F.when(protected, value).otherwise(mapped)


@F.pandas_udf(T.StringType())
def compatibility(values: pd.Series) -> pd.Series:
    """NFKC, casefold, white space removed."""
    return values.map(lambda v: None if v is None else "".join(unicodedata.normalize("NFKC", v).casefold().split()))


@F.pandas_udf(T.StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


@F.pandas_udf(T.StringType())
def fold_any(values: pd.Series) -> pd.Series:
    """Lower case with all combining marks removed."""
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFD", v.lower()) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
