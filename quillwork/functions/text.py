"""Scalar functions written once as SQL expressions.

Each body serves three uses: inside operators (``fn``), inside SQL text
(``sql_call``) and as a temporary SQL function (``register_functions``).
All of them are inlined by Catalyst, so no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values: must equal the source system's for equal results ----------
FULL_WIDTH = "　，。！？；：（）【】“”‘’"
HALF_WIDTH = " ,.!?;:()[]\"\"''"
REFUSAL_MARKERS = ["未找到", "没有找到", "无法回答", "不在", "没有相关", "未包含"]
REFUSAL_LOG_MARKERS = ["未找到", "无法回答"]
ROUTE_KEYWORDS = ["对比", "差异", "区别", "比较", "总结", "分析", "分别", "哪些文档", "关系", "影响"]
ROUTE_MIN_LENGTH = 40
STOP_WORDS = [
    "的", "了", "是", "在", "和", "与", "或", "用", "为", "有", "个", "中", "里",
    "什么", "怎么", "如何", "多少", "哪些", "哪个", "是否", "吗", "呢", "啊", "吧",
    "文件", "内容", "里面", "这个", "那个", "一个", "请", "我", "你", "它", "要", "可以",
]
PLACEHOLDER_MARKERS = ["[图片解析失败]", "[图片无法解析]", "[该页解析失败]", "[该页转录为空]"]
INJECTION_PATTERNS = [
    ("instruction_override_en",
     r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?|rules?)"),
    ("instruction_override_zh",
     r"忽略.{0,6}(之前|以上|先前|上面).{0,6}(指令|提示|规则|设定)"),
    ("role_play_dan",
     r"(?i)(you\s+are\s+now|pretend\s+(to\s+be|you\s+are)|act\s+as\s+(if|a))\s+(DAN|unrestricted|unfiltered)"),
    ("role_play_zh",
     r"(你现在是|请扮演|假装你是)\s*(一个|the)?\s*(DAN|不受限|无限制)"),
    ("system_leak_en",
     r"(?i)(repeat|output|show|print|display)\s+(your\s+)?(system\s+prompt|instructions?|rules?)\s*(above|verbatim|exactly)"),
    ("system_leak_zh",
     r"(重复|输出|显示|打印).{0,4}(系统提示|系统指令|你的指令|你的规则)"),
    ("delimiter_injection",
     r"(?i)(\\n|#|---)\s*(system|assistant|user)\s*:"),
]
MAX_QUERY_CHARS = 2000
MAX_CONTENT_CHARS = 50000
# ------------------------------------------------------------------------------

WORD = r"[\p{L}\p{M}\p{N}_&&[^一-鿿]]+"


def quote(text: str) -> str:
    """SQL string literal without escape processing surprises."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(values: list[str]) -> str:
    return "array(" + ", ".join(quote(v) for v in values) + ")"


def _contains_any(markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({{t}}, {quote(m)})" for m in markers) + ")"


def _first_pattern() -> str:
    # (?U): white space of every alphabet, the full-width blank too
    tests = ", ".join(f"CASE WHEN {{t}} RLIKE {quote('(?U)' + rx)} THEN {quote(name)} END"
                      for name, rx in INJECTION_PATTERNS)
    return f"coalesce({tests}, '')"


# a text is searched for blanks only if it begins or ends with one
STRIP = (r"(CASE WHEN substring({t}, 1, 1) RLIKE r'(?U)\s' OR substring({t}, -1, 1) RLIKE r'(?U)\s' "
         r"THEN regexp_replace({t}, r'(?U)^\s+|\s+$', '') ELSE {t} END)")

# name -> (parameters, return type, body); {x} marks a parameter
FUNCTIONS: dict[str, tuple[list[tuple[str, str]], str, str]] = {
    "strip_text": ([("t", "STRING")], "STRING", STRIP),
    "est_tokens": (
        [("t", "STRING")], "BIGINT",
        r"cast(floor((3 * (length({t}) - length(regexp_replace({t}, r'[一-鿿]', ''))) * 4"
        r" + 5 * length(regexp_replace({t}, r'[一-鿿]', ''))) / 20) as bigint)"),
    "normalize_query": (
        [("t", "STRING")], "STRING",
        "regexp_replace(regexp_replace(regexp_replace(translate({t}, "
        + quote(FULL_WIDTH) + ", " + quote(HALF_WIDTH)
        + r"), r'(?U)\s+', ' '), '^ | $', ''), r'[。！？?!.]+$', '')"),
    "is_junk": ([("t", "STRING")], "BOOLEAN", r"NOT {t} RLIKE r'(?U)[^\s\W_]'"),
    "looks_refused": ([("t", "STRING")], "BOOLEAN", _contains_any(REFUSAL_MARKERS)),
    "log_refused": ([("t", "STRING")], "BOOLEAN", _contains_any(REFUSAL_LOG_MARKERS)),
    "needs_agent": (
        [("t", "STRING")], "BOOLEAN",
        f"(length({{t}}) >= {ROUTE_MIN_LENGTH} OR {_contains_any(ROUTE_KEYWORDS)})"),
    "injection_pattern": ([("t", "STRING")], "STRING", _first_pattern()),
    "sanitize_content": (
        [("t", "STRING")], "STRING",
        f"replace(replace(replace(substring(coalesce({{t}}, ''), 1, {MAX_CONTENT_CHARS}), "
        "'<|system|>', '[system]'), '<|user|>', '[user]'), '<|assistant|>', '[assistant]')"),
    "tokenize": (
        [("t", "STRING")], "ARRAY<STRING>",
        "concat(regexp_extract_all(lower({t}), r'" + WORD + "', 0), "
        r"CASE WHEN {t} RLIKE r'[一-鿿]' THEN concat(regexp_extract_all({t}, r'(?=([一-鿿]{2}))', 1), "
        r"regexp_extract_all({t}, r'(?<![一-鿿])[一-鿿](?![一-鿿])', 0)) "
        "ELSE cast(array() as array<string>) END)"),
    "content_terms": (
        [("t", "STRING")], "ARRAY<STRING>",
        r"array_distinct(concat(regexp_extract_all({t}, r'[A-Za-z0-9_]{2,}', 0), "
        r"array_except(regexp_extract_all({t}, r'(?=([一-鿿]{2}))', 1), "
        + array_of(STOP_WORDS) + ")))"),
    "has_placeholder": ([("t", "STRING")], "BOOLEAN", _contains_any(PLACEHOLDER_MARKERS)),
    "is_placeholder": (
        [("t", "STRING")], "BOOLEAN",
        "(" + " OR ".join(f"startswith({{t}}, {quote(m)})" for m in PLACEHOLDER_MARKERS) + ")"),
    "dot": (
        [("a", "ARRAY<FLOAT>"), ("b", "ARRAY<FLOAT>")], "DOUBLE",
        "aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), "
        "cast(0 as double), (s, v) -> s + v)"),
    "cosine": (
        [("a", "ARRAY<FLOAT>"), ("b", "ARRAY<FLOAT>")], "DOUBLE",
        "aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), "
        "cast(0 as double), (s, v) -> s + v) / greatest(1e-12D, "
        "sqrt(aggregate({a}, cast(0 as double), (s, v) -> s + cast(v as double) * cast(v as double))) * "
        "sqrt(aggregate({b}, cast(0 as double), (s, v) -> s + cast(v as double) * cast(v as double))))"),
    "unit_vector": (
        [("a", "ARRAY<FLOAT>")], "ARRAY<DOUBLE>",
        "transform({a}, v -> cast(v as double) / greatest(1e-12D, "
        "sqrt(aggregate({a}, cast(0 as double), (s, w) -> s + cast(w as double) * cast(w as double)))))"),
}
FUNCTIONS["query_hash"] = (
    [("t", "STRING")], "STRING", "md5(" + FUNCTIONS["normalize_query"][2] + ")")


def _bind(body: str, args: dict[str, str]) -> str:
    for param, value in args.items():
        body = body.replace("{" + param + "}", value)
    return body


def sql_call(name: str, **args: str) -> str:
    """Body of a function with its parameters replaced by SQL expressions."""
    return "(" + _bind(FUNCTIONS[name][2], args) + ")"


def fn(name: str, **args: str) -> Column:
    return F.expr(sql_call(name, **args))


def register_functions(spark: SparkSession) -> None:
    """Make every scalar function callable from SQL text."""
    for name, (params, returns, body) in FUNCTIONS.items():
        signature = ", ".join(f"{p} {t}" for p, t in params)
        text = _bind(body, {p: p for p, _ in params})
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {returns} RETURN {text}")
