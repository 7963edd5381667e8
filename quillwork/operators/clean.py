"""Cleaning, quality checks and safety screens of node texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_QUERY_CHARS, fn, sql_call

# ---- Fixed values ------------------------------------------------------------
KEEP_SPACES = ["code", "table"]
DUPLICATE_SHARE = 0.9
MIN_TEXT_CHARS = 10
REASON_CHARS = 2000
FILE_DEFECT_MARKERS = ["bandwriter", "invalid bandwriter header", "cannot read xref", "syntax error",
                       "jbig2dec", "unsupported filter", "damage"]
RETRIABLE_CLASSES = ["httpx.ConnectError", "httpx.ReadTimeout", "httpx.ConnectTimeout", "httpx.HTTPStatusError"]
SUMMARY_CHARS, DETAIL_CHARS = 120, 300
# rule name -> (pattern, replacement), applied in this order
CLEAN_RULES = [
    ("nl", r"\r\n?", "\n"),
    ("ctrl", r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""),
    ("zw", r"[​-‏﻿]", ""),
    ("space", r"[\xa0  -   　]", " "),
    ("mspace", r" {2,}", " "),
    ("blank", r"\n{3,}", "\n\n"),
    ("strip", r"(?U)^\s+|\s+$", ""),
]
# ------------------------------------------------------------------------------
_SPACE_RULES = {"space", "mspace"}
# No rule changes a text without these: single characters of Latin-1, one range and two characters beyond it, runs. The
# classes hold more than the rules name where that makes them quick to test.
_DIRTY_LATIN = "[" + "".join(rf"\x{i:02x}" for i in (*range(9), 11, 12, *range(13, 32), 160)) + "]"
_DIRTY_WIDE = r"[\x{1680}-\x{206f}\x{3000}\x{feff}]"
_DIRTY_RUNS = "  ", "\n\n\n"
_END_BLANK = r"(?U)\s"


def clean_nodes(nodes: DataFrame, text: str = "text", kind: str = "type") -> DataFrame:
    """CLN-1: clean texts by node type and name the rules that changed them (``flags``)."""
    out = nodes.withColumn("_0", F.col(text))
    for i, (name, pattern, replacement) in enumerate(CLEAN_RULES):
        changed = F.regexp_replace(f"_{i}", pattern, replacement)
        if name in _SPACE_RULES:
            changed = F.when(F.col(kind).isin(KEEP_SPACES), F.col(f"_{i}")).otherwise(changed)
        if name == "strip":
            changed = F.when(F.col(kind) == "code", F.col(f"_{i}")).otherwise(changed)
        out = out.withColumn(f"_{i + 1}", changed)
    flags = F.array_compact(F.array(*[
        F.when(F.col(f"_{i + 1}") != F.col(f"_{i}"), F.lit(name)) for i, (name, _, _) in enumerate(CLEAN_RULES)]))
    return (out.withColumn(text, F.col(f"_{len(CLEAN_RULES)}")).withColumn("flags", flags)
            .drop(*[f"_{i}" for i in range(len(CLEAN_RULES) + 1)]))


def clean_text(text: Column, kind: Column) -> Column:
    """CLN-1 on one value, for texts held in arrays. Most texts are clean, which quick tests show."""
    dirty = F.substring(text, 1, 1).rlike(_END_BLANK) | F.substring(text, -1, 1).rlike(_END_BLANK)
    for run in _DIRTY_RUNS:
        dirty = dirty | F.contains(text, F.lit(run))
    dirty = dirty | text.rlike(_DIRTY_LATIN) | ((F.octet_length(text) > F.length(text)) & text.rlike(_DIRTY_WIDE))
    out = text
    for name, pattern, replacement in CLEAN_RULES:
        changed = F.regexp_replace(out, pattern, replacement)
        if name in _SPACE_RULES:
            changed = F.when(kind.isin(KEEP_SPACES), out).otherwise(changed)
        if name == "strip":
            changed = F.when(kind == "code", out).otherwise(changed)
        out = changed
    return F.when(dirty, out).otherwise(text)


def drop_junk(nodes: DataFrame, text: str = "text") -> DataFrame:
    """CLN-2: nodes with something left after blanks and punctuation are removed."""
    return nodes.filter(~fn("is_junk", t=text))


def file_flags(nodes: DataFrame) -> DataFrame:
    """CLN-3: every cleaning flag of a file, sorted; none for a clean file."""
    one = nodes.select("file_id", F.explode_outer("flags").alias("flag")).distinct()
    return one.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("flag")), ",").alias("flags"))


def quality(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """QLT-1: measures and problems per file; a file without nodes is empty."""
    per_text = nodes.groupBy("file_id", "text").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("type") == "table").alias("tab"),
        F.bool_or(F.col("type") == "image").alias("img"))
    per_file = per_text.groupBy("file_id").agg(
        F.sum("n").alias("nodes"), F.max("n").alias("top"), F.bool_or("tab").alias("tab"), F.bool_or("img").alias("img"),
        F.sum(F.length("text") * F.col("n")).alias("chars"),
        F.coalesce(F.sum(F.when(fn("is_placeholder", t="text"), F.col("n"))), F.lit(0)).alias("placeholders"))
    joined = files.select("file_id").join(per_file, "file_id", "left")
    empty = F.col("nodes").isNull()
    dup = (F.col("nodes") > 1) & (F.col("top") / F.col("nodes") > DUPLICATE_SHARE)
    short = (F.col("chars") < MIN_TEXT_CHARS) & ~F.col("tab") & ~F.col("img")
    return joined.select(
        "file_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("chars", F.lit(0)).alias("chars"),
        F.coalesce("placeholders", F.lit(0)).alias("placeholders"), empty.alias("empty"),
        F.coalesce(dup, F.lit(False)).alias("duplicated"), F.coalesce(short, F.lit(False)).alias("short"),
        F.round(F.coalesce(F.col("top") / F.col("nodes"), F.lit(0.0)), 6).alias("top_share"))


def file_status(checked: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """QLT-2: failed, partial or success; a short text alone does not fail a file."""
    df = checked
    error = F.lit(None).cast("string")
    if errors is not None:
        df = df.join(errors, "file_id", "left")
        error = F.col("error")
    fatal = F.concat_ws("；", F.when(F.col("empty"), "空产物"), F.when(F.col("duplicated"), "重复率过高"))
    has_error = F.coalesce(error, F.lit("")) != ""
    return df.select(
        "file_id",
        F.when(has_error | F.col("empty") | F.col("duplicated"), "failed")
        .when(F.col("placeholders") > 0, "partial").otherwise("success").alias("status"),
        F.when(has_error, error).otherwise(fatal).alias("reason"))


def extract_placeholders(nodes: DataFrame) -> DataFrame:
    """QLT-3: failed spots of a parse as issue rows."""
    return nodes.filter(fn("is_placeholder", t="text")).select(
        "file_id", F.coalesce("page", F.lit(0)).alias("page_no"), F.col("idx").alias("block_order"),
        F.col("type").alias("block_type"), F.substring("text", 1, REASON_CHARS).alias("reason"))


def _cut(c: Column, n: int) -> Column:
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, "…").otherwise(""))


def classify_errors(errors: DataFrame) -> DataFrame:
    """QLT-4: kind of an error from its class and message, first rule wins."""
    msg = F.when(F.coalesce("message", F.lit("")) == "", F.col("class_name")).otherwise(F.col("message"))
    low = F.lower(msg)
    defect = F.col("module").contains("pymupdf")
    for marker in FILE_DEFECT_MARKERS:
        defect = defect | F.contains(low, F.lit(marker))
    invalid = F.lower("class_name").contains("validation") | (F.col("class_name") == "ValueError")
    again = (F.col("class_name").isin([*RETRIABLE_CLASSES, "LLMError"])
             | F.contains(low, F.lit("timeout")) | F.contains(msg, F.lit("429")))
    flat = F.regexp_replace(F.regexp_replace(msg, r"(?U)^\s+|\s+$", ""), "[\n\r]", " ")
    return errors.select(
        "id", F.when(defect, "unfixable_file").when(invalid, "discard_block").when(again, "retriable")
        .otherwise("unclassified").alias("kind"),
        _cut(flat, SUMMARY_CHARS).alias("summary"), _cut(flat, DETAIL_CHARS).alias("detail"))


def screen_queries(df: DataFrame, column: str, max_chars: int = MAX_QUERY_CHARS) -> DataFrame:
    """SAF-1: screen whole queries and cut what is shown; the first injection pattern found is named."""
    stripped = df.withColumn("query", F.expr(sql_call("strip_text", t=f"coalesce({column}, '')")))
    pattern = fn("injection_pattern", t="query")
    return stripped.withColumn("pattern", pattern).withColumn(
        "reason", F.when(F.col("query") == "", "empty_query").when(
            F.col("pattern") != "", F.concat(F.lit("prompt_injection:"), F.col("pattern"))).otherwise("")).withColumn(
        "safe", F.col("reason") == "").withColumn("query", F.substring("query", 1, max_chars))


def screen_documents(df: DataFrame, column: str) -> DataFrame:
    """SAF-1: the same patterns over whole document texts."""
    return df.withColumn("pattern", fn("injection_pattern", t=f"coalesce({column}, '')")).withColumn(
        "suspicious", F.col("pattern") != "")
