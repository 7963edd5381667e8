"""From hits to prompt-ready rows: context, history, keys, citations and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fn
from .scan import top_per_group

# ---- Fixed values ------------------------------------------------------------
CONTEXT_TOKENS, HISTORY_TOKENS, HISTORY_PAIRS = 4000, 1000, 6
QUESTION_CHARS, ANSWER_CHARS, REFERENCE_CHARS = 200, 300, 400
PIECE_JOINT = "\n\n---\n\n"
MAX_ROUNDS = 2
# ------------------------------------------------------------------------------


def _pack(pieces: DataFrame, key: str, order: str, budget: int | Column, joint: str, text: str, tokens: str) -> DataFrame:
    """Leading pieces whose estimated tokens fit the budget; the first always stays.

    The sum only grows, so a running sum finds the place where a loop would stop.
    """
    sized = pieces.withColumn("_t", fn("est_tokens", t="piece"))
    w = W.partitionBy(key).orderBy(order)
    run = sized.withColumns({"_n": F.row_number().over(w), "_sum": F.sum("_t").over(
        w.rowsBetween(W.unboundedPreceding, 0))})
    kept = run.filter((F.col("_n") == 1) | (F.col("_sum") <= budget))
    return kept.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "piece"))), lambda x: x["piece"]), joint).alias(text),
        F.sum("_t").alias(tokens))


def context_piece() -> Column:
    page = F.when(F.coalesce("page_no", F.lit(0)) != 0, F.concat(F.lit(" 第"), F.col("page_no").cast("string"), F.lit("页"))).otherwise("")
    path = F.when(F.coalesce("heading_path", F.lit("")) != "", F.concat(F.lit("（"), "heading_path", F.lit("）"))).otherwise("")
    return F.concat(F.lit("[来源: "), "filename", page, F.lit("]"), path, F.lit("\n"), "content")


def pack_context(hits: DataFrame, budget: int | Column = CONTEXT_TOKENS) -> DataFrame:
    """ANS-2: context text of each question from its hits in rank order.

    ``hits(query_id, rank, filename, page_no, heading_path, content)``; a search
    returns at most 20 hits per question.
    """
    return _pack(hits.withColumn("piece", context_piece()), "query_id", "rank", budget, PIECE_JOINT, "context", "context_tokens")


def pack_history(pairs: DataFrame, key: str = "conv_id", order: str = "pair_no", budget: int = HISTORY_TOKENS) -> DataFrame:
    """ANS-3: the last six question-answer pairs of each session within the budget."""
    last = top_per_group(pairs, [key], [F.desc(order)], HISTORY_PAIRS, "_back")
    piece = F.concat(F.lit("问："), F.substring("query", 1, QUESTION_CHARS), F.lit("\n答："), F.substring("answer", 1, ANSWER_CHARS))
    return _pack(last.withColumn("piece", piece), key, order, budget, "\n\n", "history", "history_tokens")


def with_query_key(df: DataFrame, column: str = "query") -> DataFrame:
    """ANS-4: normalised question and its key."""
    return df.withColumn("normal", fn("normalize_query", t=column)).withColumn("query_hash", F.md5("normal"))


def with_route(df: DataFrame, column: str = "query") -> DataFrame:
    """ANS-5: long questions and those with a comparing word take the agent."""
    return df.withColumn("complex", fn("needs_agent", t=column))


def citations(hits: DataFrame) -> DataFrame:
    """ANS-6: numbered citations per question; a search gives at most 20."""
    one = F.struct(F.col("rank").alias("index"), F.col("filename").alias("doc_name"), (F.col("page_no") + 1).alias("page_no"),
                   F.bround("score", 3).alias("score"))
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("citations"))


def final_route(runs: DataFrame) -> DataFrame:
    """ANS-7: outcome of a run from its step flags; refused means guard or no answer.

    ``runs(run_id, route, sufficient, rounds)``: a run that still lacks evidence after
    the allowed rounds ends without an answer.
    """
    given_up = ~F.coalesce("sufficient", F.lit(True)) & (F.coalesce("rounds", F.lit(0)) > MAX_ROUNDS)
    searched = F.col("route").isin("simple", "standard", "complex")
    outcome = (F.when(F.col("route") == "out_of_scope", "guard").when(searched & given_up, "no_answer").otherwise(F.col("route")))
    nxt = (F.when(~searched, "end").when(F.coalesce("sufficient", F.lit(True)), "generate").when(given_up, "no_answer").otherwise("rewrite"))
    return runs.select("run_id", outcome.alias("final_route"), outcome.isin("guard", "no_answer").alias("refused"), nxt.alias("next_step"))


def fill(template: Column, **values: Column) -> Column:
    """ANS-8: ``{name}`` marks of a template replaced; other braces are left alone."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def prompt_sections(df: DataFrame) -> DataFrame:
    """ANS-8: user prompt; missing sections are skipped, the order is fixed.

    Reads ``memory, ref_query, ref_answer, history, context, query``.
    """
    memory = F.when(F.col("memory").isNotNull(), F.concat(
        F.lit("【长期记忆】\n"), "memory", F.lit("\n（长期记忆仅供了解用户背景，回答仍须依据【资料】）")))
    cached = F.when(F.col("ref_query").isNotNull(), F.concat(
        F.lit("【历史回答参考】\n问："), "ref_query", F.lit("\n答："), F.substring("ref_answer", 1, REFERENCE_CHARS),
        F.lit("\n（历史回答参考，可能不完全相关，请以【资料】为准）")))
    past = F.when(F.coalesce("history", F.lit("")) != "", F.concat(
        F.lit("【历史对话】\n"), "history", F.lit("\n（历史对话仅供理解上下文，回答仍须依据【资料】）")))
    return df.withColumn("prompt", F.concat_ws(
        "\n\n", memory, cached, past, F.concat(F.lit("【资料】\n"), F.coalesce("context", F.lit(""))), F.concat(F.lit("【问题】\n"), "query")))
