"""Evaluation, gates, feedback triage and prompt registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fn
from .ledger import upsert
from .scan import latest_per_key

# ---- Fixed values ------------------------------------------------------------
COMPARED = ["context_recall", "mrr", "refuse_accuracy"]
GATE_LIMITS = {"context_recall": -0.05, "mrr": -0.10, "refuse_accuracy": -0.10}
RUNS_SHOWN, CASES_SHOWN = 50, 100
SNAPSHOT_CHARS = 500
# ------------------------------------------------------------------------------


def seed_questions(base: DataFrame, new: DataFrame) -> DataFrame:
    """EVL-1: unknown questions are added, known ones take the new regression flag."""
    return upsert(base, new, ["question"], ["in_regression"], ["seq"])


def match_all(content: Column, keywords: Column) -> Column:
    """EVL-2: the chunk holds every keyword; without keywords there is no evidence."""
    return F.coalesce((F.size(keywords) > 0) & F.forall(keywords, lambda k: F.contains(content, k)), F.lit(False))


def match_any(content: Column, keywords: Column) -> Column:
    return F.coalesce(F.exists(keywords, lambda k: F.contains(content, k)), F.lit(False))


def score_questions(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """EVL-3: first hit rank, reciprocal rank and context precision per question.

    ``hits(query_id, rank, content)``, ``questions(query_id, keywords)``.
    """
    judged = hits.join(questions.select("query_id", "keywords"), "query_id").select(
        "query_id", "rank", match_all(F.col("content"), F.col("keywords")).alias("all_hit"),
        match_any(F.col("content"), F.col("keywords")).alias("any_hit"))
    per = judged.groupBy("query_id").agg(
        F.min(F.when(F.col("all_hit"), F.col("rank"))).alias("hit_rank"), F.count_if("any_hit").alias("rel"), F.count(F.lit(1)).alias("n"))
    return questions.join(per, "query_id", "left").select(
        "query_id", "hit_rank", F.col("hit_rank").isNotNull().alias("recall_hit"),
        F.coalesce(1 / F.col("hit_rank"), F.lit(0.0)).alias("rr"),
        F.when(F.size("keywords") > 0, F.bround(F.col("rel") / F.col("n"), 4)).alias("context_precision"))


def with_refused(answers: DataFrame, answer: str = "answer", flag: str = "refused") -> DataFrame:
    """EVL-4: refusal by flag or by the wording."""
    return answers.withColumn("looks_refused", F.coalesce(F.col(flag), F.lit(False)) | fn("looks_refused", t=answer))


def aggregate_eval(scores: DataFrame) -> DataFrame:
    """EVL-5: metrics per run and dimension and per run overall in one aggregate.

    ``scores(run_id, dimension, hit_rank, context_precision, refused, faithfulness, relevancy)``.
    """
    refuse = F.col("dimension") == "refuse"
    staged = scores.withColumns({
        "r": F.when(~refuse, F.when(F.col("hit_rank").isNotNull(), 1.0).otherwise(0.0)),
        "m": F.when(~refuse, F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))),
        "f": F.when(refuse, F.when(F.coalesce("refused", F.lit(False)), 1.0).otherwise(0.0))})
    rows = staged.groupingSets([["run_id", "dimension"], ["run_id"]], "run_id", "dimension").agg(
        F.grouping("dimension").alias("g"), F.count(F.lit(1)).alias("n"), F.avg("r").alias("r"), F.avg("m").alias("m"),
        F.avg("context_precision").alias("c"), F.avg("f").alias("f"), F.avg("faithfulness").alias("fa"), F.avg("relevancy").alias("re"))
    one = F.col("g") == 0
    return rows.select(
        "run_id", F.when(one, F.col("dimension")).otherwise("overall").alias("dimension"), "n",
        F.bround("r", 4).alias("context_recall"), F.bround("m", 4).alias("mrr"), F.bround("c", 4).alias("context_precision"),
        F.bround("f", 4).alias("refuse_accuracy"), F.when(one, F.bround("fa", 4)).alias("faithfulness"),
        F.when(one, F.bround("re", 4)).alias("relevancy"))


def exclude_types(hits: DataFrame, types: list[str]) -> DataFrame:
    """EVL-6: drop chunk types after the search; what remains moves up."""
    kept = hits.filter(~F.col("chunk_type").isin(types)).withColumnRenamed("rank", "old_rank")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("old_rank")).cast("bigint"))


def compare_systems(rankings: DataFrame, golden: DataFrame, systems: list[str], k: int = 5) -> DataFrame:
    """EVL-7: recall at ``k`` of each of the ``systems``, overall and per category.

    ``rankings(system, query_id, rank, file)``, ``golden(query_id, file, category)``.
    """
    asked = golden.select("query_id", "category").distinct()
    found = (rankings.filter(F.col("rank") <= k).join(golden.select("query_id", "file").distinct(), ["query_id", "file"], "left_semi")
             .select("system", "query_id").distinct().withColumn("hit", F.lit(1)))
    grid = asked.withColumn("system", F.explode(F.array(*[F.lit(s) for s in systems])))
    per = grid.join(found, ["system", "query_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    out = per.groupingSets([["system", "category"], ["system"]], "system", "category").agg(
        F.grouping("category").alias("g"), F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.avg("hit").alias("recall"))
    return out.select("system", F.when(F.col("g") == 1, "overall").otherwise(F.col("category")).alias("category"), "n", "hits", F.round("recall", 6).alias("recall"))


def long_metrics(runs: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{m}', {m}" for m in COMPARED)
    return runs.selectExpr("run_id", f"stack({len(COMPARED)}, {pairs}) as (metric, value)").filter("value is not null")


def compare_runs(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """EVL-8: metric differences b - a for each wanted pair ``(run_a, run_b)``."""
    m = long_metrics(runs)
    a = m.select(F.col("run_id").alias("run_a"), "metric", F.col("value").alias("va"))
    b = m.select(F.col("run_id").alias("run_b"), "metric", F.col("value").alias("vb"))
    return pairs.join(a, "run_a").join(b, ["run_b", "metric"]).select(
        "run_a", "run_b", "metric", F.bround(F.col("vb") - F.col("va"), 4).alias("delta"))


def check_gate(deltas: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """EVL-9: a pair of runs passes when no metric falls below its limit."""
    limits = {**GATE_LIMITS, **(limits or {})}
    limit = F.create_map(*[x for m, v in limits.items() for x in (F.lit(m), F.lit(v))])
    failed = F.coalesce(F.col("delta") < F.try_element_at(limit, F.col("metric")), F.lit(False))
    out = deltas.withColumn("_bad", failed).groupBy("run_a", "run_b").agg(
        F.count_if("_bad").alias("failures"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("_bad"), F.col("metric")))), ",").alias("failed"))
    return out.withColumn("passed", F.col("failures") == 0)


def list_runs(runs: DataFrame) -> DataFrame:
    """EVL-10: the newest runs."""
    return runs.orderBy(F.desc("run_id")).limit(RUNS_SHOWN)


def run_results(results: DataFrame, questions: DataFrame) -> DataFrame:
    """EVL-10: results with their question."""
    return results.join(questions, "question_id")


def ablation(metrics: DataFrame, base: str) -> DataFrame:
    """EVL-11: overall metrics of each variant and their distance to the base variant; null where that is missing."""
    found = metrics.filter(F.col("variant") == base).select(*COMPARED).first()   # one row of numbers
    reference = found.asDict() if found else {}
    return metrics.select("variant", *COMPARED, *[
        F.bround(F.col(m) - F.lit(reference.get(m)).cast("double"), 4).alias(f"d_{m}") for m in COMPARED])


# ---------------------------------------------------------------- feedback

def bad_cases(feedback: DataFrame, log: DataFrame, chunks: DataFrame) -> DataFrame:
    """FBK-1: negative ratings with a snapshot of question, answer, route and cited chunks."""
    rated = feedback.filter("rating < 0").select(F.col("id").alias("case_id"), "qa_log_id", "user_id").join(
        log.select(F.col("id").alias("qa_log_id"), "query", "answer", "route", "chunk_ids"), "qa_log_id")
    cited = (rated.select("case_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
             .join(chunks.select("chunk_id", F.substring("content", 1, SNAPSHOT_CHARS).alias("content")), "chunk_id")
             .groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.col("chunk_id").alias("id"), "content"))).alias("chunks")))
    none = F.expr("cast(array() as array<struct<id:bigint,content:string>>)")
    return rated.drop("chunk_ids").join(cited, "case_id", "left").withColumn("chunks", F.coalesce("chunks", none)).withColumn(
        "snapshot", F.to_json(F.struct("query", "answer", "route", "chunks")))


def latest_correction(feedback: DataFrame) -> DataFrame:
    """FBK-2: newest correction per answer."""
    return latest_per_key(feedback.select("qa_log_id", "id", "correction"), ["qa_log_id"], ["id"]).select(
        "qa_log_id", F.coalesce("correction", F.lit("")).alias("correction"))


def attribute(cases: DataFrame, label: str | None = None) -> DataFrame:
    """FBK-3: without chunks the search failed, else the answer; a foreign label counts as generation."""
    rule = F.when(F.size("chunks") == 0, "retrieval").otherwise("generation")
    if label is not None:
        given = F.when(F.col(label).isin("retrieval", "generation"), F.col(label)).otherwise("generation")
        rule = F.when(F.col(label).isNotNull(), given).otherwise(rule)
    return cases.withColumn("attribution", rule)


def promote(cases: DataFrame, questions: DataFrame) -> DataFrame:
    """FBK-4: confirmed cases join the regression set; of cases with one question the first adds it.

    ``cases(case_id, query, correction, attribution)``, ``questions(question, reference_answer, dimension, in_regression, origin)``.
    """
    first = latest_per_key(cases.select(F.col("query").alias("question"), "case_id", "correction"), ["question"], ["case_id"], first=True)
    new = first.select("question", F.coalesce("correction", F.lit("")).alias("reference_answer"), F.lit("factual").alias("dimension"),
                       F.lit(True).alias("in_regression"), F.concat(F.lit("bad_case:"), F.col("case_id").cast("string")).alias("origin"), "case_id")
    return upsert(questions, new, ["question"], ["in_regression"], ["case_id"])


def list_cases(cases: DataFrame, status: str = "", user: int | None = None) -> DataFrame:
    """FBK-5: newest cases, optionally of one state and user."""
    out = cases if not status else cases.filter(F.col("status") == status)
    out = out if user is None else out.filter(F.col("user_id") == user)
    return out.orderBy(F.desc("id")).limit(CASES_SHOWN)


# ---------------------------------------------------------------- prompts

def active_prompts(registry: DataFrame, defaults: DataFrame) -> DataFrame:
    """PRM-1: registered text while active, else the default."""
    live = registry.filter("status = 1").select("code", F.col("content").alias("own"), "version")
    return live.join(defaults.select("code", F.col("content").alias("std")), "code", "full").select(
        "code", F.coalesce("own", "std").alias("content"), F.coalesce("version", F.lit(0)).alias("version"))


def apply_decisions(registry: DataFrame, approvals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRM-1: the first decision of a pending approval counts; each approved text raises the version.

    Returns the new registry and the new approvals.
    """
    first = latest_per_key(decisions.select("approval_id", "seq", "decision"), ["approval_id"], ["seq"], first=True)
    decided = approvals.join(first.toDF("approval_id", "seq", "verdict"), approvals.id == F.col("approval_id"), "left").withColumn(
        "_open", (F.col("decision") == "pending") & F.col("verdict").isNotNull())
    after = decided.select("id", "prompt_code", "new_content", F.when(F.col("_open"), F.when(
        F.col("verdict") == "approved", "approved").otherwise("rejected")).otherwise(F.col("decision")).alias("decision"))
    changes = decided.filter(F.col("_open") & (F.col("verdict") == "approved")).groupBy("prompt_code").agg(
        F.max_by("new_content", "seq").alias("newest"), F.count(F.lit(1)).alias("times"))
    reg = registry.join(changes, registry.code == changes.prompt_code, "left").select(
        "code", F.coalesce("newest", "content").alias("content"), (F.col("version") + F.coalesce("times", F.lit(0))).alias("version"), "status")
    return reg, after
