"""Operational metrics of the answer and search logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fn
from .scan import running, top_per_group

# ---- Fixed values ------------------------------------------------------------
STAGE_ROWS = 200
SLOW_MS = 5000
DAILY_TOKENS, WARN_SHARE = 200000, 0.8
# ------------------------------------------------------------------------------

ALL = "all"


def _rate(part: Column, total: Column) -> Column:
    return F.bround(part / F.greatest(total, F.lit(1)), 4)


def by_route(log: DataFrame, *keys: str) -> DataFrame:
    """DIA-1: answers, mean time (rounded) and tokens per route."""
    return log.groupBy(*keys, "route").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("total_ms")).cast("bigint").alias("avg_ms"),
        F.sum(F.col("token_in") + F.col("token_out")).alias("tokens"))


def _qa_measures() -> list[Column]:
    total = F.count(F.lit(1))
    return [total.alias("qa_total"), _rate(F.count_if(fn("log_refused", t="answer")), total).alias("refuse_rate"),
            _rate(F.count_if("cache_hit"), total).alias("cache_hit_rate"),
            F.sum("token_in").alias("tokens_in"), F.sum("token_out").alias("tokens_out")]


def qa_rates(log: DataFrame) -> DataFrame:
    """DIA-2: refusals by wording, cache hits and tokens."""
    return log.agg(*_qa_measures())


def _retrieval_measures() -> list[Column]:
    total = F.count(F.lit(1))
    return [total.alias("searches"), _rate(F.count_if("low_confidence"), total).alias("low_confidence_rate"),
            _rate(F.count_if(F.col("hit_count") == 0), total).alias("empty_rate")]


def retrieval_rates(rlog: DataFrame) -> DataFrame:
    """DIA-3: weak and empty searches."""
    return rlog.agg(*_retrieval_measures())


def _stage_quantiles(rows: DataFrame, *keys: str) -> DataFrame:
    """Median and upper value of at most 200 rows per key and stage."""
    flat = rows.select(*keys, F.explode("stage_ms").alias("stage", "ms"))
    packed = flat.groupBy(*keys, "stage").agg(F.array_sort(F.collect_list("ms")).alias("v"), F.median("ms").alias("mid"))
    return packed.select(*keys, "stage", F.col("mid").cast("bigint").alias("p50"),
                         F.element_at("v", F.least(F.floor(F.size("v") * 0.95) + 1, F.size("v")).cast("int")).cast("bigint").alias("p95"))


def stage_latency(rlog: DataFrame, rows: int = STAGE_ROWS) -> DataFrame:
    """DIA-4: time per stage over the last logged searches."""
    return _stage_quantiles(rlog.filter("stage_ms is not null").orderBy(F.desc("id")).limit(rows))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """DIA-5: ratings."""
    return feedback.agg(F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"))


def case_counts(cases: DataFrame) -> DataFrame:
    """DIA-5: causes of bad cases."""
    return cases.groupBy("attribution").agg(F.count(F.lit(1)).alias("n"))


def health_report(log: DataFrame, rlog: DataFrame, feedback: DataFrame, cases: DataFrame) -> DataFrame:
    """DIA-6: one report row for every user and one for all, each metric in a single pass.

    Each log is aggregated by (user) and () with grouping sets; stage times use
    the last 200 searches of a user, or of all.
    """
    def both(df: DataFrame, *measures: Column) -> DataFrame:
        rows = df.groupingSets([["user_id"], []], "user_id").agg(F.grouping("user_id").alias("_g"), *measures)
        return rows.withColumn("who", F.when(F.col("_g") == 1, ALL).otherwise(F.col("user_id").cast("string"))).drop("user_id", "_g")

    def listed(df: DataFrame, name: str, column: str, *fields: str) -> DataFrame:
        item = F.struct(column, *fields)
        return df.groupBy("who").agg(F.array_sort(F.collect_list(item)).alias(name))

    def tagged(df: DataFrame) -> DataFrame:
        return df.withColumn("who", F.explode(F.array(F.lit(ALL), F.col("user_id").cast("string"))))

    qa = both(log, *_qa_measures())
    ret = both(rlog, *_retrieval_measures())
    fb = both(feedback, F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"))
    routes = listed(by_route(tagged(log), "who"), "by_route", "route", "n", "avg_ms", "tokens")
    causes = listed(tagged(cases).groupBy("who", "attribution").agg(F.count(F.lit(1)).alias("n")), "causes", "attribution", "n")
    timed = rlog.filter("stage_ms is not null")
    last = (top_per_group(timed, ["user_id"], [F.desc("id")], STAGE_ROWS).withColumn("who", F.col("user_id").cast("string")).select("who", "stage_ms")
            .unionByName(timed.orderBy(F.desc("id")).limit(STAGE_ROWS).select(F.lit(ALL).alias("who"), "stage_ms")))
    stages = listed(_stage_quantiles(last, "who"), "stages", "stage", "p50", "p95")
    out = qa.join(ret, "who", "full")
    for part in (fb, routes, causes, stages):
        out = out.join(part, "who", "left")
    return out.withColumn("report", F.to_json(F.struct(*[c for c in out.columns if c != "who"])))


def latest_report(reports: DataFrame) -> DataFrame:
    """DIA-6: newest stored report."""
    return reports.orderBy(F.desc("id")).limit(1)


def report_history(reports: DataFrame, limit: int = 20) -> DataFrame:
    """DIA-6: newest reports; the number is clamped to 1..100."""
    return reports.orderBy(F.desc("id")).limit(max(1, min(int(limit), 100)))


def exact_ranks(values: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float) -> DataFrame:
    """Element ``min(n - 1, int(n * share))`` of each sorted group, without sorting a group on one task.

    Equal values are counted first, the counts are summed along the values in
    blocks of ``width``, and the value where the sum passes the index is taken.
    """
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.max(value).alias("max_ms"))
    summed = running(counts, keys, [value], F.floor(F.col(value) / width), {"_cum": ("sum", F.col("_n"))})
    joined = summed.join(total, keys)
    picks = [F.min(F.when(F.col("_cum") > F.least(F.col("_total") - 1, F.floor(F.col("_total") * share)), F.col(value))).alias(name)
             for name, share in shares.items()]
    return joined.groupBy(*keys).agg(*picks, F.first("max_ms").alias("max_ms"))


def load_summary(requests: DataFrame, seconds: float, width: float = 50.0) -> DataFrame:
    """DIA-7: requests, errors, rate and exact latency ranks per type and over all.

    ``requests(type, ms, code)``; latencies are those of successful requests.
    """
    tagged = requests.withColumn("kind", F.explode(F.array(F.lit(ALL), F.col("type"))))
    ok = F.col("code").between(200, 299)
    counts = tagged.groupBy("kind").agg(F.count(F.lit(1)).alias("requests"), F.count_if(ok).alias("ok"))
    ranks = exact_ranks(tagged.filter(ok), ["kind"], "ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, width)
    return counts.join(ranks, "kind", "left").select(
        "kind", "requests", (F.col("requests") - F.col("ok")).alias("errors"),
        F.bround((F.col("requests") - F.col("ok")) / F.col("requests"), 4).alias("error_rate"),
        F.bround(F.col("ok") / F.lit(seconds), 2).alias("per_second"),
        *[F.bround(c, 1).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms", "max_ms")])


def search_summary(firsts: DataFrame) -> DataFrame:
    """DIA-8: share of searches not re-ranked, skipped by agreement, or empty.

    ``firsts(query_id, reranked, rerank_skipped)`` is the first hit per search, null when there is none.
    """
    total = F.count(F.lit(1))
    skipped = F.coalesce("rerank_skipped", F.lit(False))
    weak = F.col("reranked").isNotNull() & ~skipped & ~F.coalesce("reranked", F.lit(False))
    return firsts.agg(total.alias("searches"), F.count_if(weak).alias("downgraded"), F.count_if(skipped).alias("skipped"),
                      F.count_if(F.col("reranked").isNull()).alias("empty"), _rate(F.count_if(weak), total).alias("downgraded_share"),
                      _rate(F.count_if(skipped), total).alias("skipped_share"))


def slow_requests(audit: DataFrame, limit_ms: int = SLOW_MS) -> DataFrame:
    """DIA-9: requests over five seconds, slowest first."""
    return audit.filter(F.col("elapsed_ms") > limit_ms).orderBy(F.desc("elapsed_ms"), "id")


def token_usage(log: DataFrame, limit: int = DAILY_TOKENS) -> DataFrame:
    """DIA-10: tokens per user and day against the daily limit."""
    used = log.groupBy("user_id", "day").agg(F.sum(F.col("token_in") + F.col("token_out")).alias("used"))
    return used.select("user_id", "day", "used", F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"),
                       F.bround(F.col("used") / F.lit(limit), 4).alias("ratio"),
                       (F.col("used") >= limit * WARN_SHARE).alias("warn"), (F.col("used") >= limit).alias("refused"))
