"""Task, job and issue ledgers as batch transforms of their state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import latest_per_key

# ---- Fixed values ------------------------------------------------------------
MAX_ATTEMPTS = 3
STALE_SECONDS = 300
BACKOFF_BASE, BACKOFF_MAX = 5, 60
ERROR_CHARS = 2000
# event -> (states it may start from, or None for any; resulting state)
ISSUE_MOVES: dict[str, tuple[list[str] | None, str]] = {
    "retry": (["pending"], "retrying"),
    "resolve": (["retrying", "pending"], "resolved"),
    "skip": (["pending", "failed"], "skipped"),
    "cancel": (["pending", "failed"], "cancelled"),
    "fail": (None, "failed"),
}
# ------------------------------------------------------------------------------


def eligible(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """TSK-1: waiting tasks with attempts left, oldest first."""
    return (tasks.filter((F.col("status") == "pending") & (F.col("attempt") < MAX_ATTEMPTS))
            .join(files.select(F.col("id").alias("file_id"), "blob_id", "user_id"), "file_id")
            .orderBy("updated_s", "file_id"))


def recover_stale(tasks: DataFrame, now_s: int) -> DataFrame:
    """TSK-2: a parse that has not reported for five minutes goes back to the queue."""
    stale = (F.col("status") == "parsing") & (F.col("updated_s") < now_s - STALE_SECONDS)
    return tasks.withColumns({
        "status": F.when(stale, "pending").otherwise(F.col("status")),
        "updated_s": F.when(stale, F.lit(now_s).cast("bigint")).otherwise(F.col("updated_s"))})


def finish(tasks: DataFrame, results: DataFrame, now_s: int) -> DataFrame:
    """TSK-3: outcome of a parse; only a failure uses up an attempt."""
    r = results.select("file_id", F.col("status").alias("r_status"), "error", "node_count", "chunk_count")
    done = F.col("r_status").isNotNull()
    return tasks.join(r, "file_id", "left").select(
        "file_id", F.coalesce("r_status", "status").alias("status"),
        F.when(F.col("r_status") == "failed", F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
        "error", "node_count", "chunk_count",
        F.when(done, 1.0).otherwise(0.0).alias("progress"),
        F.when(done, F.lit(now_s).cast("bigint")).otherwise(F.col("updated_s")).alias("updated_s"))


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(BACKOFF_BASE) * F.pow(F.lit(2.0), attempt - 1), F.lit(BACKOFF_MAX)).cast("bigint")


def retry_policy(jobs: DataFrame, failures: DataFrame, now_s: int) -> DataFrame:
    """TSK-4: after a failure a job waits for its back-off, or is dead when attempts are used up."""
    attempt = F.col("attempt") + 1
    dead = attempt >= F.col("max_attempts")
    return jobs.join(failures, "id").select(
        "id", attempt.alias("attempt"), F.when(dead, "dead").otherwise("queued").alias("status"),
        F.when(~dead, now_s + backoff_seconds(attempt)).alias("lease_s"),
        F.substring("error", 1, ERROR_CHARS).alias("error"))


def reset_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """TSK-5: manual retry of failed or dead jobs; others are left as they are."""
    hit = F.col("_asked") & F.col("status").isin("failed", "dead")
    marked = jobs.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left").withColumn(
        "_hit", F.coalesce(hit, F.lit(False)))
    return marked.select(
        "id", F.when(F.col("_hit"), "queued").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("attempt")).alias("attempt"),
        F.when(~F.col("_hit"), F.col("lease_s")).alias("lease_s"))


def reset_parses(tasks: DataFrame) -> DataFrame:
    """TSK-5: tasks that may be parsed again (failed or partial), back to the start."""
    return tasks.filter(F.col("status").isin("failed", "partial")).select(
        "file_id", F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("attempt"))


def bury(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """TSK-5: dead-letter without using attempts."""
    return jobs.join(ids.select("id").distinct(), "id", "left_semi").select(
        "id", F.lit("dead").alias("status"), "attempt", F.lit(None).cast("bigint").alias("lease_s"))


def runnable(jobs: DataFrame, now_s: int) -> DataFrame:
    """TSK-6: queued with back-off over, or running with an expired lease."""
    over = F.col("lease_s") < now_s
    return jobs.filter(((F.col("status") == "queued") & (F.col("lease_s").isNull() | over))
                       | ((F.col("status") == "running") & over))


def append_steps(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """TSK-7: stage records appended to the series of a job, in order.

    The series of one job is one value of its row, as in the ledger.
    """
    new = steps.groupBy("id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("step_no", "stage", "progress"))),
        lambda s: F.struct(s["stage"].alias("stage"), s["progress"].alias("progress"))).alias("_new"))
    empty = F.expr("cast(array() as array<struct<stage:string,progress:double>>)")
    return jobs.join(new, "id", "left").withColumn(
        "series", F.concat(F.coalesce("series", empty), F.coalesce("_new", empty))).drop("_new")


def sync_issues(issues: DataFrame, placeholders: DataFrame, parsed: DataFrame) -> DataFrame:
    """ISS-1: issue rows after a parse.

    A parsed file without placeholders resolves its open issues. Otherwise known
    issues stay, retrying ones become pending again, and new placeholders are added.
    """
    keys = ["file_id", "page_no", "block_order", "block_type"]
    still = placeholders.select("file_id").distinct().withColumn("_bad", F.lit(True))
    state = (issues.join(parsed.select("file_id").distinct().withColumn("_parsed", F.lit(True)), "file_id", "left")
             .join(still, "file_id", "left"))
    opened = F.col("status").isin("pending", "retrying")
    status = (F.when(F.col("_parsed") & F.col("_bad").isNull() & opened, "resolved")
              .when(F.col("_parsed") & F.col("_bad") & (F.col("status") == "retrying"), "pending")
              .otherwise(F.col("status")))
    kept = state.select(*keys, status.alias("status"))
    fresh = latest_per_key(placeholders.select(*keys, "reason"), keys, ["reason"], first=True)
    added = fresh.join(issues.select(*keys), keys, "left_anti").select(*keys, F.lit("pending").alias("status"))
    return kept.unionByName(added)


def apply_issue_events(issues: DataFrame, events: DataFrame, block_size: int = 4096) -> DataFrame:
    """ISS-2: guarded transitions replayed in order of ``seq``.

    Every event maps the five start states to a result, and such maps compose.
    Blocks of events are composed first, then the few block maps of an issue, so
    one busy issue does not need one task for all its events.
    """
    states = sorted({"pending", "retrying", "resolved", "failed", "skipped", "cancelled"})

    def step(state: Column, event: Column) -> Column:
        out = state
        for name, (sources, target) in ISSUE_MOVES.items():
            allowed = F.lit(True) if sources is None else state.isin(sources)
            out = F.when((event == name) & allowed, F.lit(target)).otherwise(out)
        return out

    known = F.array(*[F.lit(s) for s in states])
    blocks = (events.withColumn("blk", F.floor(F.col("seq") / block_size)).groupBy("issue_id", "blk")
              .agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("ev"))
              .select("issue_id", "blk", F.transform(known, lambda s: F.aggregate(
                  "ev", s, lambda acc, e: step(acc, e["event"]))).alias("after")))
    maps = blocks.groupBy("issue_id").agg(F.array_sort(F.collect_list(F.struct("blk", "after"))).alias("maps"))
    position = F.array_position(known, F.col("status")).cast("int")
    final = F.aggregate(
        "maps", position, lambda acc, m: F.array_position(
            known, F.element_at(m["after"], acc)).cast("int"))
    return issues.join(maps, issues.id == maps.issue_id, "left").select(
        "id", "file_id", F.when(F.col("maps").isNull(), F.col("status"))
        .otherwise(F.element_at(known, final)).alias("status"))


def list_issues(issues: DataFrame) -> DataFrame:
    """ISS-3: issues in page and block order with the box parsed."""
    return issues.withColumn("box", F.from_json("bbox", "array<double>")).orderBy("file_id", "page_no", "block_order")
