"""Keyed folds and streams: batch forms with oracle SQL where it can be said, stream forms run to the end of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import insert_ignore
from ..operators.scan import running
from ..session import ensure_checkpoint_dir
from ..streaming import folds as fo
from ..streaming import jobs
from ..streaming.processors import fold_stream
from .inputs import BOTH
from .registry import query

# Event time is pressed together so that limits are reached: 30 days become 30 days / 400.
BOTH["v_fast"] = "select event_id as id, user_id, event_type, tokens, cast(floor(ts_ms / 400) as bigint) as ts_ms from {v_event}"


def run_to_end(fx, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over the files present and read its output back."""
    root = f"{ensure_checkpoint_dir(fx.spark)}/stream-{uuid.uuid4().hex}"
    query_ = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out")
              .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query_.awaitTermination()
    return fx.spark.read.schema(stream.schema).parquet(f"{root}/out")


def event_stream(fx) -> DataFrame:
    return fx.spark.readStream.schema(fx.events.schema).option("pathGlobFilter", "events.parquet").parquet(fx.sf_dir)


def fast_stream(fx) -> DataFrame:
    return event_stream(fx).selectExpr(
        "event_id as id", "user_id", "event_type", "cast(floor(value * 10) as bigint) + event_id % 500 as tokens",
        "cast(floor(unix_millis(cast(ts as timestamp)) / 400) as bigint) as ts_ms")


_COLUMNS = ["id", "user_id", "ts_ms"]


_STR1_RATE_LIMIT = """
    with recursive e as (select id, user_id % 10 as key, ts_ms, row_number() over (partition by user_id % 10 order by ts_ms, id) as n from {v_fast}),
    r as (select key, cast(0 as bigint) as n, cast(null as bigint) as id, cast([] as bigint[]) as stamps, true as allowed, cast(null as bigint) as ts_ms
          from (select distinct key from e)
          union all
          select e.key, e.n, e.id,
                 case when len(list_filter(r.stamps, lambda t: e.ts_ms - t <= 60000)) >= 6 then list_filter(r.stamps, lambda t: e.ts_ms - t <= 60000)
                      else list_append(list_filter(r.stamps, lambda t: e.ts_ms - t <= 60000), e.ts_ms) end,
                 len(list_filter(r.stamps, lambda t: e.ts_ms - t <= 60000)) < 6, e.ts_ms
          from r join e on e.key = r.key and e.n = r.n + 1)
    select id, key, ts_ms, allowed from r where id is not null"""


@query("str1_rate_limit", _STR1_RATE_LIMIT)
def _(fx):
    rows = fx.v_fast.selectExpr("id", "user_id % 10 as key", "ts_ms")
    return fo.replay(fo.quiet_segments(rows, ["key"], fo.WINDOW_MS), fo.rate_limit(6), ["key", "segment"]).drop("segment")


@query("str1_rate_limit_stream", _STR1_RATE_LIMIT)
def _(fx):
    """Stream form of the limiter; a long-running one adds ``ttl_ms`` (STR-2)."""
    rows = fast_stream(fx).selectExpr("id", "user_id % 10 as key", "ts_ms")
    return run_to_end(fx, fold_stream(rows, fo.rate_limit(6), ["key"]))


def _logins(df: DataFrame) -> DataFrame:
    return df.selectExpr("id", "user_id % 4 as gate", "concat('ip', user_id % 12) as ip", "concat('n', user_id % 20) as name",
                         "case event_type when 'signup' then 'success' when 'error' then 'failure' when 'purchase' then 'register' else 'failure' end as action", "ts_ms")


@query("str3_login_guard")
def _(fx):
    rows = fo.quiet_segments(_logins(fx.v_fast), ["gate"], fo.LOCK_MS)
    return fo.replay(rows, fo.login_guard(), ["gate", "segment"]).drop("segment")


@query("str3_login_guard_stream")
def _(fx):
    return run_to_end(fx, fold_stream(_logins(fast_stream(fx)), fo.login_guard(), ["gate"]))


_STR4_TOKEN_BUDGET = """
    select id, user_id, day, coalesce(sum(tokens) over (partition by user_id, day order by ts_ms, id rows between unbounded preceding and 1 preceding), 0)::bigint as used_before,
      coalesce(sum(tokens) over (partition by user_id, day order by ts_ms, id rows between unbounded preceding and 1 preceding), 0) < 1500 as allowed
    from (select *, cast(floor(ts_ms / 216000) as bigint) as day from {v_fast})"""


@query("str4_token_budget", _STR4_TOKEN_BUDGET)
def _(fx):
    """A day is one 400th of a day here, as event time is."""
    rows = fx.v_fast.withColumn("day", F.floor(F.col("ts_ms") / 216000))
    run = running(rows, ["user_id", "day"], ["ts_ms", "id"], F.floor(F.col("ts_ms") / 9000), {"used_before": ("sum", F.col("tokens"))}, inclusive=False)
    return run.select("id", "user_id", "day", "used_before", (F.col("used_before") < 1500).alias("allowed"))


@query("str4_token_budget_stream", _STR4_TOKEN_BUDGET)
def _(fx):
    rows = fast_stream(fx).withColumn("day", F.floor(F.col("ts_ms") / 216000))
    return run_to_end(fx, fold_stream(rows, fo.token_budget(1500, "day"), ["user_id"])).select("id", "user_id", "day", "used_before", "allowed")


_STR5_BREAKER = """
    with recursive e as (select id, user_id % 30 as name, ts_ms, event_type <> 'error' and event_type <> 'view' as ok,
                                row_number() over (partition by user_id % 30 order by ts_ms, id) as n from {v_fast}),
    r as (select name, cast(0 as bigint) as n, cast(null as bigint) as id, cast(null as bigint) as ts_ms, false as ok, true as allowed, 'closed' as state_before, 'closed' as state_after,
                 cast(0 as bigint) as fails, cast(0 as bigint) as at_ms from (select distinct name from e)
          union all
          select name, n, id, ts_ms, ok, state_before <> 'open' as allowed, state_before,
            case when state_before = 'open' then 'open' when ok then 'closed' when state_before = 'half_open' or fails + 1 >= 3 then 'open' else state_before end as state_after,
            case when state_before = 'open' then fails when ok then 0 else fails + 1 end as fails, case when state_before = 'open' or ok then at_ms else ts_ms end as at_ms
          from (select e.name, e.n, e.id, e.ts_ms, e.ok, r.fails, r.at_ms, case when r.state_after = 'open' and e.ts_ms - r.at_ms >= 60000 then 'half_open' else r.state_after end as state_before
                from r join e on e.name = r.name and e.n = r.n + 1))
    select id, name, ts_ms, ok, allowed, state_before, state_after from r where id is not null"""


@query("str5_breaker", _STR5_BREAKER)
def _(fx):
    rows = fx.v_fast.selectExpr("id", "user_id % 30 as name", "ts_ms", "event_type <> 'error' and event_type <> 'view' as ok")
    return fo.replay(fo.reset_segments(rows, ["name"], fo.BREAKERS["qa"][1], 216000), fo.breaker(), ["name", "segment"]).drop("segment")


@query("str5_breaker_stream", _STR5_BREAKER)
def _(fx):
    rows = fast_stream(fx).selectExpr("id", "user_id % 30 as name", "ts_ms", "event_type <> 'error' and event_type <> 'view' as ok")
    return run_to_end(fx, fold_stream(rows, fo.breaker(), ["name"]))


_STR6_TURN_TRIGGER = """
    select id, user_id, turn, turn % 5 = 0 as due from (select id, user_id, row_number() over (partition by user_id order by ts_ms, id) as turn from {v_fast})"""


@query("str6_turn_trigger", _STR6_TURN_TRIGGER)
def _(fx):
    run = running(fx.v_fast, ["user_id"], ["ts_ms", "id"], F.floor(F.col("ts_ms") / 216000), {"turn": ("count", F.lit(1))})
    return run.select("id", "user_id", "turn", (F.col("turn") % fo.TURNS == 0).alias("due"))


@query("str6_turn_trigger_stream", _STR6_TURN_TRIGGER)
def _(fx):
    return run_to_end(fx, fold_stream(fast_stream(fx).select(*_COLUMNS), fo.turn_trigger(), ["user_id"])).select("id", "user_id", "turn", "due")


_STEPS = "select event_id as id, user_id % 20 as file_id, event_type = 'purchase' as forced, cast(floor(ts_ms / 40000) as bigint) as ts_ms from {v_event}"


_STR7 = f"""
    with recursive e as (select *, row_number() over (partition by file_id order by ts_ms, id) as n from ({_STEPS})),
    r as (select file_id, cast(0 as bigint) as n, cast(null as bigint) as id, false as forced, cast(null as bigint) as ts_ms, true as kept, cast(null as bigint) as at
          from (select distinct file_id from e)
          union all
          select e.file_id, e.n, e.id, e.forced, e.ts_ms, e.forced or r.at is null or e.ts_ms - r.at >= 1000,
                 case when e.forced or r.at is null or e.ts_ms - r.at >= 1000 then e.ts_ms else r.at end
          from r join e on e.file_id = r.file_id and e.n = r.n + 1)
    select id, file_id, forced, ts_ms, kept from r where id is not null"""


@query("str7_throttle", _STR7)
def _(fx):
    rows = fo.quiet_segments(fx.sql(_STEPS), ["file_id"], fo.THROTTLE_MS)
    return fo.replay(rows, fo.throttle(), ["file_id", "segment"]).drop("segment")


@query("str7_throttle_stream", _STR7)
def _(fx):
    rows = event_stream(fx).selectExpr("event_id as id", "user_id % 20 as file_id", "event_type = 'purchase' as forced",
                                       "cast(floor(unix_millis(cast(ts as timestamp)) / 40000) as bigint) as ts_ms")
    return run_to_end(fx, fold_stream(rows, fo.throttle(), ["file_id"]))


@query("str8_ingest")
def _(fx):
    """Documents arrive as files, become chunks, and a second arrival replaces the first; files with chunks are listed."""
    root = f"{ensure_checkpoint_dir(fx.spark)}/ingest-{uuid.uuid4().hex}"
    first = fx.documents.selectExpr("doc_id as file_id", "concat(source, '.txt') as name", "concat('old ', text) as text", "1L as seen")
    second = fx.v_markdown.join(fx.documents.select("doc_id", "lang"), "doc_id").selectExpr("doc_id as file_id", "concat(lang, '.md') as name", "text", "2L as seen")
    first.write.parquet(f"{root}/in")
    jobs.start_ingest(fx.spark, f"{root}/in", f"{root}/out", f"{root}/state").awaitTermination()
    second.write.mode("append").parquet(f"{root}/in")
    jobs.start_ingest(fx.spark, f"{root}/in", f"{root}/out", f"{root}/state").awaitTermination()
    return jobs.current_chunks(fx.spark, f"{root}/out")


_QUEUE = "select l_orderkey as file_id, l_linenumber as seq, l_partkey as job from {lineitem}"


@query("str9_enqueue", f"""
    select o_orderkey as file_id, -1 as job from {{orders}} where o_orderstatus = 'F' union all
    select file_id, job from (select file_id, job, row_number() over (partition by file_id order by seq, job) as rn from ({_QUEUE}))
    where rn = 1 and file_id not in (select o_orderkey from {{orders}} where o_orderstatus = 'F')""".replace("-1 as job", "cast(-1 as bigint) as job"))
def _(fx):
    base = fx.orders.filter("o_orderstatus = 'F'").selectExpr("o_orderkey as file_id", "cast(-1 as bigint) as job")
    return insert_ignore(base, fx.sql(_QUEUE), ["file_id"], ["seq", "job"])


@query("str9_enqueue_stream", "select distinct user_id from {events}")
def _(fx):
    stream = event_stream(fx).selectExpr("user_id", "cast(ts as timestamp) as ts")
    return run_to_end(fx, jobs.enqueue_stream(stream, "user_id", delay="60 days")).select("user_id")


_LIVE = ["cast(ts as timestamp) as ts", "user_id", "cast(floor(value * 100) as bigint) as total_ms", "event_id % 9 = 0 as refused",
         "event_id % 4 = 0 as cache_hit", "event_type as route"]
# exact in DuckDB too: its epoch_ms rounds up the last half millisecond of an hour, its round may miss a half
_START_S = "cast(floor(epoch_us(ts) / 3600000000) * 3600 as bigint)"
_AVG_MS = ("sign(sum(cast(floor(value * 100) as bigint))) * ((2000 * abs(sum(cast(floor(value * 100) as bigint))) + count(value))"
           " // (2 * count(value))) / 1000.0::double")
_HOUR = f"""select s as start_s, s + 3600 as end_s, count(*) as answers, cast(count_if(event_id % 9 = 0) as bigint) as refused, cast(count_if(event_id % 4 = 0) as bigint) as cache_hits,
    {_AVG_MS} as avg_ms from (select *, {_START_S} as s from {{events}}) group by s"""


@query("str10_live_metrics", _HOUR)
def _(fx):
    return jobs.live_metrics(fx.events.selectExpr(*_LIVE))


@query("str10_live_metrics_sliding", f"""
    select s as start_s, s + 7200 as end_s, count(*) as answers, cast(count_if(event_id % 9 = 0) as bigint) as refused, cast(count_if(event_id % 4 = 0) as bigint) as cache_hits,
      {_AVG_MS} as avg_ms
    from (select *, {_START_S} as s from {{events}} union all
          select *, {_START_S} - 3600 as s from {{events}}) group by s""")
def _(fx):
    return jobs.live_metrics(fx.events.selectExpr(*_LIVE), "2 hours", "1 hour")


@query("str10_live_metrics_stream", _HOUR)
def _(fx):
    """Windows are out as soon as they change, and a later state replaces an earlier one."""
    root = f"{ensure_checkpoint_dir(fx.spark)}/live-{uuid.uuid4().hex}"
    stream = jobs.live_metrics(event_stream(fx).selectExpr(*_LIVE))
    (stream.writeStream.foreachBatch(lambda batch, batch_id: jobs.upsert_windows(batch, batch_id, f"{root}/out")).outputMode("update")
     .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination())
    return jobs.current_windows(fx.spark, f"{root}/out")


@query("str10_session_metrics", """
    with e as (select user_id, epoch_us(ts) as t, lag(epoch_us(ts)) over (partition by user_id order by ts) as p from {events}),
    s as (select *, sum(case when p is null or t - p >= 1800000000 then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) as g from e)
    select user_id, min(t) // 1000 as start_ms, (max(t) + 1800000000) // 1000 as end_ms, count(*) as answers from s group by user_id, g""")
def _(fx):
    return jobs.session_metrics(fx.events.selectExpr(*_LIVE))


def _asks(vectors: DataFrame) -> DataFrame:
    return vectors.selectExpr("vec_id as id", "label as user_id", "concat('q', label, '-', vec_id % 60) as query", "vec_id as ts_ms", "embedding")


@query("str11_semantic_cache")
def _(fx):
    """Ordered replay per user; the lookup and store rules alone are checked as tables under their own names."""
    return fo.replay(_asks(fx.embeddings), fo.semantic_cache(cap=20, min_sim=0.5), ["user_id"]).drop("embedding")


@query("str11_semantic_cache_stream")
def _(fx):
    stream = fx.spark.readStream.schema(fx.embeddings.schema).option("pathGlobFilter", "embeddings.parquet").parquet(fx.sf_dir)
    return run_to_end(fx, fold_stream(_asks(stream), fo.semantic_cache(cap=20, min_sim=0.5), ["user_id"])).drop("embedding")
