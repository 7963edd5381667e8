"""Evaluation, feedback, prompt registry and operational metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import REFUSAL_MARKERS
from ..operators import evals as ev
from ..operators import health as he
from ..operators import search as se
from ..operators import vectors as ve
from ..operators.textmatch import contains_join
from ..session import cut_lineage
from .inputs import BOTH, SPLIT
from .registry import query
from .search_queries import rounded, visible, whole_search

# ---------------------------------------------------------------- evaluation

_Q_BASE = "select concat(event_type, ' ', props) as question, min(event_id) as first_id, min(event_id) % 2 = 0 as in_regression from {events} where value < 10 group by 1"
_Q_NEW = "select concat(event_type, ' ', props) as question, event_id as first_id, value > 30 as in_regression, event_id as seq from {events} where value > 8"


@query("evl1_seed_questions", f"""
    with n as (select * from (select *, row_number() over (partition by question order by seq desc) as rn from ({_Q_NEW})) where rn = 1)
    select coalesce(b.question, n.question) as question, coalesce(b.first_id, n.first_id) as first_id, coalesce(n.in_regression, b.in_regression) as in_regression
    from ({_Q_BASE}) b full join n on n.question = b.question""")
def _(fx):
    return ev.seed_questions(fx.sql(_Q_BASE), fx.sql(_Q_NEW))


SPLIT["v_keywords"] = (
    "select item_id as query_id, slice(split(text, ' '), cast(2 + item_id % 3 as int), cast(item_id % 4 as int)) as keywords, "
    "case item_id % 4 when 0 then 'factual' when 1 then 'table' when 2 then 'cross_page' else 'refuse' end as dimension from {benchmark}",
    "select item_id as query_id, string_split(text, ' ')[2 + item_id % 3 : 1 + item_id % 3 + item_id % 4] as keywords, "
    "case item_id % 4 when 0 then 'factual' when 1 then 'table' when 2 then 'cross_page' else 'refuse' end as dimension from {benchmark}")

_ALL = "coalesce(len(k.keywords) > 0 and list_bool_and(list_transform(k.keywords, lambda w: contains(c.content, w))), false)"
_ANY = "coalesce(list_bool_or(list_transform(k.keywords, lambda w: contains(c.content, w))), false)"


@query("evl2_keyword_match", f"""
    select f.query_id, f.chunk_id, {_ALL} as all_hit, {_ANY} as any_hit from {{o_fused}} f
    join {{v_search_chunk}} c on c.chunk_id = f.chunk_id join {{v_keywords}} k on k.query_id = f.query_id""")
def _(fx):
    chunks = visible(fx)
    rows = se.fuse(fx.v_question, chunks).join(chunks.select("chunk_id", "content"), "chunk_id").join(fx.v_keywords, "query_id")
    return rows.select("query_id", "chunk_id", ev.match_all(F.col("content"), F.col("keywords")).alias("all_hit"),
                       ev.match_any(F.col("content"), F.col("keywords")).alias("any_hit"))


@query("evl2_keyword_texts", """
    select k.word, count(d.doc_id) as n_docs, min(d.doc_id) as first_doc
    from (select distinct unnest(regexp_extract_all(text, '[^ ]+')) as word from {benchmark}) k
    left join {documents} d on contains(d.text, k.word) group by k.word""")
def _(fx):
    """Every word of the golden questions, as a keyword of whatever length, against all whole texts."""
    words = fx.benchmark.select(F.explode(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).alias("word")).distinct()
    pairs = contains_join(words.select(F.col("word").alias("needle_id"), F.col("word").alias("needle")),
                          fx.documents.selectExpr("doc_id as hay_id", "text as hay"))
    counted = pairs.groupBy("needle_id").agg(F.count("*").alias("n_docs"), F.min("hay_id").alias("first_doc"))
    return words.join(counted, words.word == counted.needle_id, "left").select("word", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "first_doc")


_SCORED = f"""
    select k.query_id, k.dimension, h.hit_rank, h.hit_rank is not null as recall_hit, coalesce(1.0::double / h.hit_rank, 0) as rr,
           case when len(k.keywords) > 0 then round_even(h.rel::double / h.n, 4) end as context_precision
    from {{v_keywords}} k left join (
      select f.query_id, min(case when {_ALL} then f.rank end) as hit_rank, count_if({_ANY}) as rel, count(*) as n
      from {{o_fused}} f join {{v_search_chunk}} c on c.chunk_id = f.chunk_id join {{v_keywords}} k on k.query_id = f.query_id where f.rank <= 8 group by f.query_id) h
    on h.query_id = k.query_id"""


def _judged(fx):
    chunks = visible(fx)
    hits = se.fuse(fx.v_question, chunks).filter("rank <= 8").join(chunks.select("chunk_id", "content"), "chunk_id").select("query_id", "rank", "content")
    return ev.score_questions(hits, fx.v_keywords)


@query("evl3_score_questions", f"select query_id, hit_rank, recall_hit, round(rr, 6) as rr, context_precision from ({_SCORED})")
def _(fx):
    return rounded(_judged(fx), "rr")


@query("evl4_looks_refused", "select id, refused or " + " or ".join(f"contains(answer, '{m}')" for m in REFUSAL_MARKERS)
       + " as looks_refused from (select event_id as id, event_id % 9 = 0 as refused, case when event_type = 'error' then concat('没有相关 ', props) else props end as answer from {events})")
def _(fx):
    answers = fx.events.selectExpr("event_id as id", "event_id % 9 = 0 as refused", "case when event_type = 'error' then concat('没有相关 ', props) else props end as answer")
    return ev.with_refused(answers).select("id", "looks_refused")


BOTH["o_eval"] = """
    with s as (select run_id, dimension, context_precision as cp, faithfulness as fa, relevancy as re,
        case when dimension <> 'refuse' then case when hit_rank is not null then 1.0::double else 0.0::double end end as r,
        case when dimension <> 'refuse' then coalesce(1.0::double / hit_rank, 0) end as m,
        case when dimension = 'refuse' then case when refused then 1.0::double else 0.0::double end end as f from {v_eval_result})
    select run_id, case when grouping(dimension) = 1 then 'overall' else dimension end as dimension, count(*) as n, round_even(avg(r), 4) as context_recall,
      round_even(avg(m), 4) as mrr, round_even(avg(cp), 4) as context_precision, round_even(avg(f), 4) as refuse_accuracy,
      case when grouping(dimension) = 0 then round_even(avg(fa), 4) end as faithfulness, case when grouping(dimension) = 0 then round_even(avg(re), 4) end as relevancy
    from s group by grouping sets ((run_id, dimension), (run_id))"""


@query("evl5_aggregate", "select * from {o_eval}")
def _(fx):
    return ev.aggregate_eval(fx.v_eval_result)


@query("evl6_exclude_types", """
    select f.query_id, f.chunk_id, row_number() over (partition by f.query_id order by f.rank) as rank from {o_fused} f
    join {v_search_chunk} c on c.chunk_id = f.chunk_id where c.chunk_type not in ('table', 'image')""")
def _(fx):
    chunks = visible(fx)
    hits = se.fuse(fx.v_question, chunks).join(chunks.select("chunk_id", "chunk_type"), "chunk_id")
    return ev.exclude_types(hits, ["table", "image"]).select("query_id", "chunk_id", "rank")


@query("evl7_compare_systems", """
    with r as (select 'vector' as system, query_id, rank, chunk_id as file from {o_vec} union all select 'bm25', query_id, rank, chunk_id from {o_bm25}
               union all select 'rrf', query_id, rank, chunk_id from {o_fused} union all select 'rrf_rerank', query_id, rank, chunk_id from {o_hybrid}),
    g as (select distinct question_id as query_id, expect_doc as file, dimension as category from {v_golden}),
    a as (select distinct s.system, g.query_id, g.category from g join (select distinct system from r) s on true),
    p as (select a.*, case when exists (select 1 from r join g on g.query_id = r.query_id and g.file = r.file
                                        where r.system = a.system and r.query_id = a.query_id and r.rank <= 5) then 1 else 0 end as hit from a)
    select system, case when grouping(category) = 1 then 'overall' else category end as category, count(*) as n, cast(sum(hit) as bigint) as hits, round(avg(hit), 6) as recall
    from p group by grouping sets ((system, category), (system))""")
def _(fx):
    chunks = visible(fx)
    questions = fx.v_question.select("query_id", "question", "embedding")
    # each channel is ranked by itself and in the fusions, so its few rows are kept
    vec, bm = cut_lineage(ve.vector_topk(questions, chunks, se.CHANNEL_TOP)), cut_lineage(se.bm25_topk(questions, chunks))
    fused = cut_lineage(se.rrf(vec, bm))
    full = se.hybrid_search(questions, chunks, fused=fused)
    rankings = None
    for name, df in {"vector": vec, "bm25": bm, "rrf": fused, "rrf_rerank": full}.items():
        part = df.select(F.lit(name).alias("system"), "query_id", "rank", F.col("chunk_id").alias("file"))
        rankings = part if rankings is None else rankings.unionByName(part)
    golden = fx.v_golden.selectExpr("question_id as query_id", "expect_doc as file", "dimension as category")
    return ev.compare_systems(rankings, golden, ["vector", "bm25", "rrf", "rrf_rerank"])


def _overall(fx):
    return ev.aggregate_eval(fx.v_eval_result).filter("dimension = 'overall'")


_DELTAS = """
    with l as (select run_id, 'context_recall' as metric, context_recall as v from {o_eval} where dimension = 'overall' union all
               select run_id, 'mrr', mrr from {o_eval} where dimension = 'overall' union all select run_id, 'refuse_accuracy', refuse_accuracy from {o_eval} where dimension = 'overall')
    select a.run_id as run_a, b.run_id as run_b, a.metric, round_even(b.v - a.v, 4) as delta from l a join l b on b.metric = a.metric and b.run_id = a.run_id + 1
    where a.v is not null and b.v is not null"""


def _deltas(fx):
    runs = _overall(fx)
    pairs = fx.v_eval_result.select(F.col("run_id").alias("run_a")).distinct().withColumn("run_b", F.col("run_a") + 1)
    return ev.compare_runs(runs, pairs)


@query("evl8_compare_runs", _DELTAS)
def _(fx):
    return _deltas(fx)


@query("evl9_gate", f"""
    with f as (select *, delta < case metric when 'context_recall' then -0.005 when 'mrr' then -0.10 else -0.01 end as bad from ({_DELTAS}))
    select run_a, run_b, cast(count_if(bad) as bigint) as failures, coalesce(string_agg(metric, ',' order by metric) filter (where bad), '') as failed, count_if(bad) = 0 as passed
    from f group by run_a, run_b""")
def _(fx):
    return ev.check_gate(_deltas(fx), {"context_recall": -0.005, "refuse_accuracy": -0.01})


@query("evl10_list_runs", "select run_id, n, context_recall from {o_eval} where dimension = 'overall' order by run_id desc limit 50")
def _(fx):
    return ev.list_runs(_overall(fx)).select("run_id", "n", "context_recall")


@query("evl10_run_results", "select r.run_id, r.question_id, e.props as question, r.hit_rank from {v_eval_result} r join {events} e on e.event_id = r.question_id")
def _(fx):
    questions = fx.events.selectExpr("event_id as question_id", "props as question")
    return ev.run_results(fx.v_eval_result, questions).select("run_id", "question_id", "question", "hit_rank")


@query("evl11_ablation", """
    with m as (select 'v' || run_id as variant, context_recall, mrr, refuse_accuracy from {o_eval} where dimension = 'overall'),
    b as (select * from m where variant = 'v1')
    select m.variant, m.context_recall, m.mrr, m.refuse_accuracy, round_even(m.context_recall - b.context_recall, 4) as d_context_recall,
           round_even(m.mrr - b.mrr, 4) as d_mrr, round_even(m.refuse_accuracy - b.refuse_accuracy, 4) as d_refuse_accuracy from m join b on true""")
def _(fx):
    return ev.ablation(_overall(fx).withColumn("variant", F.concat(F.lit("v"), F.col("run_id").cast("string"))), "v1")


# ---------------------------------------------------------------- feedback

_CASE_CHUNKS = """select f.id as case_id, string_agg(c.chunk_id || ':' || substring(c.content, 1, 500), '|' order by c.chunk_id) as chunks, count(*) as n
    from {v_feedback} f join {v_qa_log} l on l.id = f.qa_log_id join {v_chunk} c on list_contains(l.chunk_ids, c.chunk_id) where f.rating < 0 group by f.id"""


@query("fbk1_bad_cases", f"""
    select f.id as case_id, f.qa_log_id, f.user_id, l.query, l.answer, l.route, coalesce(x.chunks, '') as chunks
    from {{v_feedback}} f join {{v_qa_log}} l on l.id = f.qa_log_id left join ({_CASE_CHUNKS}) x on x.case_id = f.id where f.rating < 0""")
def _(fx):
    cases = ev.bad_cases(fx.v_feedback, fx.v_qa_log, fx.v_chunk)
    return cases.select("case_id", "qa_log_id", "user_id", "query", "answer", "route", F.array_join(F.transform(
        "chunks", lambda c: F.concat_ws(":", c["id"].cast("string"), c["content"])), "|").alias("chunks"))


@query("fbk2_latest_correction", "select qa_log_id, arg_max(correction, id) as correction from {v_feedback} group by qa_log_id")
def _(fx):
    return ev.latest_correction(fx.v_feedback)


_CAUSES = f"""select f.id as case_id, f.user_id, l.query, f.correction, case when x.n is null then 'retrieval' else 'generation' end as attribution
    from {{v_feedback}} f join {{v_qa_log}} l on l.id = f.qa_log_id left join ({_CASE_CHUNKS}) x on x.case_id = f.id where f.rating < 0"""


@query("fbk3_attribute", f"select case_id, attribution from ({_CAUSES})")
def _(fx):
    return ev.attribute(ev.bad_cases(fx.v_feedback, fx.v_qa_log, fx.v_chunk)).select("case_id", "attribution")


_SET = "select concat(event_type, ' ', props) as question, min(props) as reference_answer, 'table' as dimension, false as in_regression, 'seed' as origin from {events} where value > 30 group by 1"


@query("fbk4_promote", f"""
    with c as (select f.id as case_id, l.query, k.correction from {{v_feedback}} f join {{v_qa_log}} l on l.id = f.qa_log_id
               join (select qa_log_id, arg_max(correction, id) as correction from {{v_feedback}} group by qa_log_id) k on k.qa_log_id = f.qa_log_id where f.rating < 0),
    n as (select * from (select *, row_number() over (partition by query order by case_id) as rn from c) where rn = 1)
    select coalesce(s.question, n.query) as question, coalesce(s.reference_answer, n.correction) as reference_answer, coalesce(s.dimension, 'factual') as dimension,
      n.query is not null as in_regression, coalesce(s.origin, 'bad_case:' || n.case_id) as origin from ({_SET}) s full join n on n.query = s.question""")
def _(fx):
    cases = ev.bad_cases(fx.v_feedback, fx.v_qa_log, fx.v_chunk).select("case_id", "qa_log_id", "query").join(
        ev.latest_correction(fx.v_feedback), "qa_log_id")
    return ev.promote(cases, fx.sql(_SET))


_CASES = "select event_id as id, user_id, case when event_id % 3 = 0 then 'open' else 'in_regression' end as status from {events}"


@query("fbk5_list_cases", f"select id, user_id from ({_CASES}) where status = 'open' order by id desc limit 100")
def _(fx):
    return ev.list_cases(fx.sql(_CASES), "open").select("id", "user_id")


_REG = "select concat('p', cast(n_nationkey as varchar(20))) as code, n_name as content, n_nationkey % 4 as version, case when n_nationkey % 3 = 0 then 0 else 1 end as status from {nation}"
_STD = "select concat('p', cast(s_suppkey as varchar(20))) as code, s_name as content from {supplier}"


@query("prm1_active_prompts", f"""
    select coalesce(r.code, d.code) as code, coalesce(r.content, d.content) as content, cast(coalesce(r.version, 0) as bigint) as version
    from (select * from ({_REG}) where status = 1) r full join ({_STD}) d on d.code = r.code""")
def _(fx):
    return ev.active_prompts(fx.sql(_REG.replace("varchar(20)", "string")), fx.sql(_STD.replace("varchar(20)", "string"))).withColumn(
        "version", F.col("version").cast("bigint"))


_APPROVALS = """select c_custkey as id, concat('p', cast(c_custkey % 30 as varchar(20))) as prompt_code, c_name as new_content,
    case when c_custkey % 5 = 0 then 'rejected' else 'pending' end as decision from {customer}"""
_DECISIONS = "select o_custkey as approval_id, o_orderkey as seq, case o_orderstatus when 'O' then 'approved' when 'F' then 'rejected' else 'later' end as decision from {orders}"


@query("prm1_apply_decisions", f"""
    with f as (select * from (select *, row_number() over (partition by approval_id order by seq) as rn from ({_DECISIONS})) where rn = 1),
    a as (select a.*, f.seq from ({_APPROVALS}) a join f on f.approval_id = a.id where a.decision = 'pending' and f.decision = 'approved'),
    x as (select prompt_code, arg_max(new_content, seq) as newest, count(*) as times from a group by prompt_code)
    select r.code, coalesce(x.newest, r.content) as content, cast(r.version + coalesce(x.times, 0) as bigint) as version
    from ({_REG}) r left join x on x.prompt_code = r.code""")
def _(fx):
    text = [fx.sql(t.replace("varchar(20)", "string")) for t in (_REG, _APPROVALS, _DECISIONS)]
    return ev.apply_decisions(*text)[0].select("code", "content", F.col("version").cast("bigint").alias("version"))


@query("prm1_decided_approvals", f"""
    with f as (select * from (select *, row_number() over (partition by approval_id order by seq) as rn from ({_DECISIONS})) where rn = 1)
    select a.id, a.prompt_code, case when a.decision = 'pending' and f.decision is not null
             then case when f.decision = 'approved' then 'approved' else 'rejected' end else a.decision end as decision
    from ({_APPROVALS}) a left join f on f.approval_id = a.id""")
def _(fx):
    text = [fx.sql(t.replace("varchar(20)", "string")) for t in (_REG, _APPROVALS, _DECISIONS)]
    return ev.apply_decisions(*text)[1].select("id", "prompt_code", "decision")


# ---------------------------------------------------------------- operational metrics

def _timed(fx):
    return fx.v_retrieval_log.withColumn("stage_ms", F.create_map(F.lit("rerank"), "rerank_ms", F.lit("vector"), "vector_ms"))


def _causes(fx):
    return fx.sql("select event_id as id, user_id, case when event_id % 7 < 3 then 'retrieval' else 'generation' end as attribution from {events}")


_RATE = "round_even({0}::double / greatest(count(*), 1), 4)"
_QA = (f"count(*) as qa_total, {_RATE.format('count_if(contains(answer, $$未找到$$) or contains(answer, $$无法回答$$))')} as refuse_rate, "
       f"{_RATE.format('count_if(cache_hit)')} as cache_hit_rate, cast(sum(token_in) as bigint) as tokens_in, cast(sum(token_out) as bigint) as tokens_out")
_RL = f"count(*) as searches, {_RATE.format('count_if(low_confidence)')} as low_confidence_rate, {_RATE.format('count_if(hit_count = 0)')} as empty_rate"


@query("dia1_by_route", """
    select route, count(*) as n, cast(round(avg(total_ms)) as bigint) as avg_ms, cast(sum(token_in + token_out) as bigint) as tokens from {v_qa_log} group by route""")
def _(fx):
    return he.by_route(fx.v_qa_log)


@query("dia2_qa_rates", f"select {_QA} from {{v_qa_log}}")
def _(fx):
    return he.qa_rates(fx.v_qa_log)


@query("dia3_retrieval_rates", f"select {_RL} from {{v_retrieval_log}}")
def _(fx):
    return he.retrieval_rates(fx.v_retrieval_log)


_STAGE = """select {k} stage, cast(floor(median(ms)) as bigint) as p50, list_sort(list(ms))[least(cast(floor(count(*) * 0.95::double) as bigint) + 1, count(*))] as p95
    from (select {k} 'vector' as stage, vector_ms as ms from ({src}) union all select {k} 'rerank', rerank_ms from ({src})) group by {k} stage"""


@query("dia4_stage_latency", _STAGE.format(k="", src="select * from {{v_retrieval_log}} order by id desc limit 200").replace("{{", "{").replace("}}", "}"))
def _(fx):
    return he.stage_latency(_timed(fx))


@query("dia5_feedback", "select cast(count_if(rating = 1) as bigint) as positive, cast(count_if(rating = -1) as bigint) as negative from {v_feedback}")
def _(fx):
    return he.feedback_counts(fx.v_feedback)


@query("dia5_case_causes", "select case when event_id % 7 < 3 then 'retrieval' else 'generation' end as attribution, count(*) as n from {events} group by 1")
def _(fx):
    return he.case_counts(_causes(fx))


def _user_or_all(measures: str, view: str) -> str:
    return (f"select case when grouping(user_id) = 1 then 'all' else cast(user_id as varchar) end as who, {measures} from {{{view}}} group by grouping sets ((user_id), ())")


_LAST = ("select cast(user_id as varchar) as who, vector_ms, rerank_ms from (select *, row_number() over (partition by user_id order by id desc) as rn from {{v_retrieval_log}}) where rn <= 200 "
         "union all select 'all', vector_ms, rerank_ms from (select * from {{v_retrieval_log}} order by id desc limit 200)")
_STAGES = _STAGE.format(k="who,", src=_LAST).replace("{{", "{").replace("}}", "}")


@query("dia6_health_report", f"""
    select q.who, q.qa_total, q.refuse_rate, q.cache_hit_rate, q.tokens_in, q.tokens_out, r.searches, r.low_confidence_rate, r.empty_rate, f.positive, f.negative,
      t.routes, s.stages
    from ({_user_or_all(_QA, 'v_qa_log')}) q full join ({_user_or_all(_RL, 'v_retrieval_log')}) r on r.who = q.who
    left join ({_user_or_all('cast(count_if(rating = 1) as bigint) as positive, cast(count_if(rating = -1) as bigint) as negative', 'v_feedback')}) f on f.who = q.who
    left join (select who, string_agg(route || ':' || n || ':' || avg_ms, ',' order by route) as routes from (
        select who, route, count(*) as n, cast(round(avg(total_ms)) as bigint) as avg_ms from (
          select cast(user_id as varchar) as who, route, total_ms from {{v_qa_log}} union all select 'all', route, total_ms from {{v_qa_log}}) group by who, route) group by who) t on t.who = q.who
    left join (select who, string_agg(stage || ':' || p50 || ':' || p95, ',' order by stage) as stages from ({_STAGES}) group by who) s on s.who = q.who""")
def _(fx):
    report = he.health_report(fx.v_qa_log, _timed(fx), fx.v_feedback, _causes(fx))
    return report.select("who", "qa_total", "refuse_rate", "cache_hit_rate", "tokens_in", "tokens_out", "searches", "low_confidence_rate", "empty_rate",
                         "positive", "negative",
                         F.array_join(F.transform("by_route", lambda x: F.concat_ws(":", x["route"], x["n"].cast("string"), x["avg_ms"].cast("string"))), ",").alias("routes"),
                         F.array_join(F.transform("stages", lambda x: F.concat_ws(":", x["stage"], x["p50"].cast("string"), x["p95"].cast("string"))), ",").alias("stages"))


@query("dia6_report_history", "select event_id as id, props as summary from {events} order by id desc limit 100")
def _(fx):
    return he.report_history(fx.events.selectExpr("event_id as id", "props as summary"), 500)


@query("dia6_latest_report", "select event_id as id, props as summary from {events} order by id desc limit 1")
def _(fx):
    return he.latest_report(fx.events.selectExpr("event_id as id", "props as summary"))


_REQUESTS = "select event_type as type, value * 13.7 as ms, case when event_id % 17 = 0 then 500 else 200 end as code from {events}"


def _pick(share: str) -> str:
    return f"round_even(list_sort(list(ms) filter (where ok))[cast(least(count_if(ok) - 1, floor(count_if(ok) * {share}::double)) + 1 as bigint)], 1)"


@query("dia7_load_summary", f"""
    select kind, count(*) as requests, cast(count(*) - count_if(ok) as bigint) as errors, round_even((count(*) - count_if(ok))::double / count(*), 4) as error_rate,
      round_even(count_if(ok) / 120.0::double, 2) as per_second, {_pick('0.5')} as p50_ms, {_pick('0.95')} as p95_ms, {_pick('0.99')} as p99_ms, round_even(max(ms) filter (where ok), 1) as max_ms
    from (select type as kind, ms, code between 200 and 299 as ok from ({_REQUESTS.replace('13.7', '13.7::double')}) union all
          select 'all', ms, code between 200 and 299 from ({_REQUESTS.replace('13.7', '13.7::double')})) group by kind""")
def _(fx):
    return he.load_summary(fx.sql(_REQUESTS.replace("13.7", "13.7D")), 120.0)


@query("dia8_search_summary", """
    with f as (select q.query_id, h.reranked, h.rerank_skipped from {v_question} q left join {o_cascade} h on h.query_id = q.query_id and h.rank = 1)
    select count(*) as searches, cast(count_if(reranked is not null and not coalesce(rerank_skipped, false) and not reranked) as bigint) as downgraded, cast(count_if(coalesce(rerank_skipped, false)) as bigint) as skipped,
      cast(count_if(reranked is null) as bigint) as empty, round_even(count_if(reranked is not null and not coalesce(rerank_skipped, false) and not reranked)::double / count(*), 4) as downgraded_share,
      round_even(count_if(coalesce(rerank_skipped, false))::double / count(*), 4) as skipped_share from f""")
def _(fx):
    first = whole_search(fx, cascade=True).filter("rank = 1").select("query_id", "reranked", "rerank_skipped")
    return he.search_summary(fx.v_question.select("query_id").join(first, "query_id", "left"))


@query("dia9_slow_requests", "select id, user_id, total_ms as elapsed_ms from {v_qa_log} where total_ms > 5000")
def _(fx):
    return he.slow_requests(fx.v_qa_log.withColumnRenamed("total_ms", "elapsed_ms")).select("id", "user_id", "elapsed_ms")


@query("dia10_token_usage", """
    select user_id, day, used, greatest(0, 2000 - used) as remaining, round_even(used / 2000.0::double, 4) as ratio, used >= 1600 as warn, used >= 2000 as refused
    from (select user_id, day, cast(sum(token_in + token_out) as bigint) as used from {v_qa_log} group by user_id, day)""")
def _(fx):
    return he.token_usage(fx.v_qa_log, 2000)
