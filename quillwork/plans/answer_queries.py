"""Answer preparation, answer cache, semantic cache and memory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import FULL_WIDTH, HALF_WIDTH, ROUTE_KEYWORDS, fn
from ..operators import answers as an
from ..operators import cache as ca
from .doc_queries import duck_strip
from .inputs import BASE_S, BOTH, NOW_S, SPLIT
from .registry import query
from .search_queries import _vec, rounded, visible, whole_search


def duck_tokens(x: str) -> str:
    other = f"length(regexp_replace({x}, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))"
    return f"((12 * (length({x}) - {other}) + 5 * {other}) // 20)"


_MIXED = "select doc_id, concat(text, case when doc_id % 3 = 0 then repeat('知识库', cast(doc_id % 40 as int)) else '' end) as text from {documents}"


@query("ans1_est_tokens", f"select doc_id, {duck_tokens('text')} as tokens from ({_MIXED})")
def _(fx):
    return fx.sql(_MIXED).select("doc_id", fn("est_tokens", t="text").alias("tokens"))


_PIECE = ("'[来源: ' || filename || case when coalesce(page_no, 0) <> 0 then ' 第' || page_no || '页' else '' end || ']' || "
          "case when coalesce(heading_path, '') <> '' then '（' || heading_path || '）' else '' end || chr(10) || content")


@query("ans2_pack_context", f"""
    with p as (select h.query_id, h.rank, {_PIECE} as piece from {{o_hybrid}} h join {{v_search_chunk}} c on c.chunk_id = h.chunk_id),
    t as (select *, {duck_tokens('piece')} as t from p),
    s as (select *, row_number() over (partition by query_id order by rank) as n, sum(t) over (partition by query_id order by rank) as cum from t)
    select query_id, string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context, cast(sum(t) as bigint) as context_tokens
    from s where n = 1 or cum <= 1500 group by query_id""")
def _(fx):
    chunks = visible(fx).select("chunk_id", "filename", "page_no", "heading_path", "content")
    hits = whole_search(fx).select("query_id", "rank", "chunk_id").join(chunks, "chunk_id")
    return an.pack_context(hits, 1500)


_HIST_PIECE = "'问：' || substring(query, 1, 200) || chr(10) || '答：' || substring(answer, 1, 300)"


@query("ans3_pack_history", f"""
    with l as (select * from (select *, row_number() over (partition by session_id order by id desc) as back from {{v_qa_log}}) where back <= 6),
    t as (select session_id, id, {_HIST_PIECE} as piece, {duck_tokens('(' + _HIST_PIECE + ')')} as t from l),
    s as (select *, row_number() over (partition by session_id order by id) as n, sum(t) over (partition by session_id order by id) as cum from t)
    select session_id, string_agg(piece, chr(10) || chr(10) order by id) as history, cast(sum(t) as bigint) as history_tokens
    from s where n = 1 or cum <= 200 group by session_id""")
def _(fx):
    return an.pack_history(fx.v_qa_log, "session_id", "id", 200)


_QUERIES = """select doc_id, concat(case doc_id % 4 when 0 then '　 ' else '' end, text, case doc_id % 5 when 0 then '？！' when 1 then '...'
    when 2 then '（x） “q”。' when 3 then ' ,　y' else '' end) as query from {documents}"""
_NORMAL = ("regexp_replace(trim(regexp_replace(translate(query, '" + FULL_WIDTH + "', '" + HALF_WIDTH.replace("'", "''") + "'), '\\s+', ' ', 'g')), '[。！？?!.]+$', '')")


@query("ans4_query_key", f"select doc_id, {_NORMAL} as normal, md5({_NORMAL}) as query_hash from ({_QUERIES})")
def _(fx):
    return an.with_query_key(fx.sql(_QUERIES)).select("doc_id", "normal", "query_hash")


# whole texts, and short questions as further rows
_ROUTED = """
    select doc_id, concat(text, case doc_id % 7 when 0 then '对比' when 1 then '哪些文档' else '' end) as query from {documents}
    union all select -1 - doc_id as doc_id, concat(source, ' ', lang, case doc_id % 7 when 0 then '对比' when 1 then '哪些文档' else '' end) as query from {documents}"""


@query("ans5_route", "select doc_id, length(query) >= 40 or " + " or ".join(f"contains(query, '{w}')" for w in ROUTE_KEYWORDS)
       + f" as complex from ({_ROUTED})")
def _(fx):
    return an.with_route(fx.sql(_ROUTED)).select("doc_id", "complex")


@query("ans6_citations", """
    select h.query_id, string_agg(h.rank || '|' || c.filename || '|' || (c.page_no + 1) || '|' || printf('%.3f', round_even(h.score, 3)), ';' order by h.rank) as citations
    from {o_hybrid} h join {v_search_chunk} c on c.chunk_id = h.chunk_id group by h.query_id""")
def _(fx):
    hits = whole_search(fx).join(visible(fx).select("chunk_id", "filename", "page_no"), "chunk_id")
    return an.citations(hits).select("query_id", F.array_join(F.transform("citations", lambda c: F.concat_ws(
        "|", c["index"].cast("string"), c["doc_name"], c["page_no"].cast("string"), F.format_string("%.3f", c["score"]))), ";").alias("citations"))


_RUNS = """select event_id as run_id, case event_type when 'view' then 'direct' when 'click' then 'standard' when 'error' then 'out_of_scope'
    when 'signup' then 'complex' else 'tool_use' end as route, case when event_id % 3 = 0 then null else event_id % 3 = 1 end as sufficient, event_id % 5 as rounds from {events}"""


@query("ans7_final_route", f"""
    with r as (select *, route in ('simple', 'standard', 'complex') as s, not coalesce(sufficient, true) and rounds > 2 as g from ({_RUNS})),
    o as (select *, case when route = 'out_of_scope' then 'guard' when s and g then 'no_answer' else route end as final_route from r)
    select run_id, final_route, final_route in ('guard', 'no_answer') as refused,
      case when not s then 'end' when coalesce(sufficient, true) then 'generate' when g then 'no_answer' else 'rewrite' end as next_step from o""")
def _(fx):
    return an.final_route(fx.sql(_RUNS))


@query("ans8_prompt", """
    with h as (select query_id, string_agg(content, chr(10) order by rank) as context from (
                 select h.query_id, h.rank, c.content from {o_fused} h join {v_search_chunk} c on c.chunk_id = h.chunk_id where h.rank <= 5) group by query_id)
    select q.query_id, replace(replace('{question} -> {prior} {other}', '{question}', q.question), '{prior}', cast(q.org_id as varchar)) as filled,
      concat_ws(chr(10) || chr(10),
        case when q.org_id > 2 then '【长期记忆】' || chr(10) || 'focus: ' || q.org_id || chr(10) || '（长期记忆仅供了解用户背景，回答仍须依据【资料】）' end,
        case when q.top_k > 9 then '【历史回答参考】' || chr(10) || '问：' || q.question || chr(10) || '答：' || substring(repeat(q.question, 3), 1, 400) || chr(10) || '（历史回答参考，可能不完全相关，请以【资料】为准）' end,
        case when q.query_id % 2 = 0 then '【历史对话】' || chr(10) || 'h' || q.query_id || chr(10) || '（历史对话仅供理解上下文，回答仍须依据【资料】）' end,
        '【资料】' || chr(10) || coalesce(h.context, ''), '【问题】' || chr(10) || q.question) as prompt
    from {v_question} q left join h on h.query_id = q.query_id""")
def _(fx):
    hits = whole_search(fx, use_rerank=False).join(visible(fx).select("chunk_id", "content"), "chunk_id")
    context = hits.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("context"))
    rows = fx.v_question.join(context, "query_id", "left").selectExpr(
        "query_id", "org_id", "question as query", "context", "case when org_id > 2 then concat('focus: ', org_id) end as memory",
        "case when top_k > 9 then question end as ref_query", "repeat(question, 3) as ref_answer",
        "case when query_id % 2 = 0 then concat('h', query_id) else '' end as history")
    return an.prompt_sections(rows).select(
        "query_id", an.fill(F.lit("{question} -> {prior} {other}"), question=F.col("query"), prior=F.col("org_id")).alias("filled"), "prompt")


# ---------------------------------------------------------------- answer cache

BOTH["v_ask"] = """select conv_id * 100 + pair_no as ask_id, case when conv_id % 3 = 0 then conv_id % 23 else (conv_id * 7) % 23 end as user_id,
    md5(query) as query_hash, query from {v_qa_pair}"""
# cached answers cite one or two files of a content group so that askers may hold copies of them
SPLIT["v_cache_blob"] = (
    "select c.id, c.user_id, c.query_hash, c.query, c.answer, case when c.id % 8 = 0 then cast(array() as array<bigint>) when c.id % 8 = 1 then array(999999999L, c.conv_id) "
    "when c.id % 2 = 0 then array(c.conv_id) else array(c.conv_id, c.conv_id + 1) end as file_ids, c.hit_count, c.updated_s, c.invalidated, c.conv_id from {v_cache} c",
    "select c.id, c.user_id, c.query_hash, c.query, c.answer, case when c.id % 8 = 0 then cast([] as bigint[]) when c.id % 8 = 1 then [999999999, c.conv_id] "
    "when c.id % 2 = 0 then [c.conv_id] else [c.conv_id, c.conv_id + 1] end as file_ids, c.hit_count, c.updated_s, c.invalidated, c.conv_id from {v_cache} c")
# every file is held by its owner and, as the same blob, by some other users
BOTH["v_holding"] = f"""
    select id, user_id, blob_id, status from {{v_user_file}} where user_id is not null
    union all select id + 1000000, (id * 7) % 23, case when id % 50 = 7 then null else blob_id end, 1 from {{v_user_file}} where file_size > 300
    union all select id + 2000000, (id * 7 + 7) % 23, blob_id, status from {{v_user_file}}"""


@query("cch1_cache_exact", """
    select a.ask_id, c.id as cache_id, c.answer from {v_ask} a join {v_cache} c on c.user_id = a.user_id and c.query_hash = a.query_hash and not c.invalidated""")
def _(fx):
    return ca.cache_exact(fx.v_ask, fx.v_cache)


_SHARED = """
    with held as (select distinct user_id, blob_id from {v_holding} where status = 1),
    pairs as (select a.ask_id, a.user_id, a.query_hash, c.id, c.hit_count, c.updated_s, c.file_ids from {v_ask} a
              join {v_cache_blob} c on c.query_hash = a.query_hash and c.user_id <> a.user_id and not c.invalidated),
    cited as (select ask_id, user_id, id, unnest(file_ids) as file_id from pairs),
    bad as (%s),
    ok as (select p.*, row_number() over (partition by ask_id order by hit_count desc, updated_s desc, id) as rn from pairs p
           where (ask_id, id) not in (select (ask_id, id) from bad) %s)
    select ask_id, user_id, query_hash, id as cache_id from ok where rn = 1"""


@query("cch2_cache_shared", _SHARED % (
    """select c.ask_id, c.id from cited c left join {v_holding} f on f.id = c.file_id
       where f.blob_id is null or not exists (select 1 from held h where h.user_id = c.user_id and h.blob_id = f.blob_id)""", "and len(file_ids) > 0"))
def _(fx):
    return ca.cache_shared(fx.v_ask, fx.v_cache_blob, fx.v_holding)


@query("cch2_cache_shared_compat", _SHARED % (
    """select c.ask_id, c.id from cited c join {v_holding} f on f.id = c.file_id
       where not exists (select 1 from held h where h.user_id = c.user_id and h.blob_id is null)
         and (case when f.blob_id is null then not exists (select 1 from held h where h.user_id = c.user_id)
                   else not exists (select 1 from held h where h.user_id = c.user_id and h.blob_id = f.blob_id) end)""", ""))
def _(fx):
    return ca.cache_shared(fx.v_ask, fx.v_cache_blob, fx.v_holding, compat=True)


@query("cch3_map_shared_files", """
    with s as (select a.ask_id, a.user_id, unnest(c.file_ids) as file_id from {v_ask} a join {v_cache_blob} c on c.query_hash = a.query_hash and c.user_id <> a.user_id)
    select ask_id, string_agg(cast(own as varchar), ',' order by own) as file_ids from (
      select distinct s.ask_id, b.id as own from s join {v_holding} f on f.id = s.file_id and f.status = 1
      join {v_holding} b on b.blob_id = f.blob_id and b.user_id = s.user_id and b.status = 1) group by ask_id""")
def _(fx):
    asks = fx.v_ask.alias("a").join(fx.v_cache_blob.alias("c"), F.expr("a.query_hash = c.query_hash and a.user_id <> c.user_id"))
    return ca.map_shared_files(asks.selectExpr("a.ask_id", "a.user_id", "c.file_ids"), fx.v_holding).select(
        "ask_id", F.array_join("file_ids", ",").alias("file_ids"))


BOTH["v_ask_vec"] = "select vec_id as ask_id, (vec_id * 5) % 23 as user_id, embedding from {v_vec}"
# stored vectors: the mean of two neighbours, so that some questions come close
SPLIT["v_near_vec"] = (
    "select a.vec_id, zip_with(a.embedding, b.embedding, (x, y) -> x + 0.3F * y) as embedding from {embeddings} a join {embeddings} b on b.vec_id = a.vec_id + 1",
    "select a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1] + 0.3::float * p[2]) as embedding from {embeddings} a join {embeddings} b on b.vec_id = a.vec_id + 1")
BOTH["v_cache_near"] = """select v.vec_id as id, case when v.vec_id % 2 = 0 then (v.vec_id * 5) % 23 else v.vec_id % 23 end as user_id, c.file_ids, v.embedding, v.vec_id % 13 = 0 as invalidated
    from {v_near_vec} v join (select conv_id, min(file_ids) as file_ids from {v_cache_blob} group by conv_id) c on c.conv_id = v.vec_id % 200"""


@query("cch4_cache_semantic", """
    with q as (select ask_id, user_id, cast(embedding as double[]) as e from {v_ask_vec}),
    c as (select id, user_id, file_ids, cast(embedding as double[]) as e from {v_cache_near} where not invalidated),
    held as (select distinct user_id, blob_id from {v_holding} where status = 1),
    p as (select q.ask_id, q.user_id, c.id, c.user_id as owner, c.file_ids,
                 round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 9) as sim from q join c on true),
    near as (select * from p where sim > 0.9),
    cited as (select ask_id, user_id, id, unnest(file_ids) as file_id from near),
    bad as (select c.ask_id, c.id from cited c left join {v_holding} f on f.id = c.file_id
            where f.blob_id is null or not exists (select 1 from held h where h.user_id = c.user_id and h.blob_id = f.blob_id)),
    ok as (select *, owner <> user_id as shared from near where owner = user_id or (len(file_ids) > 0 and (ask_id, id) not in (select (ask_id, id) from bad)))
    select ask_id, id as cache_id, round(sim, 6) as sim, shared from (
      select *, row_number() over (partition by ask_id order by shared, sim desc, id) as rn from ok) where rn = 1""")
def _(fx):
    return rounded(ca.cache_semantic(fx.v_ask_vec, fx.v_cache_near, fx.v_holding), "sim")


_ANSWERS = """select id as seq, user_id, md5(query) as query_hash, query, answer, chunk_ids, route <> 'click' as complete, route = 'signup' as rejected from {v_qa_log}"""
_CACHE_NOW = "select user_id, query_hash, min(query) as query, min(answer) as answer, min(file_ids) as file_ids, true as invalidated from {v_cache} group by user_id, query_hash"


@query("cch5_cache_store", f"""
    with good as (select * from ({_ANSWERS}) where complete and not rejected and answer <> '' and not starts_with(answer, '资料中未找到')),
    last as (select * from (select *, row_number() over (partition by user_id, query_hash order by seq desc) as rn from good) where rn = 1),
    f as (select seq, string_agg(cast(file_id as varchar), ',' order by file_id) as file_ids from (
            select distinct l.seq, c.file_id from (select seq, unnest(chunk_ids) as chunk_id from last) l join {{v_chunk}} c on c.chunk_id = l.chunk_id) group by seq),
    base as (select user_id, query_hash, query, answer, array_to_string(file_ids, ',') as file_ids from ({_CACHE_NOW}))
    select coalesce(b.user_id, l.user_id) as user_id, coalesce(b.query_hash, l.query_hash) as query_hash, coalesce(b.query, l.query) as query,
      case when l.seq is not null then l.answer else b.answer end as answer,
      case when l.seq is not null then coalesce(f.file_ids, '') else b.file_ids end as file_ids, l.seq is null as invalidated
    from base b full join last l on b.user_id = l.user_id and b.query_hash = l.query_hash left join f on f.seq = l.seq""")
def _(fx):
    return ca.cache_store(fx.sql(_CACHE_NOW), fx.sql(_ANSWERS), fx.v_chunk).withColumn("file_ids", F.array_join("file_ids", ","))


_CHANGED = "select user_id, id as file_id from {v_user_file} where user_id is not null and file_size > 500"


@query("cch6_cache_invalidate", f"""
    select c.id, c.invalidated or exists (select 1 from ({_CHANGED}) x where x.user_id = c.user_id and list_contains(c.file_ids, x.file_id)) as invalidated from {{v_cache}} c""")
def _(fx):
    return ca.cache_invalidate(fx.v_cache, fx.sql(_CHANGED)).select("id", "invalidated")


BOTH["v_sem_store"] = f"select vec_id as id, (vec_id * 5) % 23 as user_id, embedding, {BASE_S} + vec_id as ts_s from {{v_near_vec}}"
_SEM = "select vec_id as query_id, (vec_id * 5) % 23 as user_id, embedding from {v_vec}"
_SEM_C = "select id as chunk_id, user_id, embedding, ts_s from {v_sem_store}"


@query("cch7_semcache_lookup", "select query_id as ask_id, chunk_id as cache_id, round(sim, 6) as sim from ("
       + _vec(f"({_SEM_C})", f"({_SEM})", "user_id", 1, "where sim >= 0.95") + ")")
def _(fx):
    return rounded(ca.semcache_lookup(fx.v_ask_vec, fx.v_sem_store), "sim")


@query("cch7_semcache_refresh", "with h as (" + _vec(f"({_SEM_C})", f"({_SEM})", "user_id", 1, "where sim >= 0.95") + f""")
    select id, user_id, case when id in (select chunk_id from h) then {NOW_S} else ts_s end as ts_s from {{v_sem_store}}""")
def _(fx):
    hits = ca.semcache_lookup(fx.v_ask_vec, fx.v_sem_store)
    return ca.semcache_refresh(fx.v_sem_store, hits, NOW_S).select("id", "user_id", "ts_s")


BOTH["v_sem_rows"] = """select user_id, concat(substring(q, 1, 60), ':', cast(length(q) as varchar(20))) as key, max(q) as query, max(ts_s) as ts_s from (
    select user_id, concat(event_type, ' ', props, ' ', cast(event_id % 40 as varchar(20))) as q, 1704067200 + event_id as ts_s from {events}) group by 1, 2"""
SPLIT["v_sem_new"] = (
    "select user_id, query, concat(substring(query, 1, 60), ':', cast(length(query) as string)) as key, ts_s from (select user_id, concat('new ', event_type) as query, 1804067200 + event_id as ts_s from {events} where event_type <> 'view')",
    "select user_id, query, concat(substring(query, 1, 60), ':', cast(length(query) as varchar)) as key, ts_s from (select user_id, concat('new ', event_type) as query, 1804067200 + event_id as ts_s from {events} where event_type <> 'view')")


@query("cch8_semcache_store", """
    with n as (select * from (select *, row_number() over (partition by user_id order by ts_s desc, key desc) as rn from {v_sem_new}) where rn = 1),
    s as (select *, count(*) over (partition by user_id) as c, row_number() over (partition by user_id order by ts_s, key) as age from {v_sem_rows}),
    l as (select user_id, key, query, ts_s from s where not (c >= 60 and user_id in (select user_id from n) and age <= greatest(1, cast(floor(c * 0.2) as bigint))))
    select user_id, key, query, ts_s from l where (user_id, key) not in (select (user_id, key) from n) union all select user_id, key, query, ts_s from n""")
def _(fx):
    return ca.semcache_store(fx.v_sem_rows, fx.v_sem_new, cap=60)


@query("cch9_semcache_clear", "select user_id, count(*) as entries from {v_sem_rows} where user_id <> 4 group by user_id")
def _(fx):
    return ca.semcache_clear(fx.v_sem_rows, 4).groupBy("user_id").agg(F.count(F.lit(1)).alias("entries"))


# ---------------------------------------------------------------- memory

@query("mem1_history", """
    with l as (select * from (select *, row_number() over (partition by session_id order by id desc) as back from {v_qa_log}) where back <= 10)
    select session_id, id, cast(0 as bigint) as part, 'user' as role, query as content from l union all
    select session_id, id, cast(1 as bigint) as part, 'assistant' as role, substring(answer, 1, 800) as content from l""")
def _(fx):
    return ca.history(fx.v_qa_log, 10)


@query("mem2_turns_due", """
    select session_id, count(*) as turns, count(*) % 5 = 0 and count(*) * 2 >= 4 as due from (
      select cast(conv_id as varchar) as session_id from {conversations}) group by session_id""")
def _(fx):
    return ca.turns_due(fx.conversations.select(F.col("conv_id").cast("string").alias("session_id")))


_ITEMS = """select conv_id as extract_id, conv_id % 23 as user_id, case when turn % 2 = 0 then 'focus' else 'open_question' end as mem_type, turn as pos,
    case when turn % 5 = 4 then '  ' when turn % 3 = 0 then concat(' topic ', cast(conv_id % 9 as varchar(20))) else text end as content from {conversations}"""
_MEM = "select distinct user_id, 'focus' as mem_type, concat('topic ', cast(user_id % 5 as varchar(20))) as content from {v_cache}"


@query("mem3_memory_insert", f"""
    with t as (select *, row_number() over (partition by extract_id, mem_type order by pos) as n from ({_ITEMS})),
    c as (select *, {duck_strip('content')} as c from t where n <= case when mem_type = 'focus' then 3 else 2 end),
    f as (select *, row_number() over (partition by user_id, c order by extract_id, mem_type, pos) as rn from c where c <> '')
    select user_id, mem_type, c as content from f where rn = 1 and (user_id, c) not in (select (user_id, content) from ({_MEM}))""")
def _(fx):
    return ca.memory_insert(fx.sql(_MEM.replace("varchar(20)", "string")), fx.sql(_ITEMS.replace("varchar(20)", "string")))


@query("mem4_memory_recall", "select query_id as ask_id, chunk_id as memory_id, rank, round_even(sim, 3) as sim from ("
       + _vec(f"({_SEM_C})", f"({_SEM})", "user_id", 3, "where sim > 0.4") + ")")
def _(fx):
    return ca.memory_recall(fx.v_ask_vec, fx.v_sem_store)


_SESSIONS = "select concat('s-', cast(c_custkey as varchar(20))) as session_id, c_custkey % 23 as user_id, c_custkey % 6 as dir_id, 1704067200 + c_custkey as created_s from {customer}"


@query("mem5_sessions", f"""
    select s.session_id, s.user_id, s.dir_id, s.created_s, coalesce(t.turns, 0) as turns from ({_SESSIONS}) s
    left join (select session_id, count(*) as turns from {{v_qa_log}} group by session_id) t on t.session_id = s.session_id""")
def _(fx):
    return ca.sessions(fx.sql(_SESSIONS.replace("varchar(20)", "string")), fx.v_qa_log)
