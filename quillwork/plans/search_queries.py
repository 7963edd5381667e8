"""Search queries: scope, channels, fusion, re-ranking, whole search and its views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import postings as po
from ..operators import search as se
from ..operators import vectors as ve
from .inputs import BOTH, SPLIT
from .registry import query

BOTH["v_chunk_row"] = """
    select d.doc_id as chunk_id, d.doc_id as file_id, concat(d.source, ' > ', d.lang) as heading_path, d.text as content,
           case when d.doc_id % 9 = 4 then 'image' else 'paragraph' end as chunk_type, d.doc_id % 6 as page_no, e.embedding
    from {documents} d left join {embeddings} e on e.vec_id = d.doc_id"""
BOTH["v_search_chunk"] = """
    select c.*, f.filename, f.owner_type, f.org_id, f.user_id, f.dir_id from {v_chunk_row} c join {v_user_file} f on f.id = c.file_id and f.status = 1"""
BOTH["v_question"] = """
    select b.item_id as query_id, b.text as question, b.item_id % 5 as org_id, b.item_id % 26 as top_k, e.embedding
    from {benchmark} b left join {embeddings} e on e.vec_id = b.item_id"""
_SUB = """select b.item_id as query_id, b.sub_no, case b.sub_no when 0 then b.text when 1 then substring(b.text, 1, 60) else substring(b.text, 61) end as question,
           e.embedding from (%s) b left join {embeddings} e on e.vec_id = b.item_id + 3 * b.sub_no"""
SPLIT["v_subquestion"] = (_SUB % "select item_id, text, sub_no from {benchmark} lateral view explode(array(0, 1, 2)) t as sub_no",
                          _SUB % "select item_id, text, unnest([0, 1, 2]) as sub_no from {benchmark}")


def visible(fx):
    return se.visible_chunks(fx.v_chunk_row, fx.v_search_file)


# ---------------------------------------------------------------- oracle pieces (DuckDB text)

_WORDS = r"[\p{L}\p{M}\p{N}_]+"


def _bm25(chunks: str, questions: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    on = f"and a.{keys} = b.{keys}" if keys else ""
    return f"""
    select query_id, chunk_id, bm25, rank from (
      select *, row_number() over (partition by query_id order by bm25 desc, chunk_id) as rank from (
        with toks as (select {k}chunk_id, unnest(t) as term, len(t) as dl from (
               select {k}chunk_id, regexp_extract_all(lower(trim(concat_ws(' ', heading_path, content))), '{_WORDS}') as t from {chunks})),
        c as (select {k}count(*) as n_docs, avg(dl) as avg_dl from (
               select {k}chunk_id, len(regexp_extract_all(lower(trim(concat_ws(' ', heading_path, content))), '{_WORDS}')) as dl from {chunks}) {f'group by {keys}' if keys else ''}),
        tf as (select {k}chunk_id, dl, term, count(*) as tf from toks group by {k}chunk_id, dl, term),
        df as (select {k}term, count(*) as df from tf group by {k}term),
        q as (select {k}query_id, term, count(*) as qtf from (
               select {k}query_id, unnest(regexp_extract_all(lower(question), '{_WORDS}')) as term from {questions}) group by {k}query_id, term),
        w as (select a.*, a.qtf * ln(1 + (c.n_docs - b.df + 0.5::double) / (b.df + 0.5::double)) as w, c.avg_dl
              from q a join df b on a.term = b.term {on} join c on {f'c.{keys} = a.{keys}' if keys else 'true'})
        select a.query_id, b.chunk_id, round(sum(a.w * b.tf * 2.5::double / (b.tf + 1.5::double * (0.25::double + 0.75::double * b.dl / a.avg_dl))), 9) as bm25
        from tf b join w a on a.term = b.term {on} group by a.query_id, b.chunk_id) where bm25 > 0) where rank <= 50"""


def _vec(chunks: str, questions: str, keys: str = "", k: int = 50, min_sim: str = "") -> str:
    on = f"q.{keys} = c.{keys}" if keys else "true"
    return f"""
    select query_id, chunk_id, sim, rank from (
      select *, row_number() over (partition by query_id order by sim desc, chunk_id) as rank from (
        select q.query_id, c.chunk_id, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 9) as sim
        from (select *, cast(embedding as double[]) as e from {questions} where embedding is not null) q
        join (select *, cast(embedding as double[]) as e from {chunks} where embedding is not null) c on {on}) {min_sim}) where rank <= {k}"""


def _fused(bm25: str, vec: str) -> str:
    return f"""
    select * from (select *, row_number() over (partition by query_id order by rrf desc, vrank nulls last, brank nulls last, chunk_id) as rank from (
      select coalesce(v.query_id, b.query_id) as query_id, coalesce(v.chunk_id, b.chunk_id) as chunk_id, v.rank as vrank, v.sim, b.rank as brank, b.bm25,
             coalesce(1.0::double / (60 + v.rank), 0) + coalesce(1.0::double / (60 + b.rank), 0) as rrf
      from {vec} v full join {bm25} b on v.query_id = b.query_id and v.chunk_id = b.chunk_id)) where rank <= 20"""


def _logit(question: str, text: str) -> str:
    qw = f"list_distinct(regexp_extract_all(lower({question}), '{_WORDS}'))"
    return f"round(10.0::double * len(list_intersect({qw}, list_distinct(regexp_extract_all(lower({text}), '{_WORDS}')))) / greatest(len({qw}), 1) - 7, 9)"


_TERMS = "list_distinct(regexp_extract_all(question, '[A-Za-z0-9_]{2,}'))"
_HOLDER = "(contains(content, '[图片解析失败]') or contains(content, '[图片无法解析]') or contains(content, '[该页解析失败]') or contains(content, '[该页转录为空]'))"


def _hybrid(fused: str, chunks: str, questions: str, top_k: int, cascade: bool = False, shift: int = 0) -> str:
    skip = (f"bool_or(rank = 1 and coalesce(vrank <= 3, false) and coalesce(brank <= 3, false) and chunk_type <> 'image' and not {_HOLDER}) over (partition by query_id)"
            if cascade else "false")
    return f"""
    select query_id, rank, chunk_id, case when reranked then logit else coalesce(bm25, 0) end as score, reranked, skip as rerank_skipped, rrf, bm25, sim from (
      select *, row_number() over (partition by query_id order by logit desc nulls last, fused_rank) as rank from (
        select *, coalesce(logit >= -5, false) as reranked from (
          select query_id, rank as fused_rank, chunk_id, vrank, brank, bm25, sim, rrf, skip, passage, question, case when not skip then round({_logit('question', 'passage')} - {shift}, 9) end as logit
          from (select *, {skip} as skip from (
            select f.*, c.chunk_type, c.content, trim(concat_ws(' ', c.heading_path, c.content)) as passage, q.question
            from {fused} f join {chunks} c on c.chunk_id = f.chunk_id join {questions} q on q.query_id = f.query_id)))
        where skip or coalesce(logit >= -5, false) or (coalesce(brank, 99) <= 5 and coalesce(bm25, 0) > 0
          and coalesce(list_bool_or(list_transform({_TERMS}, lambda t: contains(lower(passage), lower(t)))), false)))) where rank <= {top_k}"""


BOTH["o_bm25"] = _bm25("{v_search_chunk}", "{v_question}")
BOTH["o_vec"] = _vec("{v_search_chunk}", "{v_question}")
BOTH["o_fused"] = _fused("{o_bm25}", "{o_vec}")
BOTH["o_hybrid"] = _hybrid("{o_fused}", "{v_search_chunk}", "{v_question}", 5)
BOTH["o_hybrid8"] = _hybrid("{o_fused}", "{v_search_chunk}", "{v_question}", 8)
BOTH["o_cascade"] = _hybrid("{o_fused}", "{v_search_chunk}", "{v_question}", 5, cascade=True)
_ROUND = "query_id, rank, chunk_id, round(score, 6) as score, reranked, rerank_skipped, round(rrf, 6) as rrf, round(bm25, 6) as bm25, round(sim, 6) as sim"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def whole_search(fx, **how):
    return se.hybrid_search(fx.v_question.select("query_id", "question", "embedding"), visible(fx), **how)


# ---------------------------------------------------------------- scope

@query("ret1_scope_org", "select id, filename from {v_user_file} where owner_type = 'org' and org_id = 3")
def _(fx):
    return se.scope(fx.v_user_file, org=3).select("id", "filename")


@query("ret1_scope_user_dir", "select id, filename from {v_user_file} where owner_type = 'personal' and user_id = 4 and dir_id = 3")
def _(fx):
    return se.scope(fx.v_user_file, user=4, directory=3).select("id", "filename")


@query("ret1_scope_owners", """
    select case when owner_type = 'org' then 'o' || org_id else 'u' || user_id end as owner, count(*) as files from {v_user_file} group by 1""")
def _(fx):
    return se.with_owner(fx.v_user_file).groupBy("owner").agg(F.count(F.lit(1)).alias("files"))


@query("ret2_visible_chunks", "select c.chunk_id, c.file_id, f.filename from {v_chunk} c join {v_user_file} f on f.id = c.file_id and f.status = 1")
def _(fx):
    return se.visible_chunks(fx.v_chunk, fx.v_user_file).select("chunk_id", "file_id", "filename")


# ---------------------------------------------------------------- vectors

_ALL_Q = "(select vec_id as query_id, user_id, embedding from {v_vec})"
_ALL_C = "(select vec_id as chunk_id, user_id, embedding from {v_vec})"


def _queries(fx):
    return fx.v_vec.select(F.col("vec_id").alias("query_id"), "user_id", "embedding")


def _chunks(fx):
    return fx.v_vec.select(F.col("vec_id").alias("chunk_id"), "user_id", "embedding")


@query("ret3_vector_topk", f"select query_id, chunk_id, round(sim, 6) as sim, rank from ({_vec(_ALL_C, _ALL_Q)})")
def _(fx):
    return rounded(ve.vector_topk(_queries(fx), _chunks(fx), 50), "sim")


@query("ret3_vector_topk_cells", f"select query_id, chunk_id, round(sim, 6) as sim, rank from ({_vec(_ALL_C, _ALL_Q, k=10)})")
def _(fx):
    """The same search by cells around pivots, of which those that cannot hold a hit are left out."""
    return rounded(ve.vector_topk(_queries(fx), _chunks(fx), 10, cells=16), "sim")


@query("ret3_vector_topk_scoped", f"select query_id, chunk_id, round(sim, 6) as sim, rank from ({_vec(_ALL_C, _ALL_Q, 'user_id', 5)})")
def _(fx):
    return rounded(ve.vector_topk(_queries(fx), _chunks(fx), 5, keys=["user_id"]), "sim")


@query("ret4_ann_recall")
def _(fx):
    """Approximate search, measured against the exact one."""
    return ve.recall_against(ve.ann_topk(_queries(fx), _chunks(fx), 10), ve.vector_topk(_queries(fx), _chunks(fx), 10))


# ---------------------------------------------------------------- keywords

@query("ret5_tokenize", f"""
    select doc_id, cast(len(t) as bigint) as tokens, array_to_string(t, ' ') as text from (
      select doc_id, regexp_extract_all(lower(text), '{_WORDS}') as t from {{documents}})""")
def _(fx):
    from ..functions.text import fn
    return fx.documents.select("doc_id", fn("tokenize", t="text").alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.array_join("t", " ").alias("text"))


@query("ret6_bm25", "select query_id, chunk_id, rank, round(bm25, 6) as bm25 from {o_bm25}")
def _(fx):
    return rounded(se.bm25_topk(fx.v_question, visible(fx)), "bm25")


@query("ret6_bm25_org", "select query_id, chunk_id, rank, round(bm25, 6) as bm25 from ("
       + _bm25("(select * from {v_search_chunk} where owner_type = 'org')", "{v_question}", "org_id") + ")")
def _(fx):
    return rounded(se.bm25_topk(fx.v_question, visible(fx).filter("owner_type = 'org'"), keys=["org_id"]), "bm25")


_INDEXES: dict[tuple[str, str, str], po.Index] = {}


def stored(fx, name: str, build) -> po.Index:
    """The index of that name over the tables of ``fx``, built on first use and kept for the session."""
    key = (fx.spark.sparkContext.applicationId, fx.sf_dir, name)
    if key not in _INDEXES:
        _INDEXES[key] = build()
    return _INDEXES[key]


def visible_index(fx) -> po.Index:
    return stored(fx, "visible", lambda: po.build_index(visible(fx)))


@query("ret6_index_terms", f"""
    with t as (select chunk_id, unnest(regexp_extract_all(lower(trim(concat_ws(' ', heading_path, content))), '{_WORDS}')) as term from {{v_search_chunk}})
    select term, count(distinct chunk_id) as df, count(*) as occurrences, min(chunk_id) as first_chunk from t group by term""")
def _(fx):
    """What the stored index holds of each term, read back from its blocks."""
    blocks = po.build_index(visible(fx)).read(fx.spark, "postings").select("term", F.inline("entries"))
    return blocks.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.min("chunk_id").alias("first_chunk"))


@query("ret6_index_search", "select query_id, chunk_id, rank, round(bm25, 6) as bm25 from {o_bm25}")
def _(fx):
    """Exact top 50 from stored postings; no text of a chunk is read."""
    return rounded(po.search_index(fx.v_question, visible_index(fx)), "bm25")


@query("ret6_index_search_org", "select query_id, chunk_id, rank, round(bm25, 6) as bm25 from ("
       + _bm25("(select * from {v_search_chunk} where owner_type = 'org')", "{v_question}", "org_id") + ")")
def _(fx):
    index = stored(fx, "orgs", lambda: po.build_index(visible(fx).filter("owner_type = 'org'"), keys=["org_id"]))
    return rounded(po.search_index(fx.v_question, index), "bm25")


@query("ret9_content_terms", """
    select query_id, array_to_string(list_sort(list_distinct(regexp_extract_all(question, '[A-Za-z0-9_]{2,}'))), ' ') as terms from {v_question}""")
def _(fx):
    return se.with_terms(fx.v_question).select("query_id", F.array_join(F.array_sort("terms"), " ").alias("terms"))


# ---------------------------------------------------------------- fusion and re-ranking

@query("ret7_rrf", "select query_id, chunk_id, rank, round(rrf, 6) as rrf, vrank, brank from {o_fused}")
def _(fx):
    return rounded(se.fuse(fx.v_question, visible(fx)), "rrf").select("query_id", "chunk_id", "rank", "rrf", "vrank", "brank")


@query("ret8_consensus", f"""
    select f.query_id, f.chunk_id, coalesce(vrank <= 3 and brank <= 3 and chunk_type <> 'image' and not {_HOLDER}, false) as agreed
    from {{o_fused}} f join {{v_search_chunk}} c on c.chunk_id = f.chunk_id where f.rank = 1""")
def _(fx):
    chunks = visible(fx)
    return se.consensus(se.fuse(fx.v_question, chunks), chunks)


@query("ret10_rerank", f"""
    select query_id, chunk_id, rank, round(logit, 6) as score from (
      select *, row_number() over (partition by query_id order by logit desc, fused_rank) as rank from (
        select f.query_id, f.chunk_id, f.rank as fused_rank, {_logit('q.question', "trim(concat_ws(' ', c.heading_path, c.content))")} as logit
        from {{o_fused}} f join {{v_search_chunk}} c on c.chunk_id = f.chunk_id join {{v_question}} q on q.query_id = f.query_id) where logit >= -5) where rank <= 5""")
def _(fx):
    chunks = visible(fx)
    cand = (se.fuse(fx.v_question, chunks).join(chunks.select("chunk_id", se.passage().alias("passage")), "chunk_id")
            .join(fx.v_question.select("query_id", "question"), "query_id"))
    return rounded(se.rerank(cand, protect=False), "score").select("query_id", "chunk_id", "rank", "score")


BOTH["o_strict"] = _hybrid("{o_fused}", "{v_search_chunk}", "{v_question}", 5, shift=6)


@query("ret11_protected", f"select {_ROUND} from {{o_strict}}")
def _(fx):
    """A stricter scorer pushes most candidates below the cut, so that protection decides."""
    found = whole_search(fx, scorer=lambda question, text: se.lexical_scorer(question, text) - 6)
    return rounded(found, "score", "rrf", "bm25", "sim")


@query("ret12_hybrid_search", f"select {_ROUND} from {{o_hybrid}}")
def _(fx):
    return rounded(whole_search(fx), "score", "rrf", "bm25", "sim")


@query("ret12_hybrid_indexed", f"select {_ROUND} from {{o_hybrid}}")
def _(fx):
    """The whole search with keyword hits from the stored index."""
    questions = fx.v_question.select("query_id", "question", "embedding")
    fused = se.rrf(ve.vector_topk(questions, visible(fx), se.CHANNEL_TOP), po.search_index(questions, visible_index(fx)))
    return rounded(whole_search(fx, fused=fused), "score", "rrf", "bm25", "sim")


@query("ret12_hybrid_cascade", f"select {_ROUND} from {{o_cascade}}")
def _(fx):
    return rounded(whole_search(fx, cascade=True), "score", "rrf", "bm25", "sim")


# a user and a directory per question; a place is both
BOTH["v_owner_question"] = """
    select query_id, question, embedding, concat('u', cast(query_id % 23 as varchar(20))) as owner,
           concat('u', cast(query_id % 23 as varchar(20)), '/', cast(query_id % 2 * 3 as varchar(20))) as place from {v_question}"""
BOTH["v_owner_chunk"] = """
    select *, concat(owner, '/', cast(dir_id as varchar(20))) as place from (
      select c.*, concat(case when owner_type = 'org' then 'o' else 'u' end, cast(coalesce(org_id, user_id) as varchar(20))) as owner from {v_search_chunk} c) o"""


def _scoped(key: str) -> str:
    chunks, asked = "{v_owner_chunk}", "{v_owner_question}"
    if key == "place":
        chunks = "(select * from {v_owner_chunk} where dir_id is not null)"
    fused = _fused("(" + _bm25(chunks, asked, key) + ")", "(" + _vec(chunks, asked, key) + ")")
    return f"select {_ROUND} from (" + _hybrid(f"({fused})", chunks, asked, 5) + ")"


def _search_in(fx, *keys: str):
    files = se.with_owner(fx.v_search_file).filter(" and ".join(f"{k} is not null" for k in keys))
    asked = fx.v_owner_question.selectExpr("query_id", "question", "embedding", "owner", "query_id % 2 * 3 as dir_id")
    found = se.hybrid_search(asked.select("query_id", "question", "embedding", *keys), se.visible_chunks(fx.v_chunk_row, files), keys=list(keys))
    return rounded(found, "score", "rrf", "bm25", "sim")


@query("ret12_hybrid_user", _scoped("owner"))
def _(fx):
    """Every question over the files of its own user."""
    return _search_in(fx, "owner")


@query("ret12_hybrid_user_directory", _scoped("place"))
def _(fx):
    """Every question over one directory of its own user."""
    return _search_in(fx, "owner", "dir_id")


@query("ret12_fused_only", """
    select query_id, rank, chunk_id, round(coalesce(bm25, 0), 6) as score, false as reranked, false as rerank_skipped,
           round(rrf, 6) as rrf, round(bm25, 6) as bm25, round(sim, 6) as sim from {o_fused} where rank <= 5""")
def _(fx):
    return rounded(whole_search(fx, use_rerank=False), "score", "rrf", "bm25", "sim")


BOTH["o_sub"] = "select query_id * 1000 + sub_no as query_id, question, embedding from {v_subquestion}"
BOTH["o_sub_fused"] = _fused("(" + _bm25("{v_search_chunk}", "{o_sub}") + ")", "(" + _vec("{v_search_chunk}", "{o_sub}") + ")")


@query("ret13_multi_search", f"""
    with h as (select query_id // 1000 as query_id, query_id % 1000 as sub_no, rank, chunk_id, coalesce(bm25, 0) as score from {{o_sub_fused}} where rank <= 24),
    f as (select * from (select *, row_number() over (partition by query_id, chunk_id order by sub_no, rank) as rn from h) where rn = 1),
    m as (select * from (select *, row_number() over (partition by query_id order by score desc, sub_no, rank) as mr from f) where mr <= 24),
    s as (select m.query_id, m.chunk_id, m.mr, {_logit('q.question', 'c.content')} as score
          from m join {{v_search_chunk}} c on c.chunk_id = m.chunk_id join {{v_question}} q on q.query_id = m.query_id),
    r as (select * from (select *, row_number() over (partition by query_id order by score desc, mr) as rank from s) where rank <= 8)
    select query_id, rank, chunk_id, round(score, 6) as score, bool_or(score < 0) over (partition by query_id) as low_confidence from r""")
def _(fx):
    return rounded(se.multi_search(fx.v_question, fx.v_subquestion, visible(fx)), "score")


@query("ret14_search_hits", """
    select query_id, row_number() over (partition by query_id order by score desc, rank) as rank, chunk_id, round(score, 6) as score,
      not bool_or(rank = 1 and reranked and score >= 0) over (partition by query_id) as low_confidence from {o_hybrid8}""")
def _(fx):
    return rounded(se.search_hits(whole_search(fx, top_k=8)), "score").select("query_id", "rank", "chunk_id", "score", "low_confidence")



@query("ret15_rejections", """
    select q.query_id, h.score is null or (h.reranked and h.score < -5) as rejected,
      case when h.score is null then '检索无结果' when h.reranked and h.score < -5 then '检索置信度低（' || printf('%.2f', h.score) || ' < -5.0）' else '' end as reason
    from {v_question} q left join (select query_id, score - 6 as score, reranked from {o_hybrid} where rank = 1) h on h.query_id = q.query_id""")
def _(fx):
    shifted = whole_search(fx).withColumn("score", F.col("score") - 6)
    return se.rejections(fx.v_question, shifted)


BOTH["o_org_fused"] = _fused("(" + _bm25("(select * from {v_search_chunk} where owner_type = 'org')", "{v_question}", "org_id") + ")",
                             "(" + _vec("(select * from {v_search_chunk} where owner_type = 'org')", "{v_question}", "org_id") + ")")


@query("ret16_org_search", "select h.query_id, h.rank, h.chunk_id, round_even(h.score, 4) as score from ("
       + _hybrid("{o_org_fused}", "{v_search_chunk}", "{v_question}", 20) + ") h join {v_question} q on q.query_id = h.query_id "
       "where h.rank <= least(greatest(q.top_k, 1), 20)")
def _(fx):
    found = se.org_search(fx.v_question, visible(fx).filter("owner_type = 'org'"))
    return found.select("query_id", "rank", "chunk_id", "score")


@query("ret17_hit_view", """
    select h.query_id, h.rank, h.chunk_id, c.file_id, c.chunk_type, round(h.score, 6) as score, substring(c.content, 1, 600) as content,
      not bool_or(h.rank = 1 and h.reranked) over (partition by h.query_id) as low_confidence
    from {o_hybrid} h join {v_search_chunk} c on c.chunk_id = h.chunk_id""")
def _(fx):
    return rounded(se.hit_view(whole_search(fx), visible(fx)), "score")


@query("ret17_chunk_preview", """
    select file_id, seq, chunk_type, coalesce(page_no, 0) + 1 as page, substring(content, 1, 500) as content from (
      select c.*, row_number() over (partition by c.file_id order by c.seq) as pos from {v_chunk} c
      join {v_user_file} f on f.id = c.file_id and f.status = 1) where pos <= 20""")
def _(fx):
    return se.chunk_preview(fx.v_chunk, fx.v_user_file)


@query("ret18_top1_prior", """
    select q.query_id, coalesce('(' || c.filename || ' p.' || (coalesce(c.page_no, 0) + 1) || ') ' || substring(c.content, 1, 200), '（无命中）') as prior
    from {v_question} q left join {o_fused} f on f.query_id = q.query_id and f.rank = 1 left join {v_search_chunk} c on c.chunk_id = f.chunk_id""")
def _(fx):
    return se.top1_prior(fx.v_question, whole_search(fx, top_k=1, use_rerank=False), visible(fx))


# ---------------------------------------------------------------- flagship

@query("flagship_bm25_recall", """
    with g as (select distinct question_id, expect_doc from {v_golden} where expect_doc is not null),
    c as (select doc_id as chunk_id, '' as heading_path, text as content from {documents}),
    q as (select item_id as query_id, text as question from {benchmark}),
    h as (select query_id, chunk_id, rank from (""" + _bm25("c", "q") + """)),
    s as (select q.query_id, count(g.expect_doc) as expected, max(case when h.rank <= 5 then 1 else 0 end) as hit, min(h.rank) as first_rank
          from q left join g on g.question_id = q.query_id left join h on h.query_id = q.query_id and h.chunk_id = g.expect_doc group by q.query_id)
    select query_id, expected, hit > 0 as hit_at_5, first_rank from s""")
def _(fx):
    """Keyword search over all documents, judged by the documents that hold the passage."""
    chunks = fx.documents.select(F.col("doc_id").alias("chunk_id"), F.lit("").alias("heading_path"), F.col("text").alias("content"))
    questions = fx.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = se.bm25_topk(questions, chunks).select("query_id", F.col("chunk_id").alias("expect_doc"), "rank")
    golden = fx.v_golden.select(F.col("question_id").alias("query_id"), "expect_doc").filter("expect_doc is not null").distinct()
    judged = golden.join(hits, ["query_id", "expect_doc"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("expected"), F.bool_or(F.coalesce(F.col("rank") <= 5, F.lit(False))).alias("hit"), F.min("rank").alias("first_rank"))
    return questions.select("query_id").join(judged, "query_id", "left").select(
        "query_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("hit", F.lit(False)).alias("hit_at_5"), "first_rank")
