"""User function surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import mrr, register_table_functions, rrf_score
from ..functions.text import REFUSAL_MARKERS, register_functions
from ..operators.search import pair_scorer
from .answer_queries import _NORMAL, duck_tokens
from .registry import query
from .text_queries import ORACLE_SPLIT_TABLE, _duck_split

_TEXTS = "select doc_id, concat(text, case when doc_id % 4 = 0 then ' 未找到。' when doc_id % 4 = 1 then '？' else '' end) as query from {documents}"


@query("udf1_scalar_functions", f"""
    select doc_id, {duck_tokens('query')} as tokens, md5({_NORMAL}) as query_hash, regexp_replace(query, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g') = '' as junk,
      {' or '.join(f"contains(query, '{m}')" for m in REFUSAL_MARKERS)} as refused, length(query) >= 40 as complex,
      cast(len(list_distinct(regexp_extract_all(query, '[A-Za-z0-9_]{{2,}}'))) as bigint) as latin_terms
    from ({_TEXTS})""")
def _(fx):
    register_functions(fx.spark)
    return fx.spark.sql("""
        select doc_id, est_tokens(query) as tokens, query_hash(query) as query_hash, is_junk(query) as junk, looks_refused(query) as refused,
               needs_agent(query) as complex,
               cast(size(filter(content_terms(query), t -> t rlike '^[A-Za-z0-9_]+$')) as bigint) as latin_terms from {t}""", t=fx.sql(_TEXTS))


@query("udf1_cosine", """
    select a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as sim
    from (select vec_id, cast(embedding as double[]) as e from {embeddings}) a join (select vec_id, cast(embedding as double[]) as e from {embeddings}) b on b.vec_id = a.vec_id + 1""")
def _(fx):
    register_functions(fx.spark)
    return fx.spark.sql("select a.vec_id, round(cosine(a.embedding, b.embedding), 6) as sim from {e} a join {e} b on b.vec_id = a.vec_id + 1", e=fx.embeddings)


@query("udf2_markdown_nodes", "select doc_id, count(*) as lines from (select doc_id, unnest(string_split(text, chr(10))) as l from {documents}) where trim(l) <> '' group by doc_id")
def _(fx):
    """On plain prose every line that is not blank is one node."""
    register_table_functions(fx.spark)
    return fx.spark.sql("select d.doc_id, count(*) as lines from {d} d, lateral markdown_nodes(d.text) n group by d.doc_id", d=fx.documents)


@query("udf2_chunk_text", _duck_split(
    "list_filter(string_split(regexp_replace(text, '([。！？\\n])', '\\1' || chr(1), 'g'), chr(1)), lambda p: p <> '')",
    450, "''", 50, "select doc_id, text from {documents}"))
def _(fx):
    register_table_functions(fx.spark)
    return fx.spark.sql("select d.doc_id, cast(n.piece_no as bigint) as piece_no, n.piece from {d} d, lateral chunk_text(d.text) n", d=fx.documents)


_TABLES = """select l_orderkey % 7000 as table_id, l_orderkey * 100 + l_linenumber as row_no, l_partkey from {lineitem}"""


@query("udf2_split_table", ORACLE_SPLIT_TABLE)
def _(fx):
    register_table_functions(fx.spark)
    rows = fx.sql(_TABLES).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "l_partkey"))).alias("rows"))
    tables = rows.selectExpr("table_id", "concat('| a | b |\\n|---|---|\\n', array_join(transform(rows, r -> concat('| ', r.row_no, ' | ', r.l_partkey, ' |')), '\\n')) as text")
    return fx.spark.sql("select t.table_id, cast(n.piece_no as bigint) as piece_no, n.piece from {t} t, lateral split_table(t.text) n", t=tables)


class SharedWords:
    """Scorer plug-in: number of different words that question and passage share."""

    def score(self, questions: list[str], passages: list[str]) -> list[float]:
        return [float(len(set(q.split(" ")) & set(p.split(" ")))) for q, p in zip(questions, passages)]


@query("udf3_pair_scorer", """
    select d.doc_id, b.item_id, cast(len(list_intersect(string_split(b.text, ' '), string_split(d.text, ' '))) as double) as score
    from {documents} d join {benchmark} b on b.item_id = d.doc_id % (select max(item_id) + 1 from {benchmark})""")
def _(fx):
    pairs = fx.sql("""select d.doc_id, b.item_id, d.text as passage, b.text as question from {documents} d
                      join {benchmark} b on b.item_id = d.doc_id % (select max(item_id) + 1 from {benchmark})""")
    return pairs.select("doc_id", "item_id", pair_scorer(SharedWords)(F.col("question"), F.col("passage")).alias("score"))


@query("udf4_rank_aggregates", """
    select user_id, round(sum(1.0::double / (60 + r)), 6) as rrf, round(avg(coalesce(1.0::double / m, 0)), 6) as mrr
    from (select user_id, event_id % 50 + 1 as r, case when event_id % 3 = 0 then null else event_id % 7 + 1 end as m from {events}) group by user_id""")
def _(fx):
    ranks = fx.events.selectExpr("user_id", "event_id % 50 + 1 as r", "case when event_id % 3 = 0 then null else event_id % 7 + 1 end as m")
    return ranks.groupBy("user_id").agg(F.round(rrf_score(F.col("r")), 6).alias("rrf"), F.round(mrr(F.col("m")), 6).alias("mrr"))
