"""Input views over the driver's tables.

Each view is plain SQL that reads whole tables. ``BOTH`` holds text that runs in
Spark and in DuckDB; a pair is given where the two dialects differ. A view refers
to tables and other views as ``{name}``.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import spread

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SPREAD_BY = {"documents": "doc_id"}   # texts: the work per row is large, so few big splits starve the cluster

BASE_S = 1704067200          # 2024-01-01T00:00:00Z, the first second of the fixture period
NOW_S = BASE_S + 30 * 86400  # "now" of every time rule, so that results repeat

BOTH: dict[str, str] = {
    "v_user_file": f"""
        select d.doc_id as id,
               case when d.doc_id % 7 = 0 then null else d.doc_id % 23 end as user_id,
               b.blob_id, md5(d.text) as content_hash,
               concat(d.source, '_', cast(d.doc_id % 5 as varchar(20)),
                      case d.doc_id % 4 when 0 then '.md' when 1 then '.txt' when 2 then '.pdf' else '.docx' end) as filename,
               d.n_chars as file_size,
               case when d.doc_id % 11 = 0 then 0 else 1 end as status,
               case when d.doc_id % 3 = 0 then d.doc_id % 6 end as dir_id,
               case when d.doc_id % 7 = 0 then 'org' else 'personal' end as owner_type,
               case when d.doc_id % 7 = 0 then d.doc_id % 5 end as org_id,
               case when d.doc_id % 11 = 0 then {BASE_S} + d.doc_id * 3600 end as deleted_s,
               {BASE_S} + d.doc_id * 60 as created_s
        from {{documents}} d
        join (select md5(text) as h, min(doc_id) as blob_id from {{documents}} group by md5(text)) b
          on md5(d.text) = b.h""",
    "v_retrieval_log": """
        select event_id as id, user_id, event_id % 6 as hit_count, value as top_score,
               event_id % 5 = 0 as low_confidence, cast(floor(value * 10) as bigint) as vector_ms,
               cast(floor(value * 30) as bigint) as rerank_ms
        from {events}""",
    "v_parse_task": f"""
        select doc_id as file_id,
               case doc_id % 5 when 0 then 'pending' when 1 then 'parsing' when 2 then 'success'
                               when 3 then 'partial' else 'failed' end as status,
               doc_id % 4 as attempt, {BASE_S} + doc_id * 60 as updated_s
        from {{documents}}""",
    "v_issue": """
        select doc_id * 10 + b as id, doc_id as file_id, doc_id % 9 as page_no, b as block_order, 'image' as block_type,
               case (doc_id + b) % 5 when 0 then 'pending' when 1 then 'retrying' when 2 then 'resolved'
                                     when 3 then 'failed' else 'skipped' end as status,
               concat('[', cast(doc_id % 50 as varchar(20)), ', ', cast(b as varchar(20)), ', 300, 400.5]') as bbox
        from {v_doc3}""",
    "v_vec": """
        select vec_id, vec_id % 23 as user_id, vec_id % 100 as file_id, label, embedding from {embeddings}""",
    "v_qa_pair": """
        select conv_id, row_number() over (partition by conv_id order by turn) as pair_no, query, answer from (
          select conv_id, turn, role, text as query,
                 lead(text) over (partition by conv_id order by turn) as answer,
                 lead(role) over (partition by conv_id order by turn) as next_role from {conversations}) x
        where role = 'user' and next_role = 'assistant'""",
    "v_feedback": """
        select event_id as id, event_id % 700 as qa_log_id, user_id,
               case when event_id % 3 = 0 then -1 else 1 end as rating,
               case when event_id % 4 = 0 then '' else concat('fix ', props) end as correction
        from {events}""",
    "v_upload_part": """
        select l_orderkey as session_id, cast(l_linenumber - 1 as bigint) as chunk_index,
               cast(l_quantity as bigint) as chunk_size,
               l_partkey * 1000000000 + cast(floor(l_extendedprice * 100) as bigint) as part_id
        from {lineitem}""",
    "v_upload_session": """
        select o_orderkey as session_id, o_custkey as user_id, o_orderkey % 5 + 1 as chunk_count,
               cast(floor(o_totalprice) as bigint) % 200 as file_size,
               case o_orderstatus when 'O' then 'uploading' when 'F' then 'completed' else 'uploading' end as status
        from {orders}""",
    "v_job": f"""
        select event_id as id, event_id % 4 as attempt, 3 as max_attempts,
               case event_type when 'view' then 'queued' when 'click' then 'running' when 'error' then 'failed'
                               when 'signup' then 'dead' else 'done' end as status,
               case when event_id % 3 = 0 then null else {NOW_S} - 600 + event_id % 1200 end as lease_s,
               props as detail
        from {{events}}""",
    "v_event": """
        select event_id, user_id, event_type, value,
               cast(floor(value * 10) as bigint) + event_id % 500 as tokens, {ms} as ts_ms
        from {events}""",
    "v_candidate": """
        select chunk_id, file_id, heading_path, content, chunk_type from {v_chunk}""",
    "v_cache_vec": """
        select c.id, c.user_id, c.query, c.answer, c.query_hash, c.hit_count, c.updated_s, c.invalidated,
               e.embedding
        from {v_cache} c left join {embeddings} e on e.vec_id = c.conv_id""",
    "v_eval_result": """
        select user_id % 7 + 1 as run_id, event_id as question_id,
               case event_id % 4 when 0 then 'factual' when 1 then 'table' when 2 then 'cross_page' else 'refuse' end as dimension,
               case when event_id % 4 = 3 then null when value > 60 then null else cast(floor(value / 12) as bigint) + 1 end as hit_rank,
               case when event_id % 4 = 3 then null else value / 397.0 end as context_precision,
               case when event_id % 4 = 3 then event_type <> 'error' end as refused,
               case when event_id % 4 <> 3 and event_id % 2 = 0 then value / 503.0 end as faithfulness,
               case when event_id % 4 <> 3 and event_id % 2 = 0 then value / 449.0 end as relevancy
        from {events}""",
}

# what search asks of a file: v_user_file without its blob, whose join reads all texts again
_BLOBLESS = re.sub(r"b\.blob_id, md5\(d\.text\) as content_hash,\s*", "", BOTH["v_user_file"])
BOTH["v_search_file"] = _BLOBLESS[:_BLOBLESS.index("join (select md5")] + "where d.text is not null"

# name -> (Spark text, DuckDB text)
SPLIT: dict[str, tuple[str, str]] = {
    "v_doc3": (
        "select doc_id, cast(b as bigint) as b from {documents} lateral view explode(array(0, 1, 2)) t as b",
        "select doc_id, cast(unnest([0, 1, 2]) as bigint) as b from {documents}"),
    "v_line": (
        "select doc_id, lang, source, cast(pos as bigint) as idx, line from {documents} "
        "lateral view posexplode(split(text, '\\n')) t as pos, line",
        "select doc_id, lang, source, cast(unnest(range(len(l))) as bigint) as idx, unnest(l) as line "
        "from (select doc_id, lang, source, string_split(text, chr(10)) as l from {documents})"),
    "v_markdown": (
        """select doc_id, concat('# ', source, '\\n\\n', array_join(transform(split(text, '\\n'), (x, i) ->
              case (doc_id + i) % 11
                when 1 then concat('## ', x)
                when 2 then concat('### ', x)
                when 3 then concat('- ', x)
                when 4 then concat('| a | b |\\n|---|---|\\n| ', x, ' | 2 |\\n| ', x, ' | 3 |')
                when 5 then concat('```\\n', x, '\\n# no heading\\n```')
                when 6 then concat('  1. ', x)
                when 7 then concat('[', x, '](http://a.b/c) ', x)
                when 8 then concat('| ', x, ' |')
                else x end), '\\n\\n')) as text from {documents}""",
        """select doc_id, concat('# ', source, chr(10), chr(10), array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
              case (doc_id + i - 1) % 11
                when 1 then concat('## ', x)
                when 2 then concat('### ', x)
                when 3 then concat('- ', x)
                when 4 then concat('| a | b |', chr(10), '|---|---|', chr(10), '| ', x, ' | 2 |', chr(10), '| ', x, ' | 3 |')
                when 5 then concat('```', chr(10), x, chr(10), '# no heading', chr(10), '```')
                when 6 then concat('  1. ', x)
                when 7 then concat('[', x, '](http://a.b/c) ', x)
                when 8 then concat('| ', x, ' |')
                else x end), concat(chr(10), chr(10)))) as text from {documents}"""),
    # nodes with dirt: special blanks, control and zero-width characters, page and box
    "v_node": (
        """select doc_id as file_id, idx,
             case (doc_id + idx) % 9 when 0 then 'heading' when 4 then 'table' when 5 then 'code' when 6 then 'list'
                  when 7 then 'image' else 'paragraph' end as type,
             case (doc_id + idx) % 10
                when 0 then concat('  ', line, '\\u00a0 ')
                when 1 then concat(line, '\\r\\n', line)
                when 2 then concat('a\\u200bb  ', line, '\\n\\n\\n\\nend')
                when 3 then '[图片解析失败] timeout'
                when 4 then concat(char(7), line, '\\u3000x')
                when 5 then ' ... *** '
                when 6 then concat('page footer ', source)
                else line end as text,
             idx div 6 as page,
             case when (doc_id + idx) % 9 = 0 and idx % 2 = 0 then 1 + idx % 4 end as level,
             cast(10 + idx % 40 as double) as x0, cast((idx % 6) * 140 as double) as y0,
             cast(300 as double) as x1, cast((idx % 6) * 140 + 20 as double) as y1
           from {v_line}""",
        """select doc_id as file_id, idx,
             case (doc_id + idx) % 9 when 0 then 'heading' when 4 then 'table' when 5 then 'code' when 6 then 'list'
                  when 7 then 'image' else 'paragraph' end as type,
             case (doc_id + idx) % 10
                when 0 then concat('  ', line, chr(160), ' ')
                when 1 then concat(line, chr(13), chr(10), line)
                when 2 then concat('a', chr(8203), 'b  ', line, chr(10), chr(10), chr(10), chr(10), 'end')
                when 3 then '[图片解析失败] timeout'
                when 4 then concat(chr(7), line, chr(12288), 'x')
                when 5 then ' ... *** '
                when 6 then concat('page footer ', source)
                else line end as text,
             idx // 6 as page,
             case when (doc_id + idx) % 9 = 0 and idx % 2 = 0 then 1 + idx % 4 end as level,
             cast(10 + idx % 40 as double) as x0, cast((idx % 6) * 140 as double) as y0,
             cast(300 as double) as x1, cast((idx % 6) * 140 + 20 as double) as y1
           from {v_line}"""),
    "v_chunk": (
        """select doc_id * 100000 + idx as chunk_id, doc_id as file_id, idx + 1 as seq,
             case when idx % 9 = 4 then 'table' when idx % 9 = 7 then 'image' else 'paragraph' end as chunk_type,
             line as content, cast(length(line) as bigint) as chars,
             case when idx % 5 = 0 then '' else concat(source, ' > ', lang) end as heading_path,
             case when idx % 4 = 3 then null else idx div 6 end as page_no
           from {v_line} where line <> ''""",
        """select doc_id * 100000 + idx as chunk_id, doc_id as file_id, idx + 1 as seq,
             case when idx % 9 = 4 then 'table' when idx % 9 = 7 then 'image' else 'paragraph' end as chunk_type,
             line as content, cast(length(line) as bigint) as chars,
             case when idx % 5 = 0 then '' else concat(source, ' > ', lang) end as heading_path,
             case when idx % 4 = 3 then null else idx // 6 end as page_no
           from {v_line} where line <> ''"""),
    "v_qa_log": (
        """select event_id as id, user_id, concat('s-', cast(event_id % 40 as string)) as session_id,
             event_type as route, concat(event_type, ' ', props) as query,
             case when event_id % 9 = 0 then concat('资料中未找到相关内容 ', props)
                  else concat('answer ', repeat(props, 1 + cast(event_id % 90 as int))) end as answer,
             cast(floor(value * 100) as bigint) as total_ms, event_id % 500 as token_in, event_id % 300 as token_out,
             event_id % 4 = 0 as cache_hit, event_id % 9 = 0 as refused,
             case when event_id % 10 = 0 then cast(array() as array<bigint>)
                  else array((event_id % 900) * 100000, (event_id % 900) * 100000 + 2, (event_id * 7 % 800) * 100000 + 1) end as chunk_ids,
             date_format(ts, 'yyyy-MM-dd') as day
           from {events}""",
        """select event_id as id, user_id, concat('s-', cast(event_id % 40 as varchar)) as session_id,
             event_type as route, concat(event_type, ' ', props) as query,
             case when event_id % 9 = 0 then concat('资料中未找到相关内容 ', props)
                  else concat('answer ', repeat(props, 1 + event_id % 90)) end as answer,
             cast(floor(value * 100) as bigint) as total_ms, event_id % 500 as token_in, event_id % 300 as token_out,
             event_id % 4 = 0 as cache_hit, event_id % 9 = 0 as refused,
             case when event_id % 10 = 0 then cast([] as bigint[])
                  else [(event_id % 900) * 100000, (event_id % 900) * 100000 + 2, (event_id * 7 % 800) * 100000 + 1] end as chunk_ids,
             strftime(ts, '%Y-%m-%d') as day
           from {events}"""),
    "v_cache": (
        f"""select conv_id * 100 + pair_no as id, conv_id, conv_id % 23 as user_id, query, answer, md5(query) as query_hash,
             case when conv_id % 9 = 0 then cast(array() as array<bigint>) else array(conv_id, conv_id + 37) end as file_ids,
             conv_id % 5 as hit_count, {BASE_S} + conv_id * 10 + pair_no as updated_s, pair_no = 3 as invalidated
           from {{v_qa_pair}}""",
        f"""select conv_id * 100 + pair_no as id, conv_id, conv_id % 23 as user_id, query, answer, md5(query) as query_hash,
             case when conv_id % 9 = 0 then cast([] as bigint[]) else [conv_id, conv_id + 37] end as file_ids,
             conv_id % 5 as hit_count, {BASE_S} + conv_id * 10 + pair_no as updated_s, pair_no = 3 as invalidated
           from {{v_qa_pair}}"""),
    "v_block": (
        """select file_id, page as page_no, idx as ord,
             case type when 'table' then 'table' when 'image' then 'image' else 'text' end as kind,
             x0, y0, x1, case type when 'table' then y1 + 150 when 'image' then y1 + 290 else y1 end as y1,
             text, case when idx % 13 = 5 then 'failed' else 'ok' end as status,
             case when idx % 13 = 5 and idx % 2 = 0 then 'decoder error' end as error,
             case when type = 'image' then text end as text_in_image
           from {v_node}""", None),
}
SPLIT["v_block"] = (SPLIT["v_block"][0], SPLIT["v_block"][0])

EVENT_MS = ("unix_millis(cast(ts as timestamp))", "epoch_us(ts) // 1000")


def _texts(name: str) -> tuple[str, str]:
    if name in SPLIT:
        return SPLIT[name]
    text = BOTH[name]
    return text.replace("{ms}", EVENT_MS[0]), text.replace("{ms}", EVENT_MS[1])


def inline(sql: str) -> str:
    """DuckDB text with every ``{view}`` replaced by its definition and ``{table}`` by its name."""
    def swap(match: re.Match) -> str:
        name = match.group(1)
        if name in TABLES:
            return name
        if name in BOTH or name in SPLIT:
            return "(" + inline(_texts(name)[1]) + ")"
        return match.group(0)
    return re.sub(r"\{(\w+)\}", swap, sql)


class Inputs:
    """Tables and views of one scale factor as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            return spread(table, SPREAD_BY[name]) if name in SPREAD_BY else table
        if name == "v_golden":
            return self._golden
        return self.sql(_texts(name)[0])

    def sql(self, text: str) -> DataFrame:
        names = set(re.findall(r"\{(v_\w+|" + "|".join(TABLES) + r")\}", text))
        return self.spark.sql(text, **{n: self[n] for n in names})

    @cached_property
    def _golden(self) -> DataFrame:
        """One row per (question, document that holds the passage); a null document where none does."""
        from ..operators.textmatch import contains_join
        pairs = contains_join(self.benchmark.selectExpr("item_id as needle_id", "text as needle"),
                              self.documents.selectExpr("doc_id as hay_id", "text as hay"))
        return (self.benchmark.join(pairs, self.benchmark.item_id == pairs.needle_id, "left")
                .selectExpr("item_id as question_id", "text as question", "hay_id as expect_doc",
                            "case item_id % 4 when 0 then 'factual' when 1 then 'table' "
                            "when 2 then 'cross_page' else 'refuse' end as dimension"))


BOTH["v_golden"] = """
    select i.item_id as question_id, i.text as question, d.doc_id as expect_doc,
           case i.item_id % 4 when 0 then 'factual' when 1 then 'table' when 2 then 'cross_page' else 'refuse' end as dimension
    from {benchmark} i left join {documents} d on contains(d.text, i.text)"""
