"""Document structure queries (text and Markdown to nodes, page blocks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nodes as nd
from .registry import query

_WS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def duck_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def duck_rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{_WS}+$', '')"


@query("doc1_text_paragraphs", f"""
    select doc_id, row_number() over (partition by doc_id order by i) - 1 as idx, text from (
      select doc_id, unnest(range(len(p))) as i, {duck_strip('unnest(p)')} as text from (
        select doc_id, string_split(text, chr(10) || chr(10)) as p from {{v_markdown}})) where text <> ''""")
def _(fx):
    return nd.text_to_nodes(fx.v_markdown)


# nodes of any table ``doc_id, text`` put in place of {v_markdown}
MARKDOWN_SQL = f"""
    with l as (select doc_id, i, line, {duck_strip('line')} as s from (
                 select doc_id, unnest(range(len(p))) as i, unnest(p) as line from (
                   select doc_id, string_split(text, chr(10)) as p from {{v_markdown}}))),
    f as (select *, s like '```%' or s like '~~~%' as fence from l),
    c as (select *, count_if(fence) over (partition by doc_id order by i) as nf,
                 coalesce(lead(s) over (partition by doc_id order by i), '') as nxt from f),
    k as (select *, fence or nf % 2 = 1 as code,
                 not (fence or nf % 2 = 1) and regexp_matches(s, '^\\|.*\\|$') as is_row from c),
    t as (select *, is_row and (regexp_matches(s, '^[\\s:|\\-]+$')
                 or (contains(nxt, '|') and contains(nxt, '-') and regexp_matches(nxt, '^[\\s:|\\-]+$'))) as looks,
                 i - row_number() over (partition by doc_id, is_row order by i) as island from k),
    u as (select *, is_row and bool_or(looks) over (partition by doc_id, is_row, island order by i) as tab from t),
    g as (select *, case when code then 'c' || cast((nf + 1) // 2 as varchar) when tab then 't' || cast(island as varchar)
                         else 'l' || cast(i as varchar) end as unit from u where code or s <> ''),
    o as (select doc_id, unit, min(i) as i, bool_or(code) as code, bool_or(tab) as tab, string_agg(line, chr(10) order by i) as raw, min(s) as s
          from g group by doc_id, unit)
    select doc_id, row_number() over (partition by doc_id order by i) - 1 as idx,
      case when code then 'code' when tab then 'table' when regexp_matches(s, '^#{{1,6}}\\s+') then 'heading'
           when regexp_matches(raw, '^\\s*([-*+]|\\d+\\.)\\s+') then 'list' else 'paragraph' end as type,
      case when code or tab then raw when regexp_matches(s, '^#{{1,6}}\\s+') then regexp_extract(s, '^#{{1,6}}\\s+(.*)$', 1) else s end as text,
      case when not code and not tab and regexp_matches(s, '^#{{1,6}}\\s+') then length(regexp_extract(s, '^(#{{1,6}})', 1)) end as level
    from o"""


@query("doc2_markdown_nodes", MARKDOWN_SQL)
def _(fx):
    return nd.markdown_to_nodes(fx.v_markdown)


@query("doc3_markdown_sections", f"""
    select doc_id, page_no, {duck_strip('part')} as text from (
      select doc_id, unnest(range(len(p))) as page_no, unnest(p) as part from (
        select doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'),
          '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^(#{{1,2}}\\s)', chr(1) || '\\1', 'g'), chr(1)) as p from {{v_markdown}}))
    where {duck_strip('part')} <> ''""")
def _(fx):
    return nd.markdown_sections(fx.v_markdown)


_ELEMENTS = ("select file_id, idx, case when type = 'table' and idx % 2 = 0 then 'table' else 'para' end as type, "
             "case when idx % 40 >= 20 and idx % 40 < 40 and file_id % 3 = 0 then ' ' else text end as text from {v_node}")


@query("doc4_paginate", f"""
    with e as (select *, {duck_strip('text')} as body from ({_ELEMENTS})),
    p as (select file_id, idx // 20 as slot, coalesce(string_agg(body || chr(10), '' order by idx) filter (where type <> 'table' and body <> ''), '') as text,
                 cast(count_if(type = 'table') as bigint) as tables from e group by file_id, idx // 20)
    select file_id, row_number() over (partition by file_id order by slot) - 1 as page_no, text, tables from p where text <> '' or tables > 0""")
def _(fx):
    return nd.paginate(fx.sql(_ELEMENTS))


@query("doc5_rows_to_markdown", """
    with r as (select l_orderkey as table_id, l_linenumber * 1000000 + l_partkey as row_no,
                      case when l_linenumber % 3 = 0 then [l_returnflag] when l_linenumber % 3 = 1 then [l_returnflag, l_linestatus, cast(l_partkey as varchar)]
                           else ['', ''] end as cells from {lineitem}),
    f as (select * from r where list_aggregate(list_transform(cells, lambda c: c <> ''), 'bool_or')),
    w as (select *, max(len(cells)) over (partition by table_id) as w, row_number() over (partition by table_id order by row_no, cells) as n from f),
    s as (select table_id, n, w, '| ' || array_to_string(list_concat(cells, list_transform(range(w - len(cells)), lambda x: '')), ' | ') || ' |' as line from w)
    select table_id, string_agg(case when n = 1 then line || chr(10) || '|' || array_to_string(list_transform(range(w), lambda x: '---'), '|') || '|' else line end,
                                chr(10) order by n) as markdown from s group by table_id""")
def _(fx):
    rows = fx.lineitem.selectExpr(
        "l_orderkey as table_id", "l_linenumber * 1000000 + l_partkey as row_no",
        "case when l_linenumber % 3 = 0 then array(l_returnflag) when l_linenumber % 3 = 1 "
        "then array(l_returnflag, l_linestatus, cast(l_partkey as string)) else array('', '') end as cells")
    return nd.rows_to_markdown(rows, drop_blank=True)


@query("doc6_drop_headers_footers", f"""
    with l as (select file_id, idx, {duck_strip('unnest(string_split(text, chr(10)))')} as line from {{v_node}}),
    solid as (select * from l where line <> ''),
    one as (select file_id, idx, min(line) as line from solid group by file_id, idx having count(*) = 1),
    e as (select file_id, count(distinct page) as pages, max(y1) as h from {{v_node}} group by file_id),
    noisy as (select s.file_id, s.line, e.h from (select file_id, line, count(*) as n from solid group by file_id, line) s
              join e on e.file_id = s.file_id where s.n >= greatest(2, e.pages * 0.5))
    select n.file_id, n.idx, n.text from {{v_node}} n
    where not exists (select 1 from one o join noisy z on z.file_id = o.file_id and z.line = o.line
                      where o.file_id = n.file_id and o.idx = n.idx and (n.y0 < z.h * 0.07 or n.y1 > z.h * 0.93))""")
def _(fx):
    return nd.drop_headers_footers(fx.v_node).select("file_id", "idx", "text")


_BROKEN = ("select file_id, idx, page, type, case when idx % 5 = 1 then replace(text, '. ', '.{nl}') when idx % 5 = 3 then concat(text, '。') "
           "when idx % 7 = 2 then concat('  ', text) else text end as text from {v_node}")


def _letters(left: str, right: str) -> str:
    return f"case when regexp_matches({left}, '[A-Za-z]$') and regexp_matches({right}, '^[A-Za-z]') then ' ' else '' end"


_INNER = f"""case when type = 'paragraph' and contains(text, chr(10)) then list_reduce(
      list_transform(string_split(text, chr(10)), lambda l: {duck_strip('l')}),
      lambda a, x: case when x = '' or (a <> '' and contains('{nd.SENTENCE_END}', right(a, 1))) then a || chr(10) || x
                        else a || {_letters('a', 'x')} || x end) else text end"""


@query("doc7_merge_broken_lines", f"""
    with n as (select *, {duck_strip('text')} as t from ({_BROKEN.replace("'.{nl}'", "'.' || chr(10)")})),
    p as (select *, lag(type) over w as ptype, lag(page) over w as ppage, lag(t) over w as pt from n window w as (partition by file_id order by idx)),
    j as (select *, coalesce(type = 'paragraph' and ptype = 'paragraph' and page = ppage and pt <> '' and not contains('{nd.SENTENCE_END}', right(pt, 1))
                             and t <> '' and not regexp_matches(text, '^[ \t　]'), false) as joins from p),
    g as (select *, sum(case when joins then 0 else 1 end) over (partition by file_id order by idx) as grp, {_INNER} as inner_text from j),
    q as (select *, case when joins then {_letters('pt', 't')} || t else inner_text end as piece, count(*) over (partition by file_id, grp) as members,
                 not joins and len(string_split(text, chr(10))) > len(string_split(inner_text, chr(10))) as changed from g)
    select file_id, min(idx) as idx, arg_min(type, idx) as type, arg_min(page, idx) as page,
      string_agg(case when not joins and members > 1 then {duck_rstrip('piece')} else piece end, '' order by idx) as text,
      bool_or(changed) or count(*) > 1 as joined
    from q group by file_id, grp""")
def _(fx):
    return nd.merge_broken_lines(fx.sql(_BROKEN.replace("{nl}", "\\n")))


_BLOCKS = "select file_id, page_no, ord, kind, x0, y0, x1, y1, text from {v_block}"


@query("doc8_resolve_blocks", f"""
    with b as ({_BLOCKS}),
    i as (select t.file_id, t.page_no, t.ord, t.text, c.kind as c_kind, c.ord as c_ord,
                 row_number() over (partition by t.file_id, t.page_no, t.ord order by case c.kind when 'table' then 0 else 1 end, c.ord) as rn
          from b t join b c on c.file_id = t.file_id and c.page_no = t.page_no and t.kind = 'text' and c.kind in ('table', 'image')
           and c.x0 - 2 <= t.x0 and c.y0 - 2 <= t.y0 and c.x1 + 2 >= t.x1 and c.y1 + 2 >= t.y1),
    own as (select * from i where rn = 1),
    cap as (select file_id, page_no, c_ord, string_agg(text, ' ' order by ord) as t from own where c_kind = 'image' group by file_id, page_no, c_ord),
    k as (select b.*, coalesce(cap.t, '') as cap from b left join cap on cap.file_id = b.file_id and cap.page_no = b.page_no and cap.c_ord = b.ord
          where not exists (select 1 from own o where o.file_id = b.file_id and o.page_no = b.page_no and o.ord = b.ord))
    select file_id, page_no, ord, kind, case when kind = 'text' then text else cap end as text,
      row_number() over (partition by file_id, page_no order by round_even(y0 / 30, 0), x0, case kind when 'table' then 0 when 'image' then 1 else 2 end, ord) - 1 as pos
    from k""")
def _(fx):
    return nd.resolve_blocks(fx.sql(_BLOCKS)).select("file_id", "page_no", "ord", "kind", "text", "pos")


@query("doc9_page_channel", f"""
    with b as ({_BLOCKS}),
    sw as (select distinct t.file_id, t.page_no, t.ord from b t join b c on c.file_id = t.file_id and c.page_no = t.page_no and t.kind = 'text'
           and c.kind in ('table', 'image') and c.x0 - 2 <= t.x0 and c.y0 - 2 <= t.y0 and c.x1 + 2 >= t.x1 and c.y1 + 2 >= t.y1),
    p as (select file_id, page_no, coalesce(sum(case when kind = 'text' then length({duck_strip('text')}) end), 0) as chars, bool_or(kind = 'image') as any_image
          from b group by file_id, page_no),
    l as (select file_id, page_no, bool_or(kind = 'table') as t, bool_or(kind = 'image') as m, bool_or(kind = 'text') as x from b
          where (file_id, page_no, ord) not in (select (file_id, page_no, ord) from sw) group by file_id, page_no)
    select p.file_id, p.page_no, case when chars < 50 then 'C' when m and x then 'M' when t then 'B' when x then 'A' else 'C' end as channel,
      case when chars < 50 and not any_image then 'skipped' else 'ok' end as page_status
    from p join l on l.file_id = p.file_id and l.page_no = p.page_no""")
def _(fx):
    return nd.page_channel(fx.sql(_BLOCKS))


_BOXES = """select l_orderkey % 500 as file_id, l_suppkey % 9 as page_no, l_orderkey * 10 + l_linenumber as ord,
    l_quantity * 10 - 30 as x0, l_discount * 4000 - 5 as y0, l_quantity * 10 - 30 + l_tax * 9000 - 40 as x1,
    l_discount * 4000 + l_quantity * 12 - 30 as y1, 595.0 as page_w, 842.0 as page_h from {lineitem}"""


@query("doc10_image_candidates", f"""
    select file_id, page_no, ord, rank from (
      select *, row_number() over (partition by file_id, page_no order by y0, x0, ord) as rank from ({_BOXES.replace('595.0', '595.0::double').replace('842.0', '842.0::double')})
      where x1 - x0 > 0 and y1 - y0 > 0 and x0 >= -1 and y0 >= -1 and x1 - x0 <= page_w * 2 and y1 - y0 <= page_h * 2
        and (x1 - x0) * (y1 - y0) >= page_w * page_h * 0.02::double) where rank <= 8""")
def _(fx):
    boxes = fx.sql(_BOXES).withColumns({"page_w": F.lit(595.0), "page_h": F.lit(842.0)})
    return nd.image_candidates(boxes).select("file_id", "page_no", "ord", "rank")


@query("doc11_blocks_to_pages", """
    select file_id, page_no, coalesce(string_agg(text, chr(10) order by ord) filter (where kind = 'text' and status = 'ok'), '') as text,
      coalesce(string_agg(text, '@@' order by ord) filter (where kind = 'table' and status = 'ok'), '') as tables,
      coalesce(string_agg(text || '//' || coalesce(text_in_image, ''), '@@' order by ord) filter (where kind = 'image' and status = 'ok'), '') as images
    from {v_block} group by file_id, page_no""")
def _(fx):
    return nd.blocks_to_pages(fx.v_block).select(
        "file_id", "page_no", "text", F.array_join("tables", "@@").alias("tables"),
        F.array_join(F.transform("images", lambda i: F.concat(i["description"], F.lit("//"), i["text_in_image"])), "@@").alias("images"))


def _duck_fragment() -> str:
    desc = duck_strip("case when text = '' then '图' else text end")
    return f"""case when status <> 'ok' then '<!-- 第' || ord || '块(' || kind || ')识别失败：' || {duck_strip('coalesce(error, status)')} || ' -->'
        when kind = 'image' then '![图' || n || '：' || case when {desc} = '' then '图' || n else {desc} end || ']'
             || case when coalesce(text_in_image, '') <> '' then chr(10) || '> 图中文字：' || substring(text_in_image, 1, 300) else '' end
        else {duck_rstrip('text')} end || chr(10)"""


@query("doc12_render_markdown", f"""
    with f as (select file_id, page_no, ord, {_duck_fragment()} as frag from (
        select *, row_number() over (partition by file_id, page_no order by ord) as n from {{v_block}})),
    p as (select file_id, page_no, {duck_strip("string_agg(frag, chr(10) order by ord)")} || chr(10) as md from f group by file_id, page_no)
    select file_id, {duck_strip("string_agg(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '<!-- page ' || page_no || ' -->' || chr(10) || chr(10) || md, chr(10) order by page_no)")}
      || chr(10) as markdown from p group by file_id""")
def _(fx):
    return nd.render_document(fx.v_block)


_NEW_NODES = """select file_id, page, 'paragraph' as type, concat('new ', text) as text, idx from {v_node}
    where page = case when file_id % 4 = 0 then 1 when file_id % 4 = 1 then 0 else 2 end"""
_NEW_PAGE = "select file_id, case when file_id % 3 = 0 then 77 else page end as page, type, text, idx from (" + _NEW_NODES + ")"


@query("doc13_replace_page", f"""
    with n as ({_NEW_PAGE}), o as (select file_id, idx, page, type, text from {{v_node}}),
    t as (select distinct file_id, page from n),
    pl as (select o.file_id, min(case when o.page = t.page then o.idx end) as at, max(o.idx) as last from o join t on t.file_id = o.file_id group by o.file_id),
    u as (select file_id, page, type, text, idx as a, 0 as b from o where (file_id, page) not in (select (file_id, page) from t)
          union all select n.file_id, n.page, n.type, n.text, coalesce(pl.at, pl.last + 1, 0), n.idx from n left join pl on pl.file_id = n.file_id)
    select file_id, row_number() over (partition by file_id order by a, b) - 1 as idx, page, type, text from u""")
def _(fx):
    return nd.replace_page(fx.v_node.select("file_id", "idx", "page", "type", "text"), fx.sql(_NEW_PAGE))
