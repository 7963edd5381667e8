"""Sources, sinks, file ledger, task and issue ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import files as fil
from ..operators import ledger, tasks
from ..session import ensure_checkpoint_dir
from ..sources import files as src
from ..sources import tables
from .inputs import NOW_S
from .registry import query


def new_root(fx, name: str) -> str:
    """A new folder beside the checkpoints for what a query writes and reads back."""
    return f"{ensure_checkpoint_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources

_RAW = "regexp_replace(text, '[^ -~]', '?'{g})"


@query("src1_decode_text", f"""
    select doc_id, case doc_id % 4 when 0 then text when 1 then '你好' || {_RAW.format(g=", 'g'")} when 2 then replace(text, ' ', chr(10)) end as text,
      case when doc_id % 4 = 3 then 'encoding not recognised' end as error from {{documents}}""")
def _(fx):
    """UTF-8 with a byte order mark, GBK, foreign line ends and bytes of no encoding."""
    raw = fx.sql(f"""select doc_id, case doc_id % 4 when 0 then unhex('EFBBBF') || encode(text, 'UTF-8')
        when 1 then unhex('C4E3BAC3') || encode({_RAW.format(g='')}, 'UTF-8') when 2 then encode(replace(text, ' ', '\r\n'), 'UTF-8')
        else unhex('FFFEFF20FF') end as content from {{documents}}""")
    return src.decode_text(raw).select("doc_id", "text", "error")


@query("src1_read_text_files", """
    select source, cast(sum(length(text) + 1) as bigint) as chars, cast(sum(len(string_split(text, chr(10)))) as bigint) as lines
    from {documents} group by source""")
def _(fx):
    """Texts written to files first, a folder per source, and read back as files."""
    root = new_root(fx, "texts")
    fx.documents.select("source", "text").write.partitionBy("source").text(root)
    files = src.read_text_files(fx.spark, root, "*.txt").filter("error is null")
    return files.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg(
        F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n")) - 1).cast("bigint").alias("lines"))


@query("src2_load_relation", """
    select o_orderkey as id, o_custkey as user_id, o_orderstatus as action, o_orderpriority as target, cast(o_orderkey % 900 as bigint) as elapsed_ms
    from {orders}""")
def _(fx):
    """A stored relation read through its fixed schema; the column that is not stored comes back empty."""
    root = new_root(fx, "relations")
    fx.sql("select o_orderkey as id, o_custkey as user_id, o_orderstatus as action, o_orderpriority as target, o_orderkey % 900 as elapsed_ms, "
           "'x' as not_declared from {orders}").write.parquet(f"{root}/audit_log")
    return tables.load(fx.spark, root, "audit_log").filter("created_at is null").drop("created_at")


@query("src3_read_questions", """
    select cast(item_id as varchar) as id, text as question, case item_id % 4 when 0 then 'factual' else 'table' end as dimension, item_id % 3 = 0 as in_regression
    from {benchmark}""")
def _(fx):
    """Sets of eight questions written as JSON files, wrapped ones and bare arrays, and read back."""
    root = new_root(fx, "questions")
    body = "struct(cast(item_id as string) as id, text as question, if(item_id % 4 = 0, 'factual', 'table') as dimension, item_id % 3 = 0 as in_regression)"
    sets = fx.benchmark.groupBy(F.expr("item_id div 8").alias("part")).agg(F.collect_list(F.expr(body)).alias("questions"))
    text = F.when(F.col("part") % 2 == 0, F.to_json(F.struct("questions"))).otherwise(F.to_json("questions"))
    sets.select("part", text.alias("value")).write.partitionBy("part").text(root)
    return src.read_questions(fx.spark, f"{root}/part=*").select("id", "question", "dimension", "in_regression")


@query("src2_load_tables", """
    select owner_type, cast(status as bigint) as status, count(*) as files, cast(sum(file_size) as bigint) as bytes
    from {v_user_file} group by owner_type, status""")
def _(fx):
    return fx.v_user_file.groupBy("owner_type", F.col("status").cast("bigint").alias("status")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"))


@query("src4_type_gate", """
    select id, e as ext, e in ('txt','md','pdf','docx','xlsx','pptx','png','jpg','jpeg','webp') as type_ok
    from (select id, lower(regexp_extract(n, '\\.([A-Za-z0-9]{1,10})$', 1)) as e from (
      select id, case when file_size % 5 = 0 then replace(filename, '.md', '.exe') else filename end as n from {v_user_file}))""")
def _(fx):
    names = fx.v_user_file.selectExpr(
        "id", "case when file_size % 5 = 0 then replace(filename, '.md', '.exe') else filename end as filename")
    return src.with_file_type(names).select("id", "ext", "type_ok")


_MAGIC_VIEW = """
    select id, ext, case id % 5 when 0 then {pdf} when 1 then {late} when 2 then {zip} when 3 then {png} else body end as content
    from (select f.id, lower(regexp_extract(f.filename, '[.]([a-z0-9]+)$', 1)) as ext, {body} as body
          from {{v_user_file}} f join {{documents}} d on f.id = d.doc_id)"""
_MAGIC_SPARK = _MAGIC_VIEW.format(
    body="encode(d.text, 'UTF-8')", pdf="concat(x'255044462D', body)", late="concat(x'0A0A', x'255044462D', body)",
    zip="concat(x'504B0304', body)", png="concat(x'89504E47', body)").replace("{{", "{").replace("}}", "}")
_MAGIC_DUCK = _MAGIC_VIEW.format(
    body="hex(encode(d.text))", pdf="'255044462D' || body", late="'0A0A255044462D' || body",
    zip="'504B0304' || body", png="'89504E47' || body").replace("{{", "{").replace("}}", "}")


@query("src5_magic_strict", f"""
    select id, ext, case ext when 'pdf' then starts_with(content, '25504446') when 'docx' then starts_with(content, '504B0304')
           else true end as magic_ok from ({_MAGIC_DUCK})""")
def _(fx):
    return src.with_magic_ok(fx.sql(_MAGIC_SPARK), mode="strict").select("id", "ext", "magic_ok")


@query("src5_magic_scan", f"""
    select id, ext, case ext when 'pdf' then contains(content[1:2048], '255044462D') when 'docx' then starts_with(content, '504B0304')
           else true end as magic_ok from ({_MAGIC_DUCK})""")
def _(fx):
    return src.with_magic_ok(fx.sql(_MAGIC_SPARK), mode="scan").select("id", "ext", "magic_ok")


@query("src6_size_gate", """
    select id, size, ext, size > 0 and size <= 52428800 and not (ext in ('png','jpg','jpeg','webp') and size > 20971520) as size_ok
    from (select l_orderkey * 10 + l_linenumber as id, cast(floor(l_extendedprice * 600) as bigint) as size,
                 case l_returnflag when 'A' then 'png' when 'N' then 'pdf' else 'webp' end as ext from {lineitem})""")
def _(fx):
    sized = fx.lineitem.selectExpr(
        "l_orderkey * 10 + l_linenumber as id", "cast(floor(l_extendedprice * 600) as bigint) as size",
        "case l_returnflag when 'A' then 'png' when 'N' then 'pdf' else 'webp' end as ext")
    return src.with_size_ok(sized, "size")


# ---------------------------------------------------------------- sinks

_NEW_CHUNKS = ("select chunk_id + 50000 as chunk_id, file_id, seq, chunk_type, concat('new ', content) as content, chars, "
               "heading_path, page_no from {v_chunk} where heading_path = ''")


@query("snk1_replace_chunks", f"""
    select chunk_id, file_id, seq, content from {{v_chunk}} where file_id not in (select file_id from ({_NEW_CHUNKS}))
    union all select chunk_id, file_id, seq, content from ({_NEW_CHUNKS})""")
def _(fx):
    cols = ["chunk_id", "file_id", "seq", "content"]
    return ledger.replace_by_key(fx.v_chunk.select(*cols), fx.sql(_NEW_CHUNKS).select(*cols), "file_id")


_UPDATES = """select d.doc_id as file_id, u.seq, concat(d.lang, cast(u.seq as varchar(20))) as status, u.attempt
    from {documents} d join (select o_custkey as doc_id, o_orderkey as seq, o_orderkey % 4 as attempt from {orders}) u on u.doc_id = d.doc_id"""


@query("snk2_upsert_tasks", f"""
    with last as (select * from (select *, row_number() over (partition by file_id order by seq desc) as rn from ({_UPDATES})) where rn = 1)
    select coalesce(b.file_id, u.file_id) as file_id,
           case when u.file_id is not null then u.status else b.status end as status,
           case when b.file_id is not null then b.attempt else u.attempt end as attempt, b.updated_s
    from {{v_parse_task}} b full join last u on b.file_id = u.file_id""")
def _(fx):
    return ledger.upsert(fx.v_parse_task, fx.sql(_UPDATES.replace("varchar(20)", "string")), ["file_id"], ["status"], ["seq"])


@query("snk3_insert_ignore", f"""
    select file_id, status from {{v_parse_task}}
    union all
    select file_id, status from (select file_id, status, row_number() over (partition by file_id order by seq) as rn from ({_UPDATES}))
    where rn = 1 and file_id not in (select file_id from {{v_parse_task}})""")
def _(fx):
    return ledger.insert_ignore(fx.v_parse_task.select("file_id", "status"),
                                fx.sql(_UPDATES.replace("varchar(20)", "string")).select("file_id", "status", "seq"),
                                ["file_id"], ["seq"])


@query("snk4_audit_rows", """
    select id, user_id, day, substring(answer, 1, 500) as target from {v_qa_log}""")
def _(fx):
    return ledger.audit_rows(fx.v_qa_log.select("id", "user_id", "day", F.col("answer").alias("target")))


@query("snk5_artefact_preview", """
    select f.id as file_id, coalesce(string_agg(n.text || chr(10) || chr(10), '' order by n.idx), '') as preview,
           count(n.idx) as node_count
    from {v_user_file} f left join {v_node} n on n.file_id = f.id group by f.id""")
def _(fx):
    status = fx.v_user_file.selectExpr("id as file_id", "status")
    return ledger.preview(ledger.to_artefacts(fx.v_node, status))


# ---------------------------------------------------------------- file ledger


@query("fil1_build_blobs", """
    select content_hash, min(id) as first_file_id, arg_min(user_id, id) as owner_user_id, arg_min(file_size, id) as file_size,
           count(*) as ref_count
    from (select doc_id as id, doc_id % 23 as user_id, n_chars as file_size, sha256(text) as content_hash from {documents})
    group by content_hash""")
def _(fx):
    return fil.build_blobs(fx.documents.selectExpr("doc_id as id", "doc_id % 23 as user_id", "n_chars as file_size",
                                                   "sha2(text, 256) as content_hash"))


@query("fil2_instant_match", """
    with b as (select content_hash, min(id) as blob_id, arg_min(file_size, id) as file_size from {v_user_file} group by content_hash)
    select r.id, b.blob_id, b.blob_id is not null as instant
    from (select doc_id as id, md5(text) as content_hash, n_chars + case when lang = 'fr' then 1 else 0 end as file_size from {documents}) r
    left join b on b.content_hash = r.content_hash and b.file_size = r.file_size""")
def _(fx):
    requests = fx.documents.selectExpr("doc_id as id", "md5(text) as content_hash",
                                       "n_chars + case when lang = 'fr' then 1 else 0 end as file_size")
    return fil.instant_match(requests, fil.build_blobs(fx.v_user_file)).select("id", "blob_id", "instant")


@query("fil3_list_files", """
    select * from (
      select f.user_id, row_number() over (partition by f.user_id order by f.id desc) as pos, f.id, f.filename,
             coalesce(t.status, 'pending') as parse_status, coalesce(i.n, 0) as open_issues,
             count(*) over (partition by f.user_id) as total
      from {v_user_file} f left join {v_parse_task} t on t.file_id = f.id
      left join (select file_id, count(*) as n from {v_issue} where status in ('pending','retrying','failed') group by file_id) i on i.file_id = f.id
      where f.status = 1 and f.owner_type = 'personal') where pos > 10 and pos <= 20""")
def _(fx):
    return fil.list_files(fx.v_user_file, fx.v_parse_task, fx.v_issue, page=2, size=10)


@query("fil4_list_dirs", """
    select cast(n.n_nationkey as bigint) as dir_id, n.n_name as name, coalesce(c.n, 0) as file_count, coalesce(c.n, 0) = 0 as deletable
    from {nation} n left join (select dir_id, count(*) as n from {v_user_file} where status = 1 group by dir_id) c on c.dir_id = n.n_nationkey""")
def _(fx):
    dirs = fx.nation.selectExpr("cast(n_nationkey as bigint) as dir_id", "n_name as name")
    return fil.list_dirs(dirs, fx.v_user_file)


@query("fil5_list_trash", "select user_id, id, filename, deleted_s from {v_user_file} where status = 0")
def _(fx):
    return fil.list_trash(fx.v_user_file)


@query("fil6_quota", """
    select u.session_id, u.user_id, coalesce(s.used, 0) as used, coalesce(s.used, 0) + u.new_size <= 2147483648 as accepted
    from (select o_orderkey as session_id, o_custkey % 40 as user_id, cast(floor(o_totalprice) as bigint) * 3000 as new_size from {orders}) u
    left join (select user_id, cast(sum(file_size * 10000) as bigint) as used from {v_user_file} where status = 1 group by user_id) s
      on s.user_id = u.user_id""")
def _(fx):
    uploads = fx.orders.selectExpr("o_orderkey as session_id", "o_custkey % 40 as user_id",
                                   "cast(floor(o_totalprice) as bigint) * 3000 as new_size")
    return fil.quota(fx.v_user_file.withColumn("file_size", F.col("file_size") * 10000), uploads).select(
        "session_id", "user_id", "used", "accepted")


_KEPT = """select * from {v_user_file} u where not exists (
    select 1 from {v_user_file} w where w.user_id = u.user_id and w.filename = u.filename
      and (w.status > u.status or (w.status = u.status and w.id < u.id)))"""


@query("fil7_converge_names", f"select id, user_id, filename, cast(status as bigint) as status from ({_KEPT})")
def _(fx):
    return fil.converge_names(fx.v_user_file).select("id", "user_id", "filename", F.col("status").cast("bigint").alias("status"))


@query("fil7_cascade_chunks", f"select file_id, count(*) as chunks from {{v_chunk}} where file_id in (select id from ({_KEPT})) group by file_id")
def _(fx):
    return fil.cascade(fx.v_chunk, fil.converge_names(fx.v_user_file)).groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("fil7_name_conflicts", """
    select w.id as file_id, w.user_id, w.filename, min(h.id) as holder_id from {v_user_file} w
    join {v_user_file} h on h.user_id = w.user_id and h.filename = w.filename and h.status = 1 and h.id <> w.id
    group by w.id, w.user_id, w.filename""")
def _(fx):
    return fil.name_conflicts(fx.v_user_file, fx.v_user_file.selectExpr("id as file_id", "user_id", "filename"))


@query("fil8_upload_status", """
    with p as (select * from (select *, row_number() over (partition by session_id, chunk_index order by part_id desc, chunk_size desc) as rn
                              from {v_upload_part}) where rn = 1),
         s as (select session_id, count(*) as n, cast(sum(chunk_size) as bigint) as size,
                      string_agg(cast(chunk_index as varchar), ',' order by chunk_index) as uploaded from p group by session_id),
         b as (select user_id, count(*) as open_n from {v_upload_session} where status = 'uploading' group by user_id)
    select u.session_id, u.user_id, coalesce(s.n, 0) as received, coalesce(s.uploaded, '') as uploaded,
           case when u.status = 'completed' then 'already completed' when coalesce(s.n, 0) <> u.chunk_count then 'parts missing'
                when coalesce(s.size, 0) <> u.file_size then 'size differs' else 'complete' end as state,
           coalesce(b.open_n, 0) < 4 as may_open
    from {v_upload_session} u left join s on s.session_id = u.session_id left join b on b.user_id = u.user_id""")
def _(fx):
    return fil.upload_status(fx.v_upload_session, fx.v_upload_part)


_CHANGES = """select c.file_id, c.seq, c.op, case c.op when 'rename' then concat('n', cast(c.seq as varchar(20)), '.md')
        when 'move' then cast(c.seq % 6 as varchar(20)) end as arg, 1704067200 + c.seq as at_s
    from (select o_custkey % 997 as file_id, o_orderkey as seq,
            case o_orderkey % 7 when 0 then 'delete' when 1 then 'restore' when 2 then 'move' when 3 then 'rename' when 4 then 'delete'
                                when 5 then 'restore' else case when o_orderkey % 5 = 0 then 'purge' else 'move' end end as op
          from {orders}) c"""


@query("fil9_apply_changes", f"""
    with recursive f as (select id, user_id, blob_id, filename, dir_id, cast(status as bigint) as status, deleted_s from {{v_user_file}}),
    b as (select distinct blob_id from {{v_user_file}} where dir_id is not null or status = 1),
    c as (select c.*, row_number() over (partition by c.file_id order by c.seq) as n,
                 (select blob_id from f where f.id = c.file_id) in (select blob_id from b) as has_blob from ({_CHANGES}) c
          where c.file_id in (select id from f)),
    r as (select id, user_id, filename, cast(dir_id as bigint) as dir_id, status, deleted_s, false as gone, cast(0 as bigint) as n from f
          union all
          select r.id, r.user_id,
            case when not r.gone and r.status = 1 and c.op = 'rename' then c.arg else r.filename end,
            case when not r.gone and r.status = 1 and c.op = 'move' then cast(c.arg as bigint) else r.dir_id end,
            case when r.gone then r.status when r.status = 1 and c.op = 'delete' then 0
                 when r.status = 0 and c.op = 'restore' and c.has_blob then 1 else r.status end,
            case when r.gone then r.deleted_s when r.status = 1 and c.op = 'delete' then c.at_s
                 when r.status = 0 and c.op = 'restore' and c.has_blob then null else r.deleted_s end,
            r.gone or (r.status = 0 and c.op = 'purge'), r.n + 1
          from r join c on c.file_id = r.id and c.n = r.n + 1)
    select id, user_id, filename, dir_id, status, deleted_s from (
      select *, row_number() over (partition by id order by n desc) as rn from r) where rn = 1 and not gone""")
def _(fx):
    blobs = fx.v_user_file.filter("dir_id is not null or status = 1").select("blob_id").distinct()
    return fil.apply_file_changes(fx.v_user_file, fx.sql(_CHANGES.replace("varchar(20)", "string")), blobs)


@query("fil10_expired_trash", f"select id, deleted_s from {{v_user_file}} where status = 0 and deleted_s < {NOW_S + 86400} - 2592000")
def _(fx):
    return fil.expired_trash(fx.v_user_file, NOW_S + 86400).select("id", "deleted_s")


_SESSIONS = f"select session_id, status, {NOW_S} - session_id % 9000 as updated_s from {{v_upload_session}}"


@query("fil10_expired_sessions", f"""
    select s.session_id, count(p.part_id) as lost_parts from ({_SESSIONS}) s left join {{v_upload_part}} p on p.session_id = s.session_id
    where s.status = 'uploading' and s.updated_s < {NOW_S} - 3600 group by s.session_id""")
def _(fx):
    gone = fil.expired_sessions(fx.sql(_SESSIONS), NOW_S)
    parts = fx.v_upload_part.groupBy("session_id").agg(F.count("part_id").alias("n"))
    return gone.join(parts, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("lost_parts"))


_BLOBS = """select b.blob_id, b.n + case when b.blob_id % 5 = 0 then 1 else 0 end as ref_count
    from (select blob_id, count(*) as n from {v_user_file} group by blob_id
          union all select 10000000 + s_suppkey as blob_id, 0 as n from {supplier}) b"""


@query("fil11_audit_blobs", f"""
    select b.blob_id, b.ref_count as declared, coalesce(a.n, 0) as actual,
           case when coalesce(a.n, 0) = 0 then 'drop' when a.n <> b.ref_count then 'fix' else 'keep' end as action
    from ({_BLOBS}) b left join (select blob_id, count(*) as n from {{v_user_file}} group by blob_id) a on a.blob_id = b.blob_id""")
def _(fx):
    return fil.audit_blobs(fx.sql(_BLOBS), fx.v_user_file)


_LISTING = f"""select concat(case when l_linenumber = 1 then '/data/.upload-tmp/' else '/data/' end, cast(l_orderkey as varchar(20)), '/',
        cast(l_partkey as varchar(20))) as path, cast(l_partkey as varchar(20)) as stored_name, {NOW_S} - l_orderkey % 7200 as modified_s from {{lineitem}}"""
_STORED = "select cast(p_partkey as varchar(20)) as stored_name from {part} where p_size <= 40"


@query("fil12_orphans", f"""
    select path, stored_name, modified_s, 'stale temp' as reason from ({_LISTING}) where contains(path, '/.upload-tmp/') and modified_s < {NOW_S} - 3600
    union all select path, stored_name, modified_s, 'unknown file' as reason from ({_LISTING})
    where not contains(path, '/.upload-tmp/') and stored_name not in (select stored_name from ({_STORED}))""")
def _(fx):
    return fil.orphans(fx.sql(_LISTING.replace("varchar(20)", "string")), fx.sql(_STORED.replace("varchar(20)", "string")), NOW_S)


@query("fil13_document_status", """
    select f.id, f.filename, case t.status when 'success' then '已入库' when 'partial' then '已入库' when 'done' then '已入库'
                                           when 'failed' then '失败' else '处理中' end as status,
           coalesce(c.n, 0) as chunk_count, f.file_size, f.created_s
    from {v_user_file} f left join {v_parse_task} t on t.file_id = f.id
    left join (select file_id, count(*) as n from {v_chunk} group by file_id) c on c.file_id = f.id where f.status = 1""")
def _(fx):
    return fil.document_status(fx.v_user_file, fx.v_parse_task, fx.v_chunk)


_NAMES = """select page_id as id, case page_id % 6 when 0 then concat(url, '/') when 1 then replace(url, '/', '\\\\') when 2 then '  '
        when 3 then concat(html, '.md') when 4 then concat('été ü', page_id) else '..' end as raw from {pages}"""


@query("fil14_clean_filename", """
    select id, case when trim(raw) = '' or trim(safe) = '' or safe in ('.', '..') then 'unnamed' else right(safe, 255) end as filename
    from (select id, raw, regexp_replace(regexp_extract(regexp_replace(nfc_normalize(raw), '/+$', ''), '([^/]*)$', 1), '[\\x00-\\x1f\\\\/:*?"<>|]', '_', 'g') as safe
          from (""" + _NAMES.replace("'\\\\'", "chr(92)") + "))")
def _(fx):
    raw = fx.sql(_NAMES.replace("'\\\\'", "char(92)"))
    return raw.select("id", fil.clean_filename("raw").alias("filename"))


@query("fil15_org_status", """
    select f.org_id, f.id, coalesce(t.status, 'queued') as state from {v_user_file} f
    left join {v_parse_task} t on t.file_id = f.id where f.owner_type = 'org' and f.status = 1""")
def _(fx):
    return fil.org_status(fx.v_user_file, fx.v_parse_task)


# ---------------------------------------------------------------- tasks, jobs, issues


@query("tsk1_eligible", """
    select t.file_id, t.attempt, t.updated_s, f.blob_id, f.user_id from {v_parse_task} t join {v_user_file} f on f.id = t.file_id
    where t.status = 'pending' and t.attempt < 3""")
def _(fx):
    return tasks.eligible(fx.v_parse_task, fx.v_user_file).select("file_id", "attempt", "updated_s", "blob_id", "user_id")


_TASK_NOW = 1704067200 + 30000


@query("tsk2_recover_stale", f"""
    select file_id, attempt, case when status = 'parsing' and updated_s < {_TASK_NOW} - 300 then 'pending' else status end as status,
           case when status = 'parsing' and updated_s < {_TASK_NOW} - 300 then {_TASK_NOW} else updated_s end as updated_s from {{v_parse_task}}""")
def _(fx):
    return tasks.recover_stale(fx.v_parse_task, _TASK_NOW).withColumn("updated_s", F.col("updated_s").cast("bigint"))


_RESULTS = """select f.id as file_id, case when f.file_size > 3000 then 'failed' when f.status = 0 then 'partial' else 'success' end as status,
        case when f.file_size > 3000 then 'too long' end as error, coalesce(c.n, 0) as node_count, coalesce(c.n, 0) as chunk_count
    from {v_user_file} f left join (select file_id, count(*) as n from {v_chunk} group by file_id) c on c.file_id = f.id where f.owner_type = 'personal'"""


@query("tsk3_finish", f"""
    select t.file_id, coalesce(r.status, t.status) as status, case when r.status = 'failed' then t.attempt + 1 else t.attempt end as attempt,
           r.error, r.node_count, r.chunk_count, case when r.file_id is null then 0.0::double else 1.0::double end as progress,
           case when r.file_id is null then t.updated_s else {NOW_S} end as updated_s
    from {{v_parse_task}} t left join ({_RESULTS}) r on r.file_id = t.file_id""")
def _(fx):
    return tasks.finish(fx.v_parse_task, fx.sql(_RESULTS), NOW_S)


_FAILURES = "select event_id as id, repeat(props, 300) as error from {events} where event_type = 'error' or event_type = 'view'"


@query("tsk4_retry_policy", f"""
    select j.id, j.attempt + 1 as attempt, case when j.attempt + 1 >= j.max_attempts then 'dead' else 'queued' end as status,
           case when j.attempt + 1 < j.max_attempts then {NOW_S} + cast(least(5 * pow(2, j.attempt), 60) as bigint) end as lease_s,
           substring(f.error, 1, 2000) as error
    from {{v_job}} j join ({_FAILURES}) f on f.id = j.id""")
def _(fx):
    return tasks.retry_policy(fx.v_job, fx.sql(_FAILURES), NOW_S)


_ASKED = "select event_id as id from {events} where value > 20"


@query("tsk5_reset_jobs", f"""
    select j.id, case when a.id is not null and j.status in ('failed','dead') then 'queued' else j.status end as status,
           case when a.id is not null and j.status in ('failed','dead') then 0 else j.attempt end as attempt,
           case when a.id is not null and j.status in ('failed','dead') then null else j.lease_s end as lease_s
    from {{v_job}} j left join ({_ASKED}) a on a.id = j.id""")
def _(fx):
    return tasks.reset_jobs(fx.v_job, fx.sql(_ASKED))


@query("tsk5_reset_parses", "select file_id, 'pending' as status, cast(0 as bigint) as attempt from {v_parse_task} where status in ('failed', 'partial')")
def _(fx):
    return tasks.reset_parses(fx.v_parse_task)


@query("tsk5_bury", f"select id, 'dead' as status, attempt, cast(null as bigint) as lease_s from {{v_job}} where id in ({_ASKED})")
def _(fx):
    return tasks.bury(fx.v_job, fx.sql(_ASKED))


@query("tsk6_runnable", f"""
    select id, status, lease_s from {{v_job}} where (status = 'queued' and (lease_s is null or lease_s < {NOW_S}))
       or (status = 'running' and lease_s < {NOW_S})""")
def _(fx):
    return tasks.runnable(fx.v_job, NOW_S).select("id", "status", "lease_s")


@query("tsk7_append_steps", """
    select j.id, concat('start:0.0', coalesce(s.series, '')) as series from (select o_orderkey as id from {orders}) j
    left join (select l_orderkey as id, string_agg('|' || l_returnflag || ':' || cast(l_discount as varchar), '' order by l_linenumber, l_returnflag, l_discount) as series
               from {lineitem} group by l_orderkey) s on s.id = j.id""")
def _(fx):
    jobs = fx.orders.select(F.col("o_orderkey").alias("id"), F.expr(
        "array(named_struct('stage', 'start', 'progress', cast(0 as double)))").alias("series"))
    steps = fx.lineitem.selectExpr("l_orderkey as id", "l_linenumber as step_no", "l_returnflag as stage", "l_discount as progress")
    out = tasks.append_steps(jobs, steps)
    return out.select("id", F.array_join(F.transform(
        "series", lambda s: F.concat(s["stage"], F.lit(":"), s["progress"].cast("string"))), "|").alias("series"))


_PLACEHOLDERS = """select file_id, page as page_no, idx as block_order, type as block_type, substring(text, 1, 2000) as reason
    from {v_node} where starts_with(text, '[图片解析失败]')"""
_ISSUE_BASE = "select file_id, page_no, block_order, block_type, status from {v_issue}"
_PARSED = "select file_id from {v_parse_task} where status <> 'pending'"


@query("iss1_sync_issues", f"""
    with bad as (select distinct file_id from ({_PLACEHOLDERS}))
    select i.file_id, i.page_no, i.block_order, i.block_type,
      case when i.file_id in ({_PARSED}) and i.file_id not in (select file_id from bad) and i.status in ('pending','retrying') then 'resolved'
           when i.file_id in ({_PARSED}) and i.file_id in (select file_id from bad) and i.status = 'retrying' then 'pending' else i.status end as status
    from ({_ISSUE_BASE}) i
    union all
    select p.file_id, p.page_no, p.block_order, p.block_type, 'pending' as status from ({_PLACEHOLDERS}) p
    where not exists (select 1 from ({_ISSUE_BASE}) i where i.file_id = p.file_id and i.page_no = p.page_no
                        and i.block_order = p.block_order and i.block_type = p.block_type)""")
def _(fx):
    return tasks.sync_issues(fx.sql(_ISSUE_BASE), fx.sql(_PLACEHOLDERS.replace("starts_with", "startswith")), fx.sql(_PARSED))


_ISSUE_EVENTS = """select (o_custkey % 300) * 10 + o_orderkey % 3 as issue_id, o_orderkey as seq,
      case o_orderkey % 8 when 0 then 'retry' when 1 then 'resolve' when 2 then 'skip' when 3 then 'fail' when 4 then 'cancel'
                          when 5 then 'retry' when 6 then 'retry' else 'skip' end as event from {orders}"""


@query("iss2_apply_events", f"""
    with recursive e as (select *, row_number() over (partition by issue_id order by seq) as n from ({_ISSUE_EVENTS})),
    r as (select id, file_id, status, cast(0 as bigint) as n from {{v_issue}}
          union all
          select r.id, r.file_id, case when e.event = 'retry' and r.status = 'pending' then 'retrying'
               when e.event = 'resolve' and r.status in ('retrying','pending') then 'resolved'
               when e.event = 'skip' and r.status in ('pending','failed') then 'skipped'
               when e.event = 'cancel' and r.status in ('pending','failed') then 'cancelled'
               when e.event = 'fail' then 'failed' else r.status end, r.n + 1
          from r join e on e.issue_id = r.id and e.n = r.n + 1)
    select id, file_id, status from (select *, row_number() over (partition by id order by n desc) as rn from r) where rn = 1""")
def _(fx):
    return tasks.apply_issue_events(fx.v_issue, fx.sql(_ISSUE_EVENTS))


@query("iss3_list_issues", """
    select id, file_id, page_no, block_order, status, cast(json_extract(bbox, '$[3]') as double) as bottom from {v_issue}""")
def _(fx):
    return tasks.list_issues(fx.v_issue).select("id", "file_id", "page_no", "block_order", "status",
                                                F.col("box")[3].alias("bottom"))
