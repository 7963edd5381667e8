"""File ledger: content-addressed blobs, listings, quotas, uploads, trash and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import compose_nfc
from .scan import latest_per_key, running, top_per_group

# ---- Fixed values ------------------------------------------------------------
QUOTA_BYTES = 2 * 1024 ** 3
MAX_OPEN_SESSIONS = 4
TRASH_SECONDS = 30 * 86400
SESSION_IDLE_SECONDS = 3600
TEMP_SECONDS = 3600
OPEN_ISSUES = ["pending", "retrying", "failed"]
STATUS_LABELS = {"pending": "处理中", "parsing": "处理中", "done": "已入库", "success": "已入库",
                 "partial": "已入库", "failed": "失败"}
STATUS_OTHER = "处理中"
NAME_CHARS = 255
# ------------------------------------------------------------------------------


def build_blobs(uploads: DataFrame) -> DataFrame:
    """FIL-1: one blob per content hash; the first upload owns it."""
    return uploads.groupBy("content_hash").agg(
        F.min("id").alias("first_file_id"), F.min_by("user_id", "id").alias("owner_user_id"),
        F.min_by("file_size", "id").alias("file_size"), F.count(F.lit(1)).alias("ref_count"))


def instant_match(requests: DataFrame, blobs: DataFrame) -> DataFrame:
    """FIL-2: uploads whose content is already stored (hash and size agree)."""
    return requests.join(blobs.select("content_hash", "file_size", F.col("first_file_id").alias("blob_id")),
                         ["content_hash", "file_size"], "left").withColumn("instant", F.col("blob_id").isNotNull())


def open_issue_counts(issues: DataFrame) -> DataFrame:
    return (issues.filter(F.col("status").isin(OPEN_ISSUES)).groupBy("file_id")
            .agg(F.count(F.lit(1)).alias("open_issues")))


def list_files(files: DataFrame, tasks: DataFrame, issues: DataFrame, page: int, size: int) -> DataFrame:
    """FIL-3: one listing page per user, newest id first, with the user's total."""
    live = files.filter("status = 1 and owner_type = 'personal'")
    totals = live.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    rows = top_per_group(live, ["user_id"], [F.desc("id")], page * size, "pos").filter(F.col("pos") > (page - 1) * size)
    return (rows.join(tasks.select(F.col("file_id").alias("id"), F.col("status").alias("task_status")), "id", "left")
            .join(open_issue_counts(issues).withColumnRenamed("file_id", "id"), "id", "left")
            .join(totals, "user_id")
            .select("user_id", "pos", "id", "filename", F.coalesce("task_status", F.lit("pending")).alias("parse_status"),
                    F.coalesce("open_issues", F.lit(0)).alias("open_issues"), "total"))


def list_dirs(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """FIL-4: directories with their live file count; a directory with files may not be deleted."""
    counts = files.filter("status = 1").groupBy("dir_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return dirs.join(counts, "dir_id", "left").select(*dirs.columns, n.alias("file_count"), (n == 0).alias("deletable"))


def list_trash(files: DataFrame) -> DataFrame:
    """FIL-5: soft-deleted files, last deleted first."""
    return (files.filter("status = 0").select("user_id", "id", "filename", "deleted_s")
            .orderBy(F.desc("deleted_s"), F.desc("id")))


def quota(files: DataFrame, uploads: DataFrame, limit: int = QUOTA_BYTES) -> DataFrame:
    """FIL-6: accept an upload when used plus new stays within the limit."""
    used = files.filter("status = 1").groupBy("user_id").agg(F.sum("file_size").alias("used"))
    joined = uploads.join(used, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return joined.withColumn("accepted", F.col("used") + F.col("new_size") <= limit)


def converge_names(files: DataFrame) -> DataFrame:
    """FIL-7: of rows with one (user, filename) keep the live one, then the lowest id.

    Rows without a user never compare equal, so they all stay.
    """
    owned = files.filter("user_id is not null")
    keep = owned.groupBy("user_id", "filename").agg(F.min(F.struct((-F.col("status")).alias("s"), "id")).alias("k"))
    kept = owned.join(keep.select(F.col("k.id").alias("id")), "id", "left_semi")
    return kept.unionByName(files.filter("user_id is null"))


def cascade(dependents: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``dependents`` whose file still exists."""
    return dependents.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def name_conflicts(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """FIL-7: wanted (user, filename) pairs that a live file already holds; the file itself does not count."""
    live = files.filter("status = 1").select("user_id", "filename", F.col("id").alias("holder_id"))
    return (wanted.join(live, ["user_id", "filename"]).filter("holder_id <> file_id")
            .groupBy("file_id", "user_id", "filename").agg(F.min("holder_id").alias("holder_id")))


def upload_status(sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """FIL-8: received parts per upload, whether complete, and whether the user may open one more.

    A part sent twice counts once, the later ``part_id`` wins.
    """
    last = latest_per_key(parts, ["session_id", "chunk_index"], ["part_id"])
    sums = last.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("received"), F.sum("chunk_size").alias("received_size"),
        F.array_join(F.array_sort(F.collect_set("chunk_index")), ",").alias("uploaded"))
    busy = sessions.filter("status = 'uploading'").groupBy("user_id").agg(F.count(F.lit(1)).alias("open_sessions"))
    n, size = F.coalesce("received", F.lit(0)), F.coalesce("received_size", F.lit(0))
    return (sessions.join(sums, "session_id", "left").join(busy, "user_id", "left")
            .select("session_id", "user_id", n.alias("received"), F.coalesce("uploaded", F.lit("")).alias("uploaded"),
                    F.when(F.col("status") == "completed", "already completed")
                    .when(n != F.col("chunk_count"), "parts missing")
                    .when(size != F.col("file_size"), "size differs").otherwise("complete").alias("state"),
                    (F.coalesce("open_sessions", F.lit(0)) < MAX_OPEN_SESSIONS).alias("may_open")))


def apply_file_changes(files: DataFrame, changes: DataFrame, blobs: DataFrame, block_size: int = 4096) -> DataFrame:
    """FIL-9: replay delete, restore, purge, move and rename in order of ``seq``.

    Only a live file can be deleted, moved or renamed; only a file in the trash
    can be restored (while its blob exists) or purged.
    """
    known = (changes.join(files.select(F.col("id").alias("file_id"), "blob_id", F.col("status").alias("base_status")),
                          "file_id")
             .join(blobs.select("blob_id", F.lit(True).alias("has_blob")), "blob_id", "left"))
    effect = (F.when(F.col("op") == "delete", F.lit(0))
              .when((F.col("op") == "restore") & F.col("has_blob"), F.lit(1)))
    seen = running(known, ["file_id"], ["seq"], F.floor(F.col("seq") / block_size),
                   {"prior": ("last", effect)}, inclusive=False)
    live = F.coalesce("prior", "base_status") == 1
    valid = (F.when(F.col("op").isin("delete", "move", "rename"), live)
             .when(F.col("op") == "restore", ~live & F.coalesce("has_blob", F.lit(False)))
             .otherwise(~live))
    ok = seen.withColumn("valid", valid).filter("valid")

    def last_of(op: str, column: str):
        return F.max_by(F.when(F.col("op").isin(*op.split()), F.struct(F.col(column).alias("v"))),
                        F.when(F.col("op").isin(*op.split()), F.col("seq")))

    final = ok.groupBy("file_id").agg(
        last_of("delete restore", "op").alias("st"), last_of("delete", "at_s").alias("del_at"),
        last_of("move", "arg").alias("mv"), last_of("rename", "arg").alias("rn"),
        F.min(F.when(F.col("op") == "purge", F.col("seq"))).alias("purged"))
    st = F.col("st.v")
    return (files.join(final, files.id == final.file_id, "left").filter("purged is null")
            .select("id", "user_id",
                    F.coalesce("rn.v", "filename").alias("filename"),
                    F.when(F.col("mv").isNotNull(), F.col("mv.v").cast("bigint")).otherwise(F.col("dir_id")).alias("dir_id"),
                    F.when(st == "delete", 0).when(st == "restore", 1).otherwise(F.col("status")).cast("bigint").alias("status"),
                    F.when(st == "delete", F.col("del_at.v")).when(st == "restore", F.lit(None))
                    .otherwise(F.col("deleted_s")).alias("deleted_s")))


def expired_trash(files: DataFrame, now_s: int) -> DataFrame:
    """FIL-10: files in the trash for more than 30 days."""
    return files.filter((F.col("status") == 0) & (F.col("deleted_s") < now_s - TRASH_SECONDS))


def expired_sessions(sessions: DataFrame, now_s: int) -> DataFrame:
    """FIL-10: uploads idle for more than an hour."""
    return sessions.filter((F.col("status") == "uploading") & (F.col("updated_s") < now_s - SESSION_IDLE_SECONDS))


def audit_blobs(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """FIL-11: compare the stored reference count with the rows, trash included."""
    actual = files.groupBy("blob_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return blobs.join(actual, "blob_id", "left").select(
        "blob_id", F.col("ref_count").alias("declared"), n.alias("actual"),
        F.when(n == 0, "drop").when(n != F.col("ref_count"), "fix").otherwise("keep").alias("action"))


def orphans(listing: DataFrame, blobs: DataFrame, now_s: int) -> DataFrame:
    """FIL-12: stored files no blob row names, and temporary files older than an hour."""
    temp = F.col("path").contains("/.upload-tmp/")
    old = listing.filter(temp & (F.col("modified_s") < now_s - TEMP_SECONDS)).withColumn("reason", F.lit("stale temp"))
    lost = (listing.filter(~temp).join(blobs.select("stored_name"), "stored_name", "left_anti")
            .withColumn("reason", F.lit("unknown file")))
    return old.unionByName(lost.select(*old.columns))


def status_label(status: Column) -> Column:
    label = F.lit(STATUS_OTHER)
    for code, text in STATUS_LABELS.items():
        label = F.when(status == code, text).otherwise(label)
    return label


def document_status(files: DataFrame, tasks: DataFrame, chunks: DataFrame) -> DataFrame:
    """FIL-13: live documents with mapped parse status and number of chunks."""
    n = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    live = files.filter("status = 1")
    return (live.join(tasks.select("file_id", F.col("status").alias("parse_status")), live.id == F.col("file_id"), "left")
            .drop("file_id").join(n, live.id == n.file_id, "left")
            .select("id", "filename", status_label(F.col("parse_status")).alias("status"),
                    F.coalesce("n", F.lit(0)).alias("chunk_count"), "file_size", "created_s"))


def clean_filename(name: str) -> Column:
    """FIL-14: composed base name, forbidden characters, blank names, last 255 characters.

    Only names beyond ASCII are composed, the one step that needs Python.
    """
    composed = F.when(F.col(name).rlike(r"[^\x00-\x7f]"), compose_nfc(name)).otherwise(F.col(name))
    base = F.regexp_extract(F.regexp_replace(composed, "/+$", ""), r"([^/]*)$", 1)
    safe = F.regexp_replace(base, r'[\x00-\x1f\\/:*?"<>|]', "_")
    bad = F.col(name).isNull() | (F.trim(name) == "") | (F.trim(safe) == "") | safe.isin(".", "..")
    return F.when(bad, "unnamed").otherwise(F.substring(
        safe, F.greatest(F.length(safe) - (NAME_CHARS - 1), F.lit(1)), F.lit(NAME_CHARS)))


def org_status(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """FIL-15: parse state of organisation files; without a task row a file is queued."""
    org = files.filter("owner_type = 'org' and status = 1")
    return (org.join(tasks.select(F.col("file_id").alias("id"), F.col("status").alias("t")), "id", "left")
            .select("org_id", "id", F.coalesce("t", F.lit("queued")).alias("state")))
