"""Answer cache, semantic cache and conversation memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import upsert
from .scan import latest_per_key, top_per_group
from .vectors import vector_topk

# ---- Fixed values ------------------------------------------------------------
REFUSAL_TEXT = "资料中未找到"
REFERENCE_SIM = 0.9
SEM_SIM, SEM_CAP, SEM_EVICT, SEM_KEY_CHARS = 0.95, 500, 0.2, 60
HISTORY_ANSWER_CHARS = 800
EXTRACT_EVERY, MIN_MESSAGES = 5, 4
FOCUS_MAX, OPEN_MAX = 3, 2
RECALL_TOP, RECALL_SIM = 3, 0.4
# ------------------------------------------------------------------------------


def cache_exact(asks: DataFrame, cache: DataFrame) -> DataFrame:
    """CCH-1: own valid entry with the same key."""
    return asks.join(cache.filter("not invalidated").select("user_id", "query_hash", F.col("id").alias("cache_id"), "answer"),
                     ["user_id", "query_hash"]).select("ask_id", "cache_id", "answer")


# ---------------------------------------------------------------- sharing between users

def signatures(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Blob set behind each cache entry: ``id, sig`` (its key), ``blobs``, ``whole``, ``blank``.

    ``whole``: something is cited and every cited file exists with a blob.
    ``blank``: a cited file exists without a blob.
    """
    cited = entries.select("id", F.explode_outer("file_ids").alias("file_id"))
    seen = cited.join(files.select(F.col("id").alias("file_id"), "blob_id", F.lit(True).alias("known")), "file_id", "left")
    sets = seen.groupBy("id").agg(
        F.array_sort(F.collect_set("blob_id")).alias("blobs"),
        F.bool_and(F.col("file_id").isNotNull() & F.col("blob_id").isNotNull()).alias("whole"),
        F.bool_or(F.coalesce("known", F.lit(False)) & F.col("blob_id").isNull()).alias("blank"))
    return sets.withColumn("sig", F.md5(F.array_join("blobs", ",")))


def covered_sets(users: DataFrame, sets: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs (user, sig) where the user holds a live file for every blob of the set.

    Users meet a set only through its blob with the fewest holders, then the rest
    is counted; entries with one blob set are handled once.
    """
    held = (files.filter("status = 1 and blob_id is not null").select("user_id", "blob_id").distinct()
            .join(users.select("user_id").distinct(), "user_id", "left_semi"))
    distinct = sets.filter(F.size("blobs") > 0).select("sig", "blobs").dropDuplicates(["sig"])
    holders = held.groupBy("blob_id").agg(F.count(F.lit(1)).alias("n"))
    rarest = (distinct.select("sig", "blobs", F.explode("blobs").alias("blob_id")).join(holders, "blob_id", "left").groupBy("sig")
              .agg(F.min_by("blob_id", F.struct(F.coalesce("n", F.lit(0)), "blob_id")).alias("blob_id"), F.first("blobs").alias("blobs")))
    near = rarest.join(held, "blob_id").select("user_id", "sig", "blobs")
    single = near.filter(F.size("blobs") == 1).select("user_id", "sig")
    several = near.filter(F.size("blobs") > 1).select("user_id", "sig", F.size("blobs").alias("n"), F.explode("blobs").alias("blob_id"))
    full = (several.join(held, ["user_id", "blob_id"], "left_semi").groupBy("user_id", "sig", "n")
            .agg(F.count(F.lit(1)).alias("have")).filter("have = n").select("user_id", "sig"))
    return single.unionByName(full)


def holds(pairs: DataFrame, sets: DataFrame, files: DataFrame) -> DataFrame:
    """Those of the ``pairs (user_id, sig)`` where the user holds a live file for every blob of the set."""
    asked = pairs.distinct().join(sets.filter(F.size("blobs") > 0).select("sig", "blobs").dropDuplicates(["sig"]), "sig")
    needed = asked.select("user_id", "sig", F.size("blobs").alias("n"), F.explode("blobs").alias("blob_id"))
    held = files.filter("status = 1 and blob_id is not null").select("user_id", "blob_id")
    return (needed.join(held, ["user_id", "blob_id"], "left_semi").groupBy("user_id", "sig", "n")
            .agg(F.count(F.lit(1)).alias("have")).filter("have = n").select("user_id", "sig"))


def _best_two(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Two best entries of different users per key: one of them is never the asker's own."""
    order = F.struct("hit_count", "updated_s", (-F.col("id")).alias("o"))
    per_user = entries.groupBy(*keys, "owner_id").agg(F.max(order).alias("o"))
    return top_per_group(per_user, keys, [F.desc("o")], 2, "_n").select(*keys, "owner_id", "o")


def cache_shared(asks: DataFrame, cache: DataFrame, files: DataFrame, compat: bool = False) -> DataFrame:
    """CCH-2: best entry of another user for the same question, all of whose sources the asker holds too.

    ``compat`` repeats the null and empty-list behaviour of a NOT IN test: an asker
    with a live file without blob passes everything, and so do entries whose cited
    files are gone or none.
    """
    wanted = asks.select("query_hash").distinct()
    entries = (cache.filter("not invalidated and file_ids is not null").join(wanted, "query_hash", "left_semi")
               .withColumnRenamed("user_id", "owner_id"))
    sets = signatures(entries, files)
    tagged = entries.join(sets.select("id", "sig", "blobs", "whole", "blank"), "id")
    pairs = asks.select("user_id", "query_hash").distinct()

    def pick(found: DataFrame) -> DataFrame:
        return found.filter(F.col("owner_id") != F.col("user_id"))

    usable = tagged if compat else tagged.filter("whole")
    best = _best_two(usable.filter(F.size("blobs") > 0), ["query_hash", "sig"])
    near = pick(pairs.join(best, "query_hash"))
    cover = holds(near.select("user_id", "sig"), usable, files)
    found = near.join(cover, ["user_id", "sig"], "left_semi").select("user_id", "query_hash", "o")
    if compat:
        state = files.filter("status = 1").groupBy("user_id").agg(F.bool_or(F.col("blob_id").isNull()).alias("lax"))
        asked = pairs.join(state, "user_id", "left")
        loose = _best_two(usable, ["query_hash"])
        found = found.unionByName(pick(asked.filter("lax").select("user_id", "query_hash").join(loose, "query_hash")).select("user_id", "query_hash", "o"))
        free = _best_two(usable.filter((F.size("blobs") == 0) & ~F.col("blank")), ["query_hash"])
        found = found.unionByName(pick(pairs.join(free, "query_hash")).select("user_id", "query_hash", "o"))
        null_only = _best_two(usable.filter((F.size("blobs") == 0) & F.col("blank")), ["query_hash"])
        holders = asked.filter("lax is not null").select("user_id", "query_hash")
        found = found.unionByName(pick(holders.join(null_only, "query_hash")).select("user_id", "query_hash", "o"))
    top = found.groupBy("user_id", "query_hash").agg(F.max("o").alias("o")).select("user_id", "query_hash", (-F.col("o.o")).alias("cache_id"))
    return asks.join(top, ["user_id", "query_hash"]).select("ask_id", "user_id", "query_hash", "cache_id")


def map_shared_files(shared: DataFrame, files: DataFrame) -> DataFrame:
    """CCH-3: files of the asker with the same content as the cited live files.

    ``shared(ask_id, user_id, file_ids)``.
    """
    live = files.filter("status = 1 and blob_id is not null")
    cited = shared.select("ask_id", "user_id", F.explode("file_ids").alias("file_id"))
    blobs = cited.join(live.select(F.col("id").alias("file_id"), "blob_id"), "file_id").select("ask_id", "user_id", "blob_id").distinct()
    own = blobs.join(live.select("user_id", "blob_id", F.col("id").alias("own_id")), ["user_id", "blob_id"])
    return own.groupBy("ask_id").agg(F.array_sort(F.collect_set("own_id")).alias("file_ids"))


def cache_semantic(asks: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
    """CCH-4: closest valid entry above the similarity, own entries first, then those of others under the sharing rule.

    The entries a user may see are found first and become the scope of one
    top-1 search, so no pair table over all entries arises.
    """
    valid = cache.filter("not invalidated and embedding is not null")
    q = asks.select(F.col("ask_id").alias("query_id"), "user_id", "embedding")

    def nearest(entries: DataFrame) -> DataFrame:
        return (vector_topk(q, entries, 1, keys=["user_id"], min_sim=REFERENCE_SIM)
                .filter(F.col("sim") > REFERENCE_SIM).select("query_id", "chunk_id", "sim"))

    own = nearest(valid.select("user_id", F.col("id").alias("chunk_id"), "embedding"))
    sets = signatures(valid.filter("file_ids is not null"), files).filter("whole")
    seen = (covered_sets(asks, sets, files).join(sets.select("id", "sig"), "sig")
            .join(valid.select("id", F.col("user_id").alias("owner_id"), "embedding"), "id")
            .filter(F.col("owner_id") != F.col("user_id")).select("user_id", F.col("id").alias("chunk_id"), "embedding"))
    other = nearest(seen)
    return (asks.select(F.col("ask_id").alias("query_id")).join(own.toDF("query_id", "own_id", "own_sim"), "query_id", "left")
            .join(other.toDF("query_id", "other_id", "other_sim"), "query_id", "left")
            .select(F.col("query_id").alias("ask_id"), F.coalesce("own_id", "other_id").alias("cache_id"),
                    F.coalesce("own_sim", "other_sim").alias("sim"),
                    (F.col("own_id").isNull() & F.col("other_id").isNotNull()).alias("shared"))
            .filter("cache_id is not null"))


def cache_store(cache: DataFrame, answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """CCH-5: write complete, unrefused answers; a known question is replaced and valid again.

    ``answers(seq, user_id, query_hash, query, answer, chunk_ids, complete, rejected)``.
    """
    good = answers.filter(F.col("complete") & ~F.col("rejected") & (F.coalesce("answer", F.lit("")) != "")
                          & ~F.startswith("answer", F.lit(REFUSAL_TEXT)))
    cited = good.select("seq", F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", "file_id"), "chunk_id")
    files = cited.groupBy("seq").agg(F.array_sort(F.collect_set("file_id")).alias("file_ids"))
    rows = good.join(files, "seq", "left").withColumn(
        "file_ids", F.coalesce("file_ids", F.expr("cast(array() as array<bigint>)"))).withColumn("invalidated", F.lit(False))
    return upsert(cache, rows.select("user_id", "query_hash", "query", "answer", "file_ids", "invalidated", "seq"),
                  ["user_id", "query_hash"], ["answer", "file_ids", "invalidated"], ["seq"])


def cache_invalidate(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """CCH-6: entries of the owner that cite a changed or deleted file are no longer valid."""
    hit = (cache.select("id", "user_id", F.explode("file_ids").alias("file_id"))
           .join(changed.select("user_id", "file_id"), ["user_id", "file_id"], "left_semi").select("id").distinct()
           .withColumn("_hit", F.lit(True)))
    return cache.join(hit, "id", "left").withColumn(
        "invalidated", F.col("invalidated") | F.coalesce("_hit", F.lit(False))).drop("_hit")


# ---------------------------------------------------------------- semantic cache

def semcache_key(query: str = "query") -> Column:
    return F.concat(F.substring(query, 1, SEM_KEY_CHARS), F.lit(":"), F.length(query).cast("string"))


def semcache_lookup(asks: DataFrame, store: DataFrame) -> DataFrame:
    """CCH-7: nearest stored question of the user when close enough.

    ``asks(ask_id, user_id, embedding)``, ``store(id, user_id, embedding)``.
    """
    return vector_topk(asks.select(F.col("ask_id").alias("query_id"), "user_id", "embedding"),
                       store.select(F.col("id").alias("chunk_id"), "user_id", "embedding"),
                       1, keys=["user_id"], min_sim=SEM_SIM).select(
        F.col("query_id").alias("ask_id"), F.col("chunk_id").alias("cache_id"), "sim")


def semcache_refresh(store: DataFrame, hits: DataFrame, now_s: int) -> DataFrame:
    """CCH-7: entries that were hit become the newest."""
    touched = hits.select(F.col("cache_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return store.join(touched, "id", "left").withColumn(
        "ts_s", F.when(F.col("_hit"), F.lit(now_s).cast("bigint")).otherwise(F.col("ts_s"))).drop("_hit")


def semcache_store(store: DataFrame, new: DataFrame, cap: int = SEM_CAP) -> DataFrame:
    """CCH-8: one new entry per user; a full store first drops its oldest fifth.

    ``store(user_id, key, query, ts_s)`` with at most ``cap`` rows per user. Longer
    sequences per user are the streaming form.
    """
    writing = latest_per_key(new, ["user_id"], ["ts_s", "key"])
    size = store.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    due = (size.join(writing.select("user_id"), "user_id", "left_semi").filter(F.col("_n") >= cap)
           .select("user_id", F.greatest(F.lit(1), F.floor(F.col("_n") * SEM_EVICT)).alias("_drop")))
    oldest = top_per_group(store.join(due, "user_id"), ["user_id"], [F.col("ts_s"), F.col("key")], F.col("_drop"), "_age")
    left = store.join(oldest.select("user_id", "key"), ["user_id", "key"], "left_anti")
    return upsert(left, writing, ["user_id", "key"], ["query", "ts_s"], ["ts_s"])


def semcache_clear(store: DataFrame, user: int | None = None) -> DataFrame:
    """CCH-9: forget one user, or everything."""
    return store.limit(0) if user is None else store.filter(F.col("user_id") != user)


# ---------------------------------------------------------------- memory

def history(log: DataFrame, n: int) -> DataFrame:
    """MEM-1: the last ``n`` turns of each session as messages, oldest first."""
    last = top_per_group(log, ["session_id"], [F.desc("id")], n, "_back")
    return last.select("session_id", "id", F.posexplode(F.array(
        F.struct(F.lit("user").alias("role"), F.col("query").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.substring("answer", 1, HISTORY_ANSWER_CHARS).alias("content")))).alias("part", "m")).select(
        "session_id", "id", F.col("part").cast("bigint").alias("part"), "m.role", "m.content")


def turns_due(log: DataFrame) -> DataFrame:
    """MEM-2: turns per session and whether memory extraction is due now."""
    n = log.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    return n.withColumn("due", (F.col("turns") > 0) & (F.col("turns") % EXTRACT_EVERY == 0) & (F.col("turns") * 2 >= MIN_MESSAGES))


def memory_insert(memory: DataFrame, items: DataFrame) -> DataFrame:
    """MEM-3: new memory rows: three focus points and two open questions per extraction, no text twice per user.

    ``items(extract_id, user_id, mem_type, pos, content)``, ``memory(user_id, mem_type, content)``.
    """
    limit = F.when(F.col("mem_type") == "focus", FOCUS_MAX).otherwise(OPEN_MAX)
    taken = top_per_group(items, ["extract_id", "mem_type"], [F.col("pos")], FOCUS_MAX, "_n").filter(F.col("_n") <= limit)
    clean = taken.withColumn("content", F.regexp_replace("content", r"(?U)^\s+|\s+$", "")).filter("content <> ''")
    first = latest_per_key(clean.select("user_id", "content", "mem_type", "extract_id", "pos"), ["user_id", "content"],
                           ["extract_id", "mem_type", "pos"], first=True)
    return first.join(memory.select("user_id", "content"), ["user_id", "content"], "left_anti").select("user_id", "mem_type", "content")


def memory_recall(asks: DataFrame, memory: DataFrame) -> DataFrame:
    """MEM-4: up to three own memories close to the question."""
    found = vector_topk(asks.select(F.col("ask_id").alias("query_id"), "user_id", "embedding"),
                        memory.select(F.col("id").alias("chunk_id"), "user_id", "embedding"),
                        RECALL_TOP, keys=["user_id"], min_sim=RECALL_SIM)
    return found.filter(F.col("sim") > RECALL_SIM).select(
        F.col("query_id").alias("ask_id"), F.col("chunk_id").alias("memory_id"), "rank", F.bround("sim", 3).alias("sim"))


def sessions(rows: DataFrame, log: DataFrame, directory: int | None = None) -> DataFrame:
    """MEM-5: sessions with their number of turns, newest first."""
    turns = log.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    wanted = rows if directory is None else rows.filter(F.col("dir_id") == directory)
    return wanted.join(turns, "session_id", "left").withColumn("turns", F.coalesce("turns", F.lit(0))).orderBy(F.desc("created_s"), "session_id")
