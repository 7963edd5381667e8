"""Streaming jobs: continuous ingest, idempotent queueing and live metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, clean, nodes

DOCUMENT = "file_id bigint, name string, text string"


def document_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of ``docs(file_id, name, text)``: Markdown by name, else paragraphs. No shuffle."""
    markdown = F.lower("name").endswith(".md")
    plain = F.expr("transform(filter(split(regexp_replace(text, '\\r\\n?', '\\n'), '\\n\\n'), p -> trim(p) <> ''), "
                   "p -> named_struct('type', 'paragraph', 'text', p, 'level', cast(null as bigint)))")
    both = docs.withColumn("_t", F.regexp_replace("text", "\r\n?", "\n"))
    parsed = both.select("file_id", F.when(markdown, nodes.markdown_array("_t")).otherwise(plain).alias("_n"))
    cleaned = F.transform("_n", lambda n: F.struct(
        n["type"].alias("type"), clean.clean_text(n["text"], n["type"]).alias("text"), n["level"].alias("level"),
        F.lit(None).cast("bigint").alias("page")))
    return chunking.chunk_documents(parsed.select("file_id", cleaned.alias("nodes")))


def write_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Append the chunks of a micro-batch under its number, so that a repeated batch overwrites itself."""
    newest = batch.groupBy("file_id").agg(F.max_by(F.struct("name", "text"), "seen").alias("r"), F.max("seen").alias("seen")).select(
        "file_id", "r.name", "r.text", "seen")
    chunks = document_chunks(newest)
    chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
    newest.select("file_id", "seen").write.mode("overwrite").parquet(f"{out}/files/batch={batch_id}")


def start_ingest(spark: SparkSession, source: str, out: str, checkpoint: str, schema: str = DOCUMENT + ", seen bigint") -> StreamingQuery:
    """STR-8: turn arriving documents into chunks; the newest text of a file replaces all its older chunks."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    return (stream.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, out))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of each file's newest text, whenever it arrived: replacement by reading, without rewriting the table."""
    files = spark.read.parquet(f"{out}/files").groupBy("file_id").agg(F.max_by("batch", F.struct("seen", "batch")).alias("batch"))
    return spark.read.parquet(f"{out}/chunks").join(files, ["file_id", "batch"], "left_semi").drop("batch")


def enqueue_stream(stream: DataFrame, key: str = "file_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """STR-9: a key already queued within the watermark is ignored."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def live_metrics(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """STR-10: answers per window with refusals, cache hits, errors and mean time; works on streams and tables.

    ``events(ts timestamp, total_ms, refused, cache_hit, route)``; rows later than the watermark are dropped by a stream.
    """
    base = events.withWatermark("ts", delay) if events.isStreaming else events
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = base.groupBy(win.alias("w")).agg(
        F.count(F.lit(1)).alias("answers"), F.count_if("refused").alias("refused"), F.count_if("cache_hit").alias("cache_hits"),
        F.round(F.avg("total_ms"), 3).alias("avg_ms"))
    return rows.select(F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"),
                       "answers", "refused", "cache_hits", "avg_ms")


def upsert_windows(batch: DataFrame, batch_id: int, out: str) -> None:
    """Keep the windows a micro-batch changed under its number, so that a repeated batch overwrites itself."""
    batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def current_windows(spark: SparkSession, out: str) -> DataFrame:
    """The newest state of each window written by ``upsert_windows``, open ones too."""
    rows = spark.read.parquet(out)
    state = [c for c in rows.columns if c not in ("start_s", "batch")]
    return rows.groupBy("start_s").agg(F.max_by(F.struct(*state), "batch").alias("r")).select("start_s", "r.*")


def session_metrics(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """STR-10: answers per stretch of activity of a user."""
    base = events.withWatermark("ts", delay) if events.isStreaming else events
    rows = base.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("answers"))
    return rows.select("user_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "answers")
