"""RET-6 with a stored index: block-max postings as tables, and exact top-k that skips blocks.

Chunks are numbered into segments of neighbouring ids. A posting block is a term in
a segment: the chunks that hold it with their frequencies and lengths, and the best
weight that one of them gives the term. Terms keep their document frequency, and
each scope its size and mean length. All of it is written once per version of the
corpus; a search reads no chunk text.

A search first reads block heads only. The sum of a question's best weights in a
segment bounds every chunk there from above, and the largest of them is reached by
a chunk, so the k-th largest over segments bounds the k-th score from below. Only
segments whose upper bound reaches it are scored, from their blocks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage, new_folder
from .scan import top_per_group
from .search import B, CHANNEL_TOP, K1, SCORE_DIGITS, Tokenizer, default_tokenizer, fitting, passage, query_terms

SEGMENT = 128   # ids of a segment
BUCKETS = 16    # folders of the postings, by term
LISTED = 1000   # questions that may be listed beside a segment
SLACK = 1e-7    # covers the rounding of scores


@dataclass(frozen=True)
class Index:
    """A stored index: its folder, the scope columns, if any, and the number of folders its terms are dealt to."""
    folder: str
    keys: list[str] = field(default_factory=list)
    buckets: int = BUCKETS
    schemas: dict[str, StructType] = field(default_factory=dict)

    def write(self, df: DataFrame, part: str, by_bucket: bool = False, rebalance: bool = True) -> DataFrame:
        """Keep ``df`` as a part; a large bucket becomes several files, small ones share tasks. Without ``rebalance``
        rows are not moved, and each task writes a file a bucket."""
        self.schemas[part] = df.schema
        if by_bucket:
            order = [c for c in ("bucket", *self.keys, "term", "segment") if c in df.columns]
            (df.hint("rebalance", "bucket") if rebalance else df).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{self.folder}/{part}")
        else:
            df.write.parquet(f"{self.folder}/{part}")
        return self.read(df.sparkSession, part)

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.schema(self.schemas[part]).parquet(f"{self.folder}/{part}")

    def bucket(self, term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def _sized(df: DataFrame, index: Index) -> DataFrame:
    """``df`` with size and mean length of its scope; without scope columns the corpus is one row under a constant."""
    return df.withColumn("whole", F.lit(0)).join(index.read(df.sparkSession, "corpus"), ["whole", *index.keys]).drop("whole")


def term_weight(tf: str | Column, dl: str | Column, avg_dl: str | Column) -> Column:
    """BM25 weight of a term in a chunk, without its idf."""
    tf, dl, avg_dl = (F.col(c) if isinstance(c, str) else c for c in (tf, dl, avg_dl))
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def build_index(chunks: DataFrame, folder: str | None = None, keys: list[str] | None = None,
                tokenizer: Tokenizer = default_tokenizer, segment: int = SEGMENT, buckets: int = BUCKETS) -> Index:
    """Write the index of ``chunks (keys, chunk_id, heading_path, content)`` with whole-number ids.

    Chunks without words count for the mean length and have no postings. Texts are dealt by segment; there they are
    cut into words once, and blocks gather without another shuffle. The null term of a segment lists its chunks.
    """
    index = Index(folder or new_folder(chunks.sparkSession, "index"), keys or [], buckets)
    keys = index.keys
    texts = chunks.select(*keys, "chunk_id", passage().alias("_p")).withColumn("segment", F.floor(F.col("chunk_id") / segment)).repartition("segment")
    words = texts.select(*keys, "segment", "chunk_id", tokenizer("_p").alias("_t"))
    counted = words.select(*keys, "segment", "chunk_id", F.size("_t").alias("dl"), F.explode_outer(
        F.concat(F.expr("array(cast(null as string))"), "_t")).alias("term")).groupBy(
        *keys, "segment", "chunk_id", "dl", "term").agg(F.count("*").alias("tf"))
    found = index.write(counted.groupBy(*keys, "segment", "term").agg(
        F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("entries")), "frequencies")
    index.write(found.filter("term IS NULL").select(*keys, F.inline("entries")).select(*keys, "chunk_id", "dl").distinct()
                .withColumn("whole", F.lit(0)).groupBy("whole", *keys).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl")), "corpus")
    best = F.array_max(F.transform("entries", lambda e: term_weight(e["tf"], e["dl"], F.col("avg_dl"))))
    blocks = _sized(found.filter("term IS NOT NULL"), index).select(*keys, "term", "segment", best.alias("best"), "entries")
    heads = index.write(blocks.withColumn("bucket", index.bucket("term")), "postings", by_bucket=True, rebalance=False)
    index.write(heads.groupBy("bucket", *keys, "term").agg(F.sum(F.size("entries")).alias("df")), "terms", by_bucket=True)
    return index


def weights(queries: DataFrame, index: Index, tokenizer: Tokenizer = default_tokenizer) -> DataFrame:
    """``(keys, query_id, term, bucket, w, avg_dl)`` of the words of the questions that the index holds."""
    spark, keys = queries.sparkSession, index.keys
    asked = query_terms(queries, keys, tokenizer).withColumn("bucket", index.bucket("term"))
    known = asked.join(index.read(spark, "terms"), ["bucket", *keys, "term"])
    sized = _sized(known, index)
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return sized.select(*keys, "query_id", "term", "bucket", (F.col("qtf") * idf).alias("w"), F.coalesce("avg_dl", F.lit(1.0)).alias("avg_dl"))


def live_segments(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """``(query_id, segment)`` that may hold one of the best ``k`` chunks of a question."""
    heads = index.read(asked.sparkSession, "postings").select("bucket", *index.keys, "term", "segment", "best")
    bounds = fitting(asked).join(heads, ["bucket", *index.keys, "term"]).groupBy("query_id", "segment").agg(
        F.sum(F.col("w") * F.col("best")).alias("most"), F.max(F.col("w") * F.col("best")).alias("reached"))
    least = top_per_group(bounds, ["query_id"], [F.desc("reached"), F.col("segment")], k).filter(F.col("rank") == k).select(
        "query_id", F.col("reached").alias("floor"))
    return bounds.join(least, "query_id", "left").filter(F.col("most") >= F.coalesce("floor", F.lit(0.0)) - SLACK).select("query_id", "segment")


def search_index(queries: DataFrame, index: Index, k: int = CHANNEL_TOP, tokenizer: Tokenizer = default_tokenizer) -> DataFrame:
    """Best ``k`` chunks per question, as ``search.bm25_topk`` gives them: ``(query_id, chunk_id, bm25, rank)``.

    ``queries (query_id, question)`` carry the scope columns of the index. Every question is answered in full whatever
    its words; one with no known word has no rows.
    """
    asked = cut_lineage(weights(queries, index, tokenizer))
    named = ["bucket", *index.keys, "term"]
    blocks = index.read(queries.sparkSession, "postings").select(*named, "segment", "entries").join(
        fitting(asked.select(*named).distinct()), named, "left_semi")
    live = live_segments(asked, index, k)
    if asked.select("query_id").distinct().count() <= LISTED:
        # blocks are dealt by segment once; there they meet the questions, and scores need no shuffle of their own
        listed = live.groupBy("segment").agg(F.collect_list("query_id").alias("live"))
        met = blocks.repartition("segment").join(listed, "segment").join(fitting(asked), named).filter(F.array_contains("live", F.col("query_id")))
    else:
        met = live.join(asked, "query_id").join(blocks, [*named, "segment"])
    hits = met.select("segment", "query_id", "w", "avg_dl", F.inline("entries"))
    scored = (hits.groupBy("segment", "query_id", "chunk_id").agg(F.round(F.sum(F.col("w") * term_weight("tf", "dl", "avg_dl")), SCORE_DIGITS).alias("bm25"))
              .filter("bm25 > 0").drop("segment"))
    return top_per_group(scored, ["query_id"], [F.desc("bm25"), F.col("chunk_id")], k)
