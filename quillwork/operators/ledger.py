"""Writers of the table store expressed as table-to-table transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import join_same, latest_per_key

AUDIT_TARGET_CHARS = 500


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Pass ``df`` through, failing the job when a key occurs twice."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    guard = counts.select(*keys, F.when(F.col("_n") > 1, F.raise_error(F.concat_ws(
        " ", F.lit("duplicate key"), *[F.col(k).cast("string") for k in keys])).cast("boolean"))
        .otherwise(F.lit(True)).alias("_ok"))
    return join_same(df, guard, keys).filter("_ok").select(*df.columns)


def replace_by_key(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK-1: all rows of a re-ingested key give way to its new rows."""
    return base.join(new.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(
        new.select(*base.columns))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str],
           order: list[str]) -> DataFrame:
    """SNK-2: insert new keys whole, change ``update_cols`` of known keys; the last update of a key wins."""
    last = latest_per_key(updates, keys, order)
    joined = (base.withColumn("_in_base", F.lit(True)).alias("b")
              .join(last.withColumn("_in_new", F.lit(True)).alias("u"),
                    F.expr(" AND ".join(f"b.{k} = u.{k}" for k in keys)), "full"))
    out = []
    for c in base.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"b.{c}"), F.col(f"u.{c}")).alias(c))
        elif c not in last.columns:
            out.append(F.col(f"b.{c}").alias(c))
        elif c in update_cols:
            out.append(F.when(F.col("u._in_new"), F.col(f"u.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.when(F.col("b._in_base"), F.col(f"b.{c}")).otherwise(F.col(f"u.{c}")).alias(c))
    return joined.select(*out)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SNK-3: a known key keeps its row; of new rows with one key the first is taken."""
    first = latest_per_key(new, keys, order, first=True)
    return base.unionByName(first.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def audit_rows(df: DataFrame) -> DataFrame:
    """SNK-4: rows as appended to the audit log."""
    return df.withColumn("target", F.substring("target", 1, AUDIT_TARGET_CHARS))


def append_log(df: DataFrame, path: str, day: str = "day") -> None:
    df.write.mode("append").partitionBy(day).parquet(path)


def to_artefacts(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """SNK-5: one parse artefact per file with its ordered nodes."""
    packed = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("idx", "type", "text"))).alias("nodes"))
    return status.join(packed, "file_id", "left").withColumn(
        "nodes", F.coalesce("nodes", F.expr("cast(array() as array<struct<idx:bigint,type:string,text:string>>)")))


def write_artefacts(artefacts: DataFrame, path: str) -> None:
    artefacts.write.mode("overwrite").json(path)


def preview(artefacts: DataFrame) -> DataFrame:
    """SNK-5: readable text of an artefact, every node text followed by a blank line."""
    return artefacts.select(
        "file_id",
        F.array_join(F.transform("nodes", lambda n: F.concat(n["text"], F.lit("\n\n"))), "").alias("preview"),
        F.size("nodes").cast("bigint").alias("node_count"))


def publish(df: DataFrame, root: str, version: int) -> str:
    """Write a new version directory; readers keep the old one until they ask again."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_version(spark: SparkSession, root: str) -> DataFrame:
    """Newest complete version (one holding the commit marker) of a published table."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = []
    for status in fs.listStatus(folder):
        path = status.getPath()
        if path.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
            versions.append((int(path.getName().split("=")[1]), path.toString()))
    return spark.read.parquet(max(versions)[1])
