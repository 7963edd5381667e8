"""Readers for text files and question sets, and the gates a file passes before it is parsed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- Fixed values ------------------------------------------------------------
FILE_TYPES = ["txt", "md", "pdf", "docx", "xlsx", "pptx", "png", "jpg", "jpeg", "webp"]
IMAGE_TYPES = ["png", "jpg", "jpeg", "webp"]
MAX_IMAGE_BYTES = 20 * 1024 * 1024
MAX_FILE_BYTES = 50 * 1024 * 1024
MAGIC_STRICT = {"pdf": "25504446", "docx": "504B0304", "xlsx": "504B0304", "pptx": "504B0304",
                "png": "89504E47", "jpg": "FFD8FF", "jpeg": "FFD8FF", "webp": "52494646"}
MAGIC_SCAN = {"pdf": "255044462D", "docx": "504B0304", "xlsx": "504B0304", "pptx": "504B0304",
              "png": "89504E47", "jpg": "FFD8FF", "jpeg": "FFD8FF"}
# ------------------------------------------------------------------------------

QUESTION_FIELDS = ("id:string,question:string,query:string,reference_answer:string,dimension:string,"
                   "category:string,in_regression:boolean,evidence_keywords:array<string>,"
                   "expect_files:array<string>")


@F.pandas_udf(StringType())
def _decode_gbk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Legacy encoding the JVM decoder of Spark does not offer; null where the bytes are invalid."""
    def one(raw):
        try:
            return None if raw is None else bytes(raw).decode("gbk")
        except UnicodeDecodeError:
            return None
    for batch in batches:
        yield batch.map(one)


def decode_text(files: DataFrame, content: str = "content") -> DataFrame:
    """SRC-1: UTF-8 (byte order mark dropped), else GBK, else an error; line ends become LF."""
    flagged = files.withColumn("_utf8", F.expr(f"is_valid_utf8(cast({content} as string))"))
    good = flagged.filter("_utf8").withColumn("text", F.col(content).cast("string"))
    rest = flagged.filter("NOT _utf8").withColumn("text", _decode_gbk(F.col(content)))
    both = good.unionByName(rest)
    text = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n")
    return both.withColumn("text", text).withColumn(
        "error", F.when(F.col("text").isNull(), F.lit("encoding not recognised"))).drop("_utf8", content)


def read_text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    return decode_text(raw).select("path", "text", "error")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """SRC-3: one row per golden question, from ``{"questions": [...]}`` or a bare array."""
    plain = ", ".join(f.replace(":", " ", 1) for f in QUESTION_FIELDS.split(","))
    wrapped = spark.read.option("multiLine", True).schema(
        f"questions array<struct<{QUESTION_FIELDS}>>, {plain}").json(path)
    nested = wrapped.select(F.explode("questions").alias("q")).select("q.*")
    bare = wrapped.filter("questions is null").drop("questions")
    return nested.unionByName(bare)


def extension(name: str) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,10})$", 1))


def with_file_type(df: DataFrame, name: str = "filename") -> DataFrame:
    """SRC-4: extension and whether it is on the list."""
    return df.withColumn("ext", extension(name)).withColumn("type_ok", F.col("ext").isin(FILE_TYPES))


def with_magic_ok(df: DataFrame, content: str = "content", ext: str = "ext", mode: str = "strict") -> DataFrame:
    """SRC-5: file head against extension.

    ``strict``: the first 8 bytes start with the magic. ``scan``: a PDF mark may
    stand anywhere in the first 1024 bytes. Types without a magic pass.
    """
    magic = MAGIC_STRICT if mode == "strict" else MAGIC_SCAN
    head = F.substring(content, 1, 8 if mode == "strict" else 1024)
    test = F.lit(True)
    for kind, code in magic.items():
        mark = F.expr(f"x'{code}'")
        anywhere = mode == "scan" and kind == "pdf"
        test = F.when(F.col(ext) == kind, F.contains(head, mark) if anywhere else F.startswith(head, mark)).otherwise(test)
    return df.withColumn("magic_ok", test)


def with_size_ok(df: DataFrame, size: str = "file_size", ext: str = "ext") -> DataFrame:
    """SRC-6: empty files, images over 20 MiB and files over 50 MiB are refused."""
    return df.withColumn(
        "size_ok", (F.col(size) > 0) & (F.col(size) <= MAX_FILE_BYTES)
        & ~(F.col(ext).isin(IMAGE_TYPES) & (F.col(size) > MAX_IMAGE_BYTES)))
