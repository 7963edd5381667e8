"""A corpus pipeline of five stages over ``documents``; each is written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import contamination, jaccard, linededup, packing, toxicity
from quillwork.llm.textkit import store, table

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window is not toxic. The network is fit on the labelled ones among ``docs``; with no
    labels, nothing is toxic. Null and blank texts stay."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.filter_clean(docs, net)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that an earlier place has; ``n_chars`` follows the text."""
    return linededup.rewrite(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words a shingle, similarity 0.8 or more) the document with the smallest id. Equal rows are one
    document, and so are different texts of one id, which stay together. Documents without an id all stay."""
    kept = jaccard.near_duplicates(docs, width=5, least=0.8).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is in benchmark passages."""
    return contamination.filter_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training: their document, place, length and ids."""
    return packing.pack(docs, longest=2048, end_id=1).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first stage learns and the last one tokenizes, which SQL can't; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
