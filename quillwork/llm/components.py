"""Connected components of a link table by alternating stars.

Each round points every node's larger neighbours (large star) and then its
smaller ones (small star) at the smallest node known to it; the rounds needed
grow with the logarithm of the longest chain. A round is two aggregates with
partial sums and two joins, so a node with very many links is split by the
adaptive skew join. Rounds are cut with ``checkpoint`` in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` point from the larger to the smaller node."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a")
    return (moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``links (a, b)``; root is the smallest node reachable.

    Self-links, repeated links and links with a null end are allowed and add nothing.
    """
    state = cut_lineage(links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = digest(state)
    while seen[0]:
        state = cut_lineage(_small_star(_large_star(state)))
        now = digest(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        state.select("b", "b").distinct())
