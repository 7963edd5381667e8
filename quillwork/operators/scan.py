"""Running values over long ordered groups.

A plain window puts a whole group on one task. Here each group is cut into
blocks: blocks are summarised with a partial aggregate, the summaries (one row
per block) are scanned, and the rows of a block only see their own block plus
the carried value. A group may then hold any share of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys agree; the columns of ``left`` and those of ``right`` that are not keys."""
    rest = [c for c in right.columns if c not in keys]
    renamed = right.select(*rest, *[F.col(k).alias(f"_k_{k}") for k in keys])
    return left.join(renamed, F.expr(" AND ".join(f"{k} <=> _k_{k}" for k in keys)), how).select(*left.columns, *rest)


def running(df: DataFrame, keys: list[str], order: list[str], block: Column,
            measures: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Add one running value per measure.

    ``measures`` maps a new column to ``(kind, value)`` with kind ``sum``,
    ``count``, ``max``, ``min`` or ``last`` (last value that is not null).
    ``block`` must not decrease along ``order`` inside a group. With
    ``inclusive=False`` the current row is left out; ``sum`` and ``count`` start at 0.
    """
    order_key = F.struct(*[F.col(c) for c in order])
    staged = df.withColumn("_blk", block)
    for name, (_, value) in measures.items():
        staged = staged.withColumn(f"_v_{name}", value)

    def partial(name: str, kind: str) -> Column:
        v = F.col(f"_v_{name}")
        if kind == "last":
            return F.max(F.when(v.isNotNull(), F.struct(order_key.alias("o"), v.alias("v"))))
        if kind == "count":
            return F.count(v)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](v)

    def rolled(name: str, kind: str, column: str, window) -> Column:
        c = F.col(column)
        if kind == "last":
            return F.last(c, ignorenulls=True).over(window)
        if kind == "count" and column.startswith("_v_"):
            return F.count(c).over(window)
        if kind in ("sum", "count"):
            return F.sum(c).over(window)
        return {"max": F.max, "min": F.min}[kind](c).over(window)

    summary = staged.groupBy(*keys, "_blk").agg(
        *[partial(n, k).alias(f"_s_{n}") for n, (k, _) in measures.items()])
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(*keys, "_blk", *[
        rolled(n, k, f"_s_{n}", before).alias(f"_c_{n}") for n, (k, _) in measures.items()])

    joined = join_same(staged, carry, [*keys, "_blk"])
    inside = W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1)
    out = joined
    for name, (kind, _) in measures.items():
        here = rolled(name, kind, f"_v_{name}", inside)
        carried = F.col(f"_c_{name}")
        if kind == "last":
            value = F.coalesce(here, carried["v"])
        elif kind in ("sum", "count"):
            value = F.coalesce(carried, F.lit(0)) + F.coalesce(here, F.lit(0))
        else:
            value = (F.greatest if kind == "max" else F.least)(here, carried)
        out = out.withColumn(name, value)
    return out.drop("_blk", *[f"_v_{n}" for n in measures], *[f"_c_{n}" for n in measures])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int | Column,
                  rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their rank.

    Spark limits each group inside the input partitions first (WindowGroupLimit),
    so a hot group shuffles at most ``k`` rows per partition.
    """
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col(rank) <= k)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], first: bool = False) -> DataFrame:
    """One row per key, the last (or first) by ``order``; a partial aggregate, so a hot key costs one row per partition."""
    rest = [c for c in df.columns if c not in keys]
    by = F.min_by if first else F.max_by
    body = F.struct(*[F.col(c) for c in rest])
    return (df.groupBy(*keys).agg(by(body, F.struct(*[F.col(c) for c in order])).alias("_row"))
            .select(*keys, *[F.col("_row")[c].alias(c) for c in rest]))
