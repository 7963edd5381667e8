"""Table functions for ``LATERAL`` joins and aggregate expressions, all plain SQL inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import LINE_END, OVERLAP, TABLE_ROWS, TARGET
from ..operators.nodes import MARKDOWN_NODES
from .text import sql_call

_NONE = "cast(array() as array<string>)"


def _long_pieces(t: str) -> str:
    step = TARGET - OVERLAP
    cuts = f"cast(ceil((length(p) - {TARGET}) / {step}.0D) as int)"
    closed = f"concat(a.out, if(a.cur <> '', array(a.cur), {_NONE}))"
    return f"""CASE WHEN length({t}) <= {TARGET} THEN array({t}) ELSE aggregate(
      filter(split({t}, r'(?<=[。！？\\n])'), p -> p <> ''), named_struct('out', {_NONE}, 'cur', ''),
      (a, p) -> CASE
        WHEN length(p) > {TARGET} THEN named_struct('out', concat({closed}, transform(sequence(0, {cuts} - 1), i -> substring(p, i * {step} + 1, {TARGET}))),
                                                  'cur', substring(p, {cuts} * {step} + 1))
        WHEN length(a.cur) + length(p) <= {TARGET} THEN named_struct('out', a.out, 'cur', a.cur || p)
        ELSE named_struct('out', {closed}, 'cur', right(a.cur, {OVERLAP}) || p) END,
      a -> concat(a.out, if(a.cur <> '', array(a.cur), {_NONE}))) END"""


def _table_pieces(t: str) -> str:
    lines = f"regexp_replace({t}, r'\\n$', '')"
    # lines are cut once, not again for each group
    return f"""transform(array(split({lines}, r'{LINE_END}')), cut ->
      CASE WHEN size(cut) <= {TABLE_ROWS + 2} THEN array({t}) ELSE transform(sequence(3, size(cut), {TABLE_ROWS}),
      i -> array_join(slice(cut, 1, 2), '\\n') || '\\n' || array_join(slice(cut, i, {TABLE_ROWS}), '\\n')) END)[0]"""


def register_table_functions(spark: SparkSession) -> None:
    """``chunk_text(t)``, ``split_table(t)`` and ``markdown_nodes(t)`` for use after LATERAL."""
    for name, body in (("chunk_text", _long_pieces("t")), ("split_table", _table_pieces("t"))):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS TABLE (piece_no INT, piece STRING) "
                  f"RETURN SELECT x.pos, x.col FROM (SELECT posexplode({body})) AS x(pos, col)")
    nodes = MARKDOWN_NODES.replace("{s}", sql_call("strip_text", t="b.raw")).replace("{t}", "t")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION markdown_nodes(t STRING) "
              "RETURNS TABLE (idx INT, type STRING, text STRING, level BIGINT) "
              f"RETURN SELECT x.pos, x.n.type, x.n.text, x.n.level FROM (SELECT posexplode({nodes})) AS x(pos, n)")


def rrf_score(rank: Column, k: int = 60) -> Column:
    """UDF-4: fused score of the ranks in a group."""
    return F.sum(1 / (k + rank))


def mrr(rank: Column) -> Column:
    """UDF-4: mean reciprocal rank; a missing rank counts 0."""
    return F.avg(F.coalesce(1 / rank, F.lit(0.0)))
