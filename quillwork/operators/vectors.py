"""Nearest vectors per query, exact and approximate.

Similarities are block products inside tasks: chunk blocks meet query blocks on
an equi-join key (search scope, cell, block numbers), and only the best ``k`` per
query leave a block. Blocks have a bounded number of rows, so a scope or cell
that holds a third of all vectors becomes many tasks, not one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..session import cut_lineage
from .scan import top_per_group

CHUNK_BLOCK = 131072
QUERY_BLOCK = 32768
BLOCK_BYTES = 32 << 20   # of the vectors of a block of chunks in single precision
QUERY_TILE, TILE = 1024, 4096
EXACT = 65536            # pairs whose similarity is taken at once in double precision
SIM_DIGITS = 9     # ranks use similarities rounded to this, so equal vectors tie in every engine
MARGIN = 1e-6      # slack of the cell bounds against rounding

ARROW_HIT = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("sim", pa.float64())])
HIT = StructType([StructField("query_id", LongType()), StructField("chunk_id", LongType()), StructField("sim", DoubleType())])


def unit_rows(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a list column."""
    held = vectors.combine_chunks()
    m = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _cut(rows: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by row and falling similarity; the place of each entry in its row with it, and the k-th similarity of full rows."""
    order = np.lexsort((-sims, rows))
    sorted_rows = rows[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows, side="left")
    kth = np.flatnonzero(place == k - 1)
    return order, sorted_rows[kth], sims[order][kth]


def _candidates(q: np.ndarray, c: np.ndarray, k: int, least: float, error: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row of q, row of c)`` of all pairs that may be among the best ``k`` of a row of ``q``.

    Products are taken in single precision, at most ``error`` off; what is that near to the k-th best found so far stays.
    """
    floor = np.full(len(q), least - error, dtype=np.float64)
    odd = np.isnan(q).any() or np.isnan(c).any()
    rows, cols, sims = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float32))
    for at in range(0, len(c), TILE):
        product = q @ c[at:at + TILE].T
        if odd:
            product[np.isnan(product)] = -2.0
        if at == 0 and product.shape[1] > k:
            floor = np.maximum(floor, np.partition(product, -k, axis=1)[:, -k] - 2 * error)
        r, i = np.divmod(np.flatnonzero(product >= floor.astype(np.float32)[:, None]), product.shape[1])
        rows, cols, sims = np.concatenate([rows, r]), np.concatenate([cols, i + at]), np.concatenate([sims, product[r, i]])
        if len(rows) > 4 * k * len(q) or at + TILE >= len(c):
            _, full, kth = _cut(rows, sims, k)
            floor[full] = np.maximum(floor[full], kth - 2 * error)
            near = sims >= floor[rows]
            rows, cols, sims = rows[near], cols[near], sims[near]
    return rows, cols


def best_of_block(queries: pa.Table, chunks: pa.Table, k: int, min_sim: float | None) -> pa.Table:
    """Top ``k`` chunks of one block for each query of one block, ties by chunk id."""
    out: list[pa.Table] = []
    if queries.num_rows and chunks.num_rows:
        names, ids = (t.column(c).cast(pa.int64()).to_numpy() for t, c in ((queries, "query_id"), (chunks, "chunk_id")))
        q, c = _matrix(queries.column("embedding")), _matrix(chunks.column("embedding"))
        q32, c32 = q.astype(np.float32), c.astype(np.float32)
        error = (q.shape[1] + 8) * 1.2e-7 + 10.0 ** -SIM_DIGITS
        for at in range(0, len(q), QUERY_TILE):
            rows, cols = _candidates(q32[at:at + QUERY_TILE], c32, k, -3.0 if min_sim is None else min_sim, error)
            sims = np.concatenate([np.round(np.einsum("ij,ij->i", q[at + rows[i:i + EXACT]], c[cols[i:i + EXACT]]), SIM_DIGITS)
                                   for i in range(0, len(rows), EXACT)] or [np.zeros(0)])
            order = np.lexsort((ids[cols], -sims, rows))
            rows, cols, sims = rows[order], cols[order], sims[order]
            best = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
            if min_sim is not None:
                best &= sims >= min_sim
            out.append(pa.table([names[at + rows[best]], ids[cols[best]], sims[best]], ARROW_HIT))
    return pa.concat_tables(out) if out else ARROW_HIT.empty_table()


def _limits(chunks: DataFrame) -> tuple[int, int]:
    """Rows of a block of queries and of chunks, fewer for long vectors."""
    first = chunks.select(F.size("embedding")).first()
    fit = max(TILE, BLOCK_BYTES // (4 * max(1, first[0]))) if first else CHUNK_BLOCK
    return min(QUERY_BLOCK, max(QUERY_TILE, fit // 4)), min(CHUNK_BLOCK, fit)


def _block_join(queries: DataFrame, chunks: DataFrame, keys: list[str], k: int, min_sim: float | None) -> DataFrame:
    """Best ``k`` per query and block over equal ``keys``."""
    q_rows, c_rows = _limits(chunks)
    if not keys:   # one group: the number of blocks is a plain number; blocks are smaller where cores would idle
        cores = chunks.sparkSession.sparkContext.defaultParallelism
        n_chunks, n_queries = chunks.count(), queries.count()
        qb = max(1, -(-n_queries // q_rows), min(cores, n_queries // QUERY_TILE))
        cb = max(1, -(-n_chunks // c_rows), min(-(-cores // qb), n_chunks // TILE))
        left = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("_j"),
                              F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("_i"))
        right = chunks.select(*[F.col(c).alias(c) for c in ("chunk_id", "embedding")],
                              F.pmod(F.xxhash64("chunk_id"), F.lit(cb)).cast("int").alias("_i"),
                              F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("_j"))
        return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(
            lambda q, c: best_of_block(q, c, k, min_sim), HIT)
    q_count = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(q_rows))).cast("int").alias("_qb"))
    c_count = chunks.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(c_rows))).cast("int").alias("_cb"))
    grid = q_count.join(c_count, keys)
    left = queries.join(grid, keys).select(
        *keys, "query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.col("_qb")).cast("int").alias("_j"),
        F.explode(F.sequence(F.lit(0), F.col("_cb") - 1)).alias("_i"))
    # fresh names on this side: both sides may come from one table
    right = chunks.join(grid, keys).select(
        *[F.col(c).alias(c) for c in (*keys, "chunk_id", "embedding")], F.pmod(F.xxhash64("chunk_id"), F.col("_cb")).cast("int").alias("_i"),
        F.explode(F.sequence(F.lit(0), F.col("_qb") - 1)).alias("_j"))
    by = [*keys, "_i", "_j"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(
        lambda q, c: best_of_block(q, c, k, min_sim), HIT)


def _pivots(chunks: DataFrame, cells: int) -> np.ndarray:
    """At most ``cells`` vectors by hash order; their number and size are fixed by the argument."""
    rows = (chunks.select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(cells)
            .select("embedding").collect())
    return unit_rows(pd.Series([r[0] for r in rows])) if rows else np.zeros((0, 1))


def _distances(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit_rows(vectors) @ pivots.T)))


def with_cell(chunks: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot of each chunk and the distance to it."""
    kind = StructType([StructField("cell", IntegerType()), StructField("far", DoubleType())])

    @F.pandas_udf(kind)
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = _distances(batch, pivots)
            cell = d.argmin(axis=1)
            yield pd.DataFrame({"cell": cell.astype("int32"), "far": d[np.arange(len(d)), cell]})

    return chunks.withColumn("_c", nearest("embedding")).select("*", "_c.cell", "_c.far").drop("_c")


def _visits(queries: DataFrame, pivots: np.ndarray, choose) -> DataFrame:
    @F.pandas_udf(ArrayType(IntegerType()))
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([choose(d).astype("int32") for d in _distances(batch, pivots)], dtype=object)

    return queries.withColumn("cell", F.explode(cells("embedding")))


def _solid(queries: DataFrame, chunks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return (queries.filter("embedding is not null").select(*keys, "query_id", "embedding"),
            chunks.filter("embedding is not null").select(*keys, "chunk_id", "embedding"))


def _final(hits: DataFrame, k: int) -> DataFrame:
    return top_per_group(hits, ["query_id"], [F.desc("sim"), F.col("chunk_id")], k)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, keys: list[str] | None = None,
                min_sim: float | None = None, cells: int | None = None) -> DataFrame:
    """RET-3: exact best ``k`` by cosine; ``keys`` are scope columns that must agree.

    With ``cells``, chunks are put into that many cells around pivots. With the
    distance of the query to a pivot and the radius of its cell, the triangle
    inequality bounds the k-th distance from above and each cell from below, and
    cells that cannot hold a hit are left out. The result stays exact. It pays
    where vectors lie in clusters; a question visits nearly all cells of others,
    and every visit brings ``k`` rows, so cells are not taken by default.

    The chunks are written once, as their number and size are asked for first.
    """
    keys = keys or []
    q, c = _solid(queries, chunks, keys)
    c = cut_lineage(c)
    if keys or not cells or cells < 2:
        return _final(_block_join(q, c, keys, k, min_sim), k)
    pivots = _pivots(c, cells)
    placed = with_cell(c, pivots)
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()}
    names = np.array(sorted(stats), dtype=np.int64)
    sizes = np.array([stats[i]["n"] for i in names], dtype=np.int64)
    radii = np.array([stats[i]["r"] for i in names], dtype=np.float64)

    def choose(d: np.ndarray) -> np.ndarray:
        if not len(names):
            return names
        reach = d[names] + radii
        order = np.argsort(reach)
        enough = np.searchsorted(np.cumsum(sizes[order]), k)
        bound = reach[order[min(enough, len(order) - 1)]]
        return names[np.maximum(0.0, d[names] - radii) <= bound + MARGIN]

    return _final(_block_join(_visits(q, pivots, choose), placed.drop("far"), ["cell"], k, min_sim), k)


def ann_topk(queries: DataFrame, chunks: DataFrame, k: int, cells: int = 32, probes: int = 4) -> DataFrame:
    """RET-4: approximate search in the ``probes`` nearest cells, scores exact."""
    q, c = _solid(queries, chunks, [])
    c = cut_lineage(c)
    pivots = _pivots(c, cells)
    placed = with_cell(c, pivots).drop("far")
    hits = _block_join(_visits(q, pivots, lambda d: np.argsort(d, kind="stable")[:probes]), placed, ["cell"], k, None)
    return _final(hits, k)


def recall_against(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact hits the approximate search found, per query."""
    found = exact.join(approx.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return found.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
