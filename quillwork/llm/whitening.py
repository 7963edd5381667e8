"""Whitening of embeddings with an exact, bit-sliced scatter matrix.

Vectors become integers, ``x = floor(scale * c)``, and every distinct one counts
once. Blocks of rows are shifted to start at zero in each dimension and cut into
bit planes, 64 rows a word. The ones that two planes share, counted with AND and
weighted by both places, add up to the cross-product of two dimensions without
rounding. Sums and cross-products are added over all tasks as whole numbers;
``n * sum(x y) - sum(x) * sum(y)`` is centred before anything is rounded, and
only then do the eigenvectors come from ``eigh``.

What reaches the driver, and what is sent back, depends on the number of
dimensions alone: half a square matrix, and a few directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import sql_type, store

SCALE = 256
ROWS = 1 << 14
DIGIT = 16
LIMB = 60
WIDTHS = (1, 2, 4, 8)


def quantised(column: pa.Array, scale: int = SCALE) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(rows, x)`` per length of vectors in the column: places of its usable rows and their integers, one row each.

    A row is not usable if it is null or empty, or has an entry that is null, infinite or not a number. Integers
    beyond a long are set to its end.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    starts = np.cumsum(lengths) - lengths
    out = []
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        found = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(found).all(axis=1)
        with np.errstate(over="ignore"):
            whole = np.floor(scale * found[good])
        top = whole >= 2.0 ** 63
        x = np.where(top | (whole < -2.0 ** 63), 0.0, whole).astype(np.int64)
        x[top] = np.iinfo(np.int64).max
        x[whole < -2.0 ** 63] = np.iinfo(np.int64).min
        out.append((rows[good], x))
    return out


def pack_rows(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the least width that holds it; equal rows give equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), dtype=bool)
    for width in WIDTHS:
        info = np.iinfo(f"i{width}")
        now = np.flatnonzero(left & (low >= info.min) & (high <= info.max))
        left[now] = False
        data = x[now].astype(f"<i{width}").tobytes()
        step = width * x.shape[1]
        for at, row in enumerate(now.tolist()):
            out[row] = bytes([width]) + data[at * step:(at + 1) * step]
    return out


def unpack_rows(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), dtype=np.int64)
    widths = np.array([r[0] for r in rows], dtype=np.int64)
    for width in np.unique(widths):
        now = np.flatnonzero(widths == width)
        data = b"".join([rows[i][1:] for i in now.tolist()])
        out[now] = np.frombuffer(data, dtype=f"<i{width}").reshape(-1, dims)
    return out


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the rows as Python integers; of the products only the upper half is filled."""
    n, dims = x.shape
    shift = x.min(axis=0)
    u = x.view(np.uint64) - shift.view(np.uint64)
    bits = max(1, int(u.max()).bit_length())
    pad = np.zeros((-(-n // 64) * 64, dims), dtype=np.uint64)
    pad[:n] = u
    planes = np.empty((dims, bits, len(pad) // 64), dtype=np.uint64)
    for b in range(bits):
        one = np.ascontiguousarray(((pad >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T)
        planes[:, b] = np.packbits(one, axis=1, bitorder="little").view("<u8")
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    digits = -(-bits // DIGIT)
    place = np.left_shift(np.int64(1), np.arange(bits) % DIGIT)
    products = np.zeros((digits, digits, dims, dims), dtype=np.int64)
    for i in range(dims):
        for a in range(bits):
            if ones[i, a]:
                shared = np.bitwise_count(planes[i, a] & planes[i:]).sum(axis=2, dtype=np.int64) * (place * place[a])
                for d in range(digits):
                    products[a // DIGIT, d, i, i:] += shared[:, d * DIGIT:(d + 1) * DIGIT].sum(axis=1)
    m = shift.astype(object)
    su = (ones.astype(object) * np.array([1 << b for b in range(bits)], dtype=object)).sum(axis=1)
    uu = sum(products[p, q].astype(object) * (1 << DIGIT * (p + q)) for p in range(digits) for q in range(digits))
    return su + n * m, uu + np.outer(su, m) + np.outer(m, su) + n * np.outer(m, m)


def _limbs(values: list[int]) -> list[pa.Array]:
    mask = (1 << LIMB) - 1
    return [pa.array([v & mask for v in values], pa.int64()), pa.array([(v >> LIMB) & mask for v in values], pa.int64()),
            pa.array([v >> 2 * LIMB for v in values], pa.int64())]


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    held: list[bytes] = []
    for batch in batches:
        held += batch.column(0).to_pylist()
        while len(held) >= ROWS:
            yield unpack_rows(held[:ROWS], dims)
            held = held[ROWS:]
    if held:
        yield unpack_rows(held, dims)


def _quantise_task(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in quantised(batch.column(0), scale):
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pack_rows(x), pa.binary()), pa.array(np.full(len(rows), x.shape[1]), pa.int64())], ["x", "dims"])
    return run


def _scatter_task(dims: int):
    upper = np.triu_indices(dims)
    first = np.concatenate([np.full(dims, -1), upper[0]])
    second = np.concatenate([np.arange(dims), upper[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches, dims):
            sums, products = scatter(block)
            found = np.concatenate([sums, products[upper]])
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(first, pa.int64()), pa.array(second, pa.int64()), *_limbs(total.tolist())], ["i", "j", "low", "mid", "high"])
    return run


@dataclass
class Whitening:
    """What is needed to whiten a row: count and sums of the fit list, directions over the roots of their eigenvalues,
    and the figures reported with them."""
    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: longs where they hold it, else Python integers."""
        bound = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums))
        if bound < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows of ``y = n * x - sums``; added up in one order, so equal rows have equal results."""
        z = y.astype(np.float64) / self.n
        out = np.zeros((len(z), self.directions.shape[1]))
        for d in range(z.shape[1]):
            out += z[:, d, None] * self.directions[d]
        return out


def deviations(y: np.ndarray) -> list[int]:
    """Sum of squares of each row, exact: the low 64 bits by wrapped products, the rest from the rounded sum."""
    if y.dtype == object:
        return [int(v) for v in (y * y).sum(axis=1)]
    low = (y.view(np.uint64) * y.view(np.uint64)).sum(axis=1, dtype=np.uint64)
    f = y.astype(np.float64)
    about = (f * f).sum(axis=1)
    if about.max() >= 2.0 ** 110:
        return [sum(v * v for v in row) for row in y.tolist()]
    high = np.rint((about - low.astype(np.float64)) / 2.0 ** 64).astype(np.int64)
    return [a + (b << 64) for a, b in zip(low.tolist(), high.tolist())]


def _check_task(model: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.directions.shape[1]
        sums, products = np.zeros(k), np.zeros((k, k))
        for block in _blocks(batches, len(model.sums)):
            w = model.project(model.centred(block))
            sums += w.sum(axis=0)
            products += w.T @ w
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(k, -1), i]), pa.int64()), pa.array(np.concatenate([np.arange(k), j]), pa.int64()),
             pa.array(np.concatenate([sums, products.ravel()]))], ["i", "j", "v"])
    return run


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = 4, scale: int = SCALE) -> Whitening | None:
    """Whitening by the distinct integer vectors of the table; None if it has no usable vector.

    Vectors of another length than most (of the distinct ones; ties: the longer) take no part. Directions whose
    eigenvalue is zero within rounding are left out, so there may be fewer than ``components``.
    """
    raw = vectors.select(F.col(vec_col).alias("v")).mapInArrow(_quantise_task(scale), "x binary, dims bigint")
    distinct = store(raw.distinct(), "vectors")
    common = distinct.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return None
    dims, n = int(common["dims"]), int(common["count"])
    rows = distinct.filter(F.col("dims") == dims).select("x")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "mid", "high")]
    found = (rows.mapInArrow(_scatter_task(dims), "i bigint, j bigint, low bigint, mid bigint, high bigint")
             .groupBy("i", "j").agg(*wide).collect())
    value = {(r["i"], r["j"]): int(r["low"]) + (int(r["mid"]) << LIMB) + (int(r["high"]) << 2 * LIMB) for r in found}
    sums = [value[-1, d] for d in range(dims)]
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * value[i, j] - sums[i] * sums[j]) / (n * n)
    e, vec = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")[:components]
    trace = float(np.trace(cov))
    order = order[e[order] > trace * dims * np.finfo(float).eps]
    e, vec = e[order], vec[:, order]
    if len(order):
        vec = vec * np.where(vec[np.abs(vec).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    model = Whitening(n, sums, vec / np.sqrt(e), e, e / trace if trace > 0 else e)
    if len(order):
        got = rows.mapInArrow(_check_task(model), "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        total = {(r["i"], r["j"]): r["v"] for r in got}
        k = range(len(order))
        model.identity_error = max(abs(total[a, b] / n - total[-1, a] / n * total[-1, b] / n - (a == b)) for a in k for b in k)
    return model


def _whiten_task(model: Whitening, scale: int):
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in quantised(batch.column(1), scale):
                if not len(rows) or x.shape[1] != len(model.sums):
                    continue
                y = model.centred(x)
                off = pa.array([v if v < 10 ** 38 else None for v in deviations(y)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                     off.take(each), pa.array(model.project(y).ravel()), pa.array(np.tile(model.explained, len(rows)))],
                    ["id", "component", "deviation", "whitened", "explained"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4,
           scale: int = SCALE) -> DataFrame:
    """Per usable row and component (from 1, by falling eigenvalue): ``id_col``, ``component``, ``n`` (distinct vectors),
    ``deviation`` (sum of squares of ``n * x - sums``, exact, null from 10**38 on), ``whitened``, ``explained`` and
    ``identity_error``.

    Rows with a null or empty vector, or with an entry that is null or not finite, are dropped, and so are rows of
    another length than most. Repeated rows and ids, null ids too, each come back. With a single distinct vector, or
    none, there are no directions and no rows. Other columns are not looked at.
    """
    model = fit(vectors, vec_col, components, scale)
    kind = f"id {sql_type(vectors, id_col)}, component int, deviation decimal(38,0), whitened double, explained double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    if model is None or not len(model.values):
        found = rows.filter("false").mapInArrow(lambda batches: iter(()), kind)
        model = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    else:
        found = rows.mapInArrow(_whiten_task(model, scale), kind)
    return found.select(F.col("id").alias(id_col), "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                        "explained", F.lit(model.identity_error).cast("double").alias("identity_error"))
