"""Near duplicates by 64-bit SimHash and a Gray-order hierarchical index.

Fingerprints within ``max_bits`` differences agree on at least one of
``max_bits + 1`` blocks of their bits, so each distinct fingerprint goes to one
bucket per block. In a bucket, fingerprints are sorted by Gray rank: neighbours
in that order share long bit patterns. Runs of neighbours become leaves, runs of
leaves upper nodes, and every node stores the bits that all its members share.
Two nodes are compared by the differences of their shared bits, which only grow
further down: above ``max_bits`` both whole groups are pruned, and where even the
bits that are not shared cannot exceed ``max_bits``, both groups are linked as a
whole. A bucket gives each member a link to the first member of its class, which
keeps all that is reachable without writing all pairs.

Buckets over ``slab`` members are dealt into slabs by hash and compared slab by
slab, so that one task never holds more than two slabs of a hot bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .textkit import as_bytes, slices, sql_type, store

SEED = 42
FANOUT = 8
FRONT = 1 << 13
SLICE_BYTES = 1 << 20
BIT_ROWS = 1 << 15


def shingle_hashes(text: bytes | None, width: int) -> list[int]:
    words = text.lower().split() if text else []
    if not words:
        return []
    joined, xx = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [xx(joined, SEED)]
    sizes = list(map(len, words))
    ends = [e + i for i, e in enumerate(accumulate(sizes))]
    return [xx(joined[e - n:stop], SEED) for e, n, stop in zip(ends, sizes, ends[width - 1:])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document (``counts`` hashes each): bits set in over half its hashes; zero where it has none."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    block = starts // BIT_ROWS
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(full)]
    for lo, hi in zip(cuts, cuts[1:]):
        part = full[lo:hi]
        a, b = starts[lo], starts[lo] + counts[part].sum()
        bits = np.unpackbits(hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        set_ = np.add.reduceat(bits, starts[lo:hi] - a, axis=0, dtype=np.int32)
        out[part] = np.packbits(2 * set_ > counts[part][:, None], axis=1).view(">u8").ravel()
    return out


def _fingerprint_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE_BYTES):
            hashes = [shingle_hashes(t, width) for t in as_bytes(batch.column(1))]
            counts = np.array([len(h) for h in hashes], dtype=np.int64)
            found = majority(np.fromiter(chain.from_iterable(hashes), dtype=np.uint64, count=counts.sum()), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``(id_col, fp)`` per row: SimHash as a signed long. Null and blank texts have fingerprint zero."""
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
            .mapInArrow(_fingerprint_task(width), f"id {sql_type(docs, id_col)}, fp bigint")
            .select(F.col("id").alias(id_col), "fp"))


def blocks(parts: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of ``parts`` blocks that cover 64 bits."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints sorted by Gray rank; level 0 are the fingerprints."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps[np.argsort(gray_rank(fps), kind="stable")]
        self.levels = [(self.fps, self.fps)]
        while len(self.levels[-1][0]) > 1:
            lo, hi = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_and.reduceat(lo, at), np.bitwise_or.reduceat(hi, at)))

    def members(self, level: int, node: int) -> tuple[int, int]:
        span = FANOUT ** level
        return node * span, min((node + 1) * span, len(self.fps))

    def classes(self, max_bits: int) -> np.ndarray:
        """Class of each fingerprint: the least place reachable over links of at most ``max_bits`` differences."""
        label = np.arange(len(self.fps))
        stack = [(len(self.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONT:
                mid = len(a) // 2
                stack += [(level, a[mid:], b[mid:]), (level, a[:mid], b[:mid])]
                continue
            lo, hi = self.levels[level]
            shared = ~((lo[a] ^ hi[a]) | (lo[b] ^ hi[b]))
            least = np.bitwise_count((lo[a] ^ lo[b]) & shared).astype(np.int64)
            most = least + np.bitwise_count(~shared)
            if level == 0:
                hit = (least <= max_bits) & (a != b)
                join(label, a[hit], b[hit])
                continue
            whole = most <= max_bits
            if whole.any():
                join_nodes(self, label, level, a[whole], b[whole])
            go = (least <= max_bits) & ~whole
            a, b = a[go], b[go]
            if not len(a):
                continue
            size = len(self.levels[level - 1][0])
            step = np.arange(FANOUT)
            x = np.broadcast_to(a[:, None, None] * FANOUT + step[None, :, None], (len(a), FANOUT, FANOUT)).ravel()
            y = np.broadcast_to(b[:, None, None] * FANOUT + step[None, None, :], (len(a), FANOUT, FANOUT)).ravel()
            ok = (x <= y) & (y < size)
            stack.append((level - 1, x[ok], y[ok]))
        return label


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of ``a[i]`` and ``b[i]`` in place; a class carries its least place."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def join_nodes(index: GrayIndex, label: np.ndarray, level: int, a: np.ndarray, b: np.ndarray) -> None:
    heads, tails = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        start, stop = index.members(level, x)
        start2, stop2 = index.members(level, y)
        rows = np.concatenate([np.arange(start, stop), np.arange(start2, stop2)])
        heads.append(np.full(len(rows), start))
        tails.append(rows)
    join(label, np.concatenate(heads), np.concatenate(tails))


def _bucket_task(max_bits: int):
    def links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index = GrayIndex(fps)
        label = index.classes(max_bits)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return index.fps[moved], index.fps[label[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, fps = (np.concatenate(x) for x in zip(*held))
            held.clear()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            edges = np.concatenate([[0], cuts, [len(keys)]])
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    out.append(links(fps[a:b]))
            if out:
                one, two = (np.concatenate(x).view(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a", "b"])

        for batch in batches:
            keys, fps = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            fps = fps.view(np.uint64)
            last = np.flatnonzero(keys != keys[-1])
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                held.append((keys[:cut], fps[:cut]))
            elif held and held[-1][0][-1] != keys[0]:
                yield from flush()
            if cut and held:
                yield from flush()
            held.append((keys[cut:], fps[cut:]))
        if held:
            yield from flush()
    return run


def fingerprint_links(nodes: DataFrame, max_bits: int = 4, slab: int = 4096) -> DataFrame:
    """Links ``(a, b)`` of signed fingerprints that keep every class of ``nodes (fp)``, which are distinct."""
    keyed = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"),
                 F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
        for i, (s, w) in enumerate(blocks(max_bits + 1))])).alias("k")).select("fp", "k.block", "k.value")
    sized = keyed.groupBy("block", "value").count().filter("count > 1").select(
        "block", "value", F.ceil(F.col("count") / slab).cast("int").alias("slabs"))
    dealt = keyed.join(sized, ["block", "value"]).withColumn("own", F.expr("CAST(pmod(xxhash64(fp), slabs) AS INT)"))
    # a slab meets every slab of its bucket once: the pair is named by (smaller, larger)
    paired = dealt.withColumn("other", F.explode(F.expr("sequence(0, slabs - 1)"))).filter("slabs = 1 OR own <> other")
    keys = paired.select("fp", F.xxhash64("block", "value", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (keys.repartition(parts, "key").sortWithinPartitions("key").select("key", "fp")
            .mapInArrow(_bucket_task(max_bits), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    max_bits: int = 4, slab: int = 4096) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``fp`` and ``component_id``, the smallest id reachable over links of ``fp``.

    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows each come back. Rows
    whose id is null take part in links but never name a component; a class of such rows only has a null one.
    Other columns are not looked at. An empty table gives an empty result.
    """
    rows = store(fingerprints(docs, id_col, text_col, width).select(F.col(id_col).alias("_id"), "fp"), "fingerprints")
    nodes = rows.select("fp").distinct()
    roots = components(fingerprint_links(nodes, max_bits, slab)).select(F.col("node").alias("fp"), "root")
    least = rows.groupBy("fp").agg(F.min("_id").alias("least"))
    classes = least.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = classes.join(named, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")
