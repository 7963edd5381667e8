"""Removal of repeated word windows across documents, with a count-min prefilter.

Pass one reads the texts and notes for each document its stretches: every window of
``window`` words is represented by its anchor, the least hash among its runs of
``gram`` words, and neighbouring windows under one anchor form a stretch, kept as its
anchor and 128 bits of hash of its words. Equal windows have equal anchors, so the
number of documents with a window's anchor is never below the number with the window.
Partitions count anchors in count-min sketches, whose cells are cut into shards and
merged shard by shard; the sketch is sized by the number of anchors, and no task holds
more than a shard of it.

Pass two takes only stretches whose anchor is estimated in two or more documents and
groups exactly, by 128-bit hashes; equal stretches are settled by their smallest
document. Only where different stretches share an anchor, all places of each in its
smallest document are grouped window by window. An estimate is never too low, so no
repeat is lost. Documents with the very words of an earlier one are settled by their
digest. Texts are moved compressed, and only to look at windows and to cut; shuffle
files of a finished step are removed (``store``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Rolling, as_bytes, sliding_min, slices, sql_type, store

GRAM = 16
SHARD_BITS = 16
ROWS = 2
SKETCH_VALUES = 1 << 20
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def window_anchors(hashes: np.ndarray, rolling: Rolling, window: int, gram: int) -> np.ndarray:
    """Per window its anchor: the least hash of the runs of ``gram`` words inside."""
    return sliding_min(rolling(hashes, gram), window - gram + 1)


STRETCH = "anchor: bigint, s1: bigint, s2: bigint, start: int, count: int"


def _profile_task(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Rolling(FIRST), Rolling(SECOND)
        for batch in slices(batches):
            sizes, digests, out = [], [], []
            for text in as_bytes(batch.column(1)):
                words = text.split() if text else []
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                one = word_hashes(words) if len(words) >= window else np.empty(0, dtype=np.uint64)
                mine = window_anchors(one, first, window, gram)
                start = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])[:len(mine)])
                stop = np.append(start[1:], len(mine))[:len(start)]
                two = word_hashes(words, 1) if len(start) else one
                out.append([mine[start], first.stretches(one, start, stop + window - 1),
                            second.stretches(two, start, stop + window - 1), start, stop - start])
            ends = np.cumsum([0, *(len(x[0]) for x in out)])
            anchor, s1, s2, start, count = (np.concatenate(c) for c in zip(*out))
            found = pa.StructArray.from_arrays(
                [*(pa.array(c.view(np.int64)) for c in (anchor, s1, s2)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                ["anchor", "s1", "s2", "start", "count"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], ["id", "key", "row", "n", "digest", "stretches"])
    return run


def _cell(row: int, bits: int):
    """Cell of an anchor in a row of the sketch; the anchors are hashes, so their own bits serve."""
    return F.shiftrightunsigned("anchor", 0 if row == 0 else 64 - bits).bitwiseAND(F.lit((1 << bits) - 1))


def _sketch_task(bits: int):
    def sketch(values: np.ndarray) -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            shift = np.uint64(0 if row == 0 else 64 - bits)
            cells, counts = np.unique((values >> shift) & np.uint64((1 << bits) - 1), return_counts=True)
            shards = (cells >> np.uint64(SHARD_BITS)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(cells)]
            low = (cells & np.uint64((1 << SHARD_BITS) - 1)).astype("<u2")
            full = np.minimum(counts, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cuts) - 1, row, dtype=np.int32)), pa.array(shards[cuts[:-1]]),
                 pa.array([low[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                 pa.array([full[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                ["row", "shard", "cells", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.asarray(batch.column(0)).view(np.uint64))
            if sum(map(len, held)) >= SKETCH_VALUES:
                yield from sketch(np.concatenate(held))
                held = []
        if held and sum(map(len, held)):
            yield from sketch(np.concatenate(held))
    return run


def _merge_shard(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << SHARD_BITS, dtype=np.int64)
    for cells, counts in zip(parts["cells"], parts["counts"]):
        total[np.frombuffer(cells, dtype="<u2")] += np.frombuffer(counts, dtype=np.uint8)
    often = np.flatnonzero(total >= 2) + (int(key[1]) << SHARD_BITS)
    return pd.DataFrame({"row": np.full(len(often), key[0], dtype=np.int32), "cell": often})


def repeated_anchors(rows: DataFrame, anchors: DataFrame, bits: int) -> DataFrame:
    """``rows`` whose ``anchor`` is estimated to occur twice or more in ``anchors (anchor)``."""
    sketch = (anchors.mapInArrow(_sketch_task(bits), "row int, shard bigint, cells binary, counts binary")
              .groupBy("row", "shard").applyInPandas(_merge_shard, "row int, cell bigint"))
    often = store(sketch, "sketch")
    for row in range(ROWS):
        cells = often.filter(F.col("row") == row).select("cell")
        rows = rows.join(cells, _cell(row, bits) == F.col("cell"), "left_semi")
    return rows


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        packed = pa.array(list(map(packer.compress, as_bytes(batch.column(1)))), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(2)], ["id", "packed", "key"])


def _with_texts(texts: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """``rows (id, key, ...)`` with their text, once for each, compressed before it is moved."""
    long_ = texts.filter(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * window - 1))
    packed = long_.select("id", "text", "key").mapInArrow(_pack_task, f"id {sql_type(texts, 'id')}, packed binary, key bigint")
    return packed.join(rows, ["id", "key"]).dropDuplicates(["id", "key"])


def _unpacked(column: pa.Array) -> list[bytes]:
    """Texts that were compressed to be moved."""
    return list(map(zstandard.ZstdDecompressor().decompress, column.to_pylist()))


def _window_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Rolling(FIRST), Rolling(SECOND)
        for batch in slices(batches):
            rows, ones, twos, places = [], [], [], []
            for row, (text, stretches) in enumerate(zip(_unpacked(batch.column(1)), batch.column(2).to_pylist())):
                words = text.split()
                at = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["count"]) for x in stretches]))
                rows.append(np.full(len(at), row))
                places.append(at)
                ones.append(first(word_hashes(words), window)[at])
                twos.append(second(word_hashes(words, 1), window)[at])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(np.concatenate(rows))) for c in (0, 3)), pa.array(np.concatenate(ones).view(np.int64)),
                 pa.array(np.concatenate(twos).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))],
                ["id", "row", "w1", "w2", "start"])
    return run


def _cut_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, removed = [], []
            for text, found in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                cover = np.zeros(len(words) + 1, dtype=np.int32)
                start = np.array([x["start"] for x in found])
                np.add.at(cover, start, 1)
                np.add.at(cover, start + [x["count"] for x in found] + (window - 1), -1)
                keep = np.cumsum(cover[:-1]) == 0
                texts.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k]))
                removed.append(len(words) - int(keep.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["id", "key", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                   gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_words``, ``n_removed``, ``kept`` (the words left, joined by one space; null
    where nothing was removed) and ``digest`` (SHA-256 of all words joined by one space).

    A word goes if a window of ``window`` consecutive words covers it whose sequence also starts in a document with a
    smaller id. Words are runs without ASCII white space, unchanged. Null and blank texts have none. Repeated rows
    share an id, so none of them is earlier; each comes back. Rows whose id is null are earlier than none and keep all
    words. Other columns are not looked at. An empty table gives an empty result.
    """
    kind = sql_type(docs, id_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    profile = store(texts.select("id", "text", "key", F.monotonically_increasing_id().alias("row")).mapInArrow(
        _profile_task(window, gram), f"id {kind}, key bigint, row bigint, n bigint, digest binary, "
        f"stretches array<struct<{STRETCH}>>"), "profile")
    long_ = profile.filter(F.col("n") >= window)

    # documents with the words of an earlier one
    repeated = long_.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copies = long_.join(repeated, "digest").filter("id > first").select("id", "key").distinct()
    fresh = long_.filter("id IS NOT NULL").groupBy("id", "key").agg(F.min("row").alias("row")).join(copies, ["id", "key"], "left_anti")
    fresh = store(fresh, "fresh")

    anchors = F.array_distinct("stretches.anchor")
    total = long_.agg(F.sum(F.size(anchors))).first()[0] or 0
    bits = max(SHARD_BITS, int(4 * total).bit_length())
    likely = repeated_anchors(long_.filter("id IS NOT NULL").select("row", F.inline("stretches")),
                              long_.select(F.explode(anchors).alias("anchor")), bits)
    stretches = store(likely.join(fresh.select("row", "id"), "row"), "stretches")
    classes = store(stretches.groupBy("anchor", "s1", "s2").agg(F.min("id").alias("first"), F.max("id").alias("last")), "classes")
    kinds = classes.groupBy("anchor").agg((F.count("*") > 1).alias("mixed"))
    known = classes.join(kinds, "anchor").filter("first < last OR mixed").drop("last")
    # the smallest document of a stretch may have it at several places, and each of them is asked
    placed = store(stretches.join(known, ["anchor", "s1", "s2"]).filter("id > first OR mixed")
                   .select("row", "start", "count", F.expr("id > first").alias("settled")), "placed")
    settled = placed.filter("settled").drop("settled")
    asked = placed.filter("NOT settled").groupBy("row").agg(F.collect_list(F.struct("start", "count")).alias("stretches"))
    windows = store(_with_texts(texts, fresh.join(asked, "row"), window).select("id", "packed", "stretches", "row")
                    .mapInArrow(_window_task(window), f"id {kind}, row bigint, w1 bigint, w2 bigint, start int"), "windows")
    earliest = (windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
                .filter("first < last").drop("last"))
    later = windows.join(earliest, ["w1", "w2"]).filter("id > first").select("row", "start", F.lit(1).alias("count"))
    found = settled.union(later).groupBy("row").agg(F.collect_set(F.struct("start", "count")).alias("found"))
    cut = (_with_texts(texts, fresh.join(found, "row"), window).select("id", "packed", "found", "key")
           .mapInArrow(_cut_task(window), f"id {kind}, key bigint, n_removed bigint, kept string"))
    gone = copies.select("id", "key", F.lit(None).cast("bigint").alias("n_removed"), F.lit("").alias("kept"))
    out = profile.drop("stretches", "row").join(cut.union(gone), ["id", "key"], "left")
    n_removed = F.when(F.col("kept").isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce("n_removed", "n"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), n_removed.alias("n_removed"), "kept", "digest")
