"""Removal of repeated runs of lines, found by winnowing.

A run of lines is long enough if it has ``least_lines`` lines or ``least_words``
words. From every line on, the shortest run that is long enough is a window, and
the line with the least hash in it is selected as a fingerprint: places that share
a run share the window at its start, so they share a fingerprint at the same line
of it. Only fingerprints that occur twice go on. Each occurrence extends to both
sides by the runs its windows start, and is joined on them, always with the
earliest place that has the same run. Overlapping matches make up the whole
repeated run, however long, and its lines are deleted in the later place.

Joins are by shared lines and always with one earliest place, so a run that a
third of all documents have costs one row per place and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Rolling, as_bytes, slices, sql_type, store

LEAST_LINES, LEAST_WORDS = 3, 50
BASE = 0x9E3779B97F4A7C15


def line_codes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per line 128 bits of hash as two numbers, and its words; blanks at its ends are left out. Lines of no word have the
    greatest first number, so that they are fingerprints only where no other line can be."""
    codes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.strip()) for x in lines), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    words = np.fromiter((len(x.split()) for x in lines), dtype=np.int64, count=len(lines))
    codes[words == 0, 0] = np.iinfo(np.uint64).max
    return codes, words


def windows(codes: np.ndarray, words: np.ndarray, room: np.ndarray, least_lines: int, least_words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per line the fingerprint of the window that starts there, and for every size from 1 on the lines at which a run of
    that size starts that must be compared; ``room`` holds how many lines the text has from each line on.

    A run is left out if both its runs of one line less are long enough, as these delete the same lines.
    """
    n = len(words)
    at, sums = np.arange(n), np.concatenate([[0], np.cumsum(words)])
    best, before, starts = at.copy(), np.zeros(n + 1, dtype=bool), []
    for size in range(1, least_lines + 1):
        inside = room >= size
        # while no window from a line on is long enough, it takes in one line more; of equal lines the last is selected
        grow = inside & ~before[:n]
        last = np.minimum(at + size - 1, n - 1)
        best = np.where(grow & (codes[last, 0] <= codes[best, 0]), last, best)
        enough = np.zeros(n + 1, dtype=bool)
        enough[:n] = inside & ((size == least_lines) | (sums[np.minimum(at + size, n)] - sums[:n] >= least_words))
        starts.append(np.flatnonzero(enough[:n] & ~(before[:-1] & before[1:])))
        before = enough
    return best, starts


def _select_task(least_lines: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASE)
        for batch in slices(batches):
            texts = [[] if text is None else text.split(b"\n") for text in as_bytes(batch.column(1))]
            counts = np.array([len(x) for x in texts], dtype=np.int64)
            row = np.repeat(np.arange(len(texts)), counts)
            first = (np.cumsum(counts) - counts)[row]
            codes, words = line_codes([x for lines in texts for x in lines])
            at = np.arange(len(words))
            best, starts = windows(codes, words, counts[row] - (at - first), least_lines, least_words)
            size = np.repeat(np.arange(1, least_lines + 1), [len(x) for x in starts])
            hashes = np.concatenate([rolling(codes[:, 1], k)[x] for k, x in enumerate(starts, 1)]).view(np.int64)
            start = np.concatenate(starts)
            order = np.argsort(best[start], kind="stable")
            start, size, hashes = start[order], size[order], hashes[order]
            selected, cuts = np.unique(best[start], return_index=True)
            around = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(start)), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(start - first[start], pa.int64()), pa.array(size, pa.int64()), pa.array(hashes, pa.int64())], ["start", "size", "run"]))
            take = pa.array(row[selected], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(selected - first[selected], pa.int64()),
                 pa.array(codes[selected, 0].view(np.int64), pa.int64()), around], ["id", "key", "place", "print", "around"])
    return run


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES,
                  least_words: int = LEAST_WORDS) -> DataFrame:
    """Matches ``(id, key, start, size, source, source_start)``: ``size`` lines from line ``start`` on that also start at an
    earlier place, the earliest of all; ``key`` tells texts of one id apart. Longer matches are several that overlap."""
    kind = sql_type(docs, id_col)
    texts = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    selected = store(texts.mapInArrow(
        _select_task(least_lines, least_words),
        f"id {kind}, key bigint, place bigint, print bigint, around array<struct<start: bigint, size: bigint, run: bigint>>"), "prints")
    often = selected.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    sides = (selected.join(often, "print", "left_semi").select("id", "key", "place", "print", F.inline("around"))
             .withColumn("left", F.col("place") - F.col("start")).drop("place"))
    # the run of all lines decides; print and left say where the fingerprint stands in it
    first = (sides.groupBy("print", "left", "size", "run").agg(F.min(F.struct("id", "start")).alias("source"), F.count("*").alias("n"))
             .filter("n > 1").drop("n"))
    return (sides.join(first, ["print", "left", "size", "run"])
            .filter("struct(id, start) > source")
            .select("id", "key", "start", "size", F.col("source.id").alias("source"), F.col("source.start").alias("source_start")))


def _delete_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, counts, removed = [], [], []
        for text, runs in zip(as_bytes(batch.column(1)), batch.column(3)):
            lines = text.split(b"\n") if text is not None else []
            counts.append(len(lines))
            if runs.is_valid:
                cover = np.zeros(len(lines) + 1, dtype=np.int64)
                start, size = (np.asarray(runs.values.field(k)) for k in ("start", "size"))
                np.add.at(cover, start, 1)
                np.add.at(cover, start + size, -1)
                keep = np.cumsum(cover[:-1]) == 0
                removed.append(len(lines) - int(keep.sum()))
                text = b"\n".join([x for x, k in zip(lines, keep.tolist()) if k])
            else:
                removed.append(0)
            texts.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()),
             pa.array(removed, pa.int64()), batch.column(2)], ["id", "text", "n_lines", "n_removed", "rest"])


def _rewritten(docs: DataFrame, rest: list[str], id_col: str, text_col: str, least_lines: int, least_words: int) -> DataFrame:
    runs = (repeated_runs(docs, id_col, text_col, least_lines, least_words).groupBy("id", "key")
            .agg(F.collect_set(F.struct("start", "size")).alias("runs")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"),
                        F.struct(*rest, F.lit(0).alias("_")).alias("rest"))
    joined = texts.join(runs, ["id", "key"], "left").select("id", "text", "rest", "runs")
    kind = joined.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(_delete_task, f"id {sql_type(docs, id_col)}, text string, n_lines bigint, n_removed bigint, rest {kind}")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES,
                        least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``text`` without repeated lines, ``n_lines`` and ``n_removed``.

    A line goes if it lies in a run of lines, of ``least_lines`` lines or more or of ``least_words`` words or more, that
    also starts at an earlier place: in a document with a smaller id, or further up in the same one. So one long line
    that an earlier document has goes too, with short lines beside it that are the same in both. Lines are what stands between line ends, blanks at their ends
    left out for the comparison; runs are judged on the input, not on what is left. A null text stays null and has no
    lines; an empty text is one empty line. Repeated rows share their places, so neither is earlier, and each comes
    back. Rows whose id is null are no place and keep all lines. Other columns are not looked at. An empty table gives
    an empty result.
    """
    out = _rewritten(docs, [], id_col, text_col, least_lines, least_words)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_removed")


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars",
            least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs``, all columns, with the texts of ``drop_repeated_lines`` and ``size_col``, if there, counted anew."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    out = _rewritten(docs, rest, id_col, text_col, least_lines, least_words)
    columns = {id_col: F.col("id"), text_col: F.col("text"), **{c: F.col("rest")[c] for c in rest}}
    if size_col in rest:
        columns[size_col] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[size_col].dataType)).otherwise(F.col("rest")[size_col])
    return out.select(*[columns[c].alias(c) for c in docs.columns])
