"""Benchmark passages in documents, found with an FM-index per shard of documents.

A shard is a run of documents that one task holds at a time. Its words are
numbered by the benchmark's vocabulary; any other word can be in no occurrence
and only separates. The stretches long enough for the shortest window form one
sequence, whose suffix array gives the Burrows-Wheeler transform. A wavelet
matrix over it answers ranks, all windows are searched backwards together, and
occurrences are located by walking to sampled suffix positions. Hit stretches of
a document are merged to the spans to remove.

The benchmark is the stated query set: it is broadcast in blocks of bounded
size, one map over the documents per block, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textkit import as_bytes, slices, sql_type

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
ID_BYTES = 32
SAMPLE = 8

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and everything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


class BitRanks:
    """A bit vector with the number of ones before every place."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        pad[:len(bits)] = bits
        self.words = np.packbits(pad.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def ones(self, i: np.ndarray) -> np.ndarray:
        inside = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & inside)


class WaveletMatrix:
    """Wavelet tree with its levels as whole bit vectors, highest bit first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, int, BitRanks]] = []
        for bit in reversed(range(bits)):
            one = (symbols >> bit) & 1 == 1
            self.levels.append((bit, int((~one).sum()), BitRanks(one)))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def below(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of ``i`` after sorting by ``symbol``'s bits; differences of it are ranks of ``symbol``."""
        for bit, zeros, ranks in self.levels:
            ones = ranks.ones(i)
            i = np.where((symbol >> bit) & 1 == 1, zeros + ones, i - ones)
        return i

    def at(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(i), dtype=np.int64)
        for bit, zeros, ranks in self.levels:
            one, ones = ranks[i], ranks.ones(i)
            symbol |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling. Every zero counts as a symbol of its own, least of all, in order of place."""
    n = len(symbols)
    zeros = symbols == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, symbols + zeros.sum())
    order = np.argsort(rank, kind="stable")
    _, rank = np.unique(rank, return_inverse=True)
    step = 1
    while rank.max() < n - 1:
        next_ = np.zeros(n, dtype=np.int64)
        next_[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + next_
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        step *= 2
    return order


class FmIndex:
    """Self-index of a sequence of symbols from 1 to ``sigma``, where 0 separates and is last."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        order = suffix_array(symbols)
        self.wavelet = WaveletMatrix(symbols[order - 1], max(1, int(sigma).bit_length()))
        self.first = np.searchsorted(symbols[order], np.arange(sigma + 2))
        self.base = self.wavelet.below(np.arange(sigma + 1), np.zeros(sigma + 1, dtype=np.int64))
        kept = (order % SAMPLE == 0) | (symbols[order - 1] == 0)
        self.sampled, self.places = BitRanks(kept), order[kept]

    def back(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.below(symbol, i) - self.base[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns, one per row and aligned to the right end of the row."""
        width = patterns.shape[1]
        last = patterns[:, -1]
        lo, hi = self.first[last], self.first[last + 1]
        for k in range(1, width):
            on = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(on):
                break
            symbol = patterns[on, width - 1 - k]
            lo[on], hi[on] = self.back(symbol, lo[on]), self.back(symbol, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of each suffix row."""
        found, steps, open_ = np.empty(len(rows), dtype=np.int64), 0, np.arange(len(rows))
        while len(open_):
            here = self.sampled[rows]
            done = rows[here]
            found[open_[here]] = self.places[self.sampled.ones(done)] + steps
            open_, rows = open_[~here], rows[~here]
            rows = self.back(self.wavelet.at(rows), rows)
            steps += 1
        return found


@dataclass
class Phrases:
    """The windows of one block of items: symbols aligned right, lengths, and the items of each window."""
    vocabulary: dict[bytes, int]
    symbols: np.ndarray
    lengths: np.ndarray
    items: list[list[int]]


def phrases(texts: list[bytes | None], window: int) -> Phrases:
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[int]] = {}
    for item, text in enumerate(texts):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            owners.setdefault(tuple(ids[i:i + window]), set()).add(item)
    symbols = np.zeros((len(owners), window), dtype=np.int64)
    for row, phrase in enumerate(owners):
        symbols[row, window - len(phrase):] = phrase
    return Phrases(vocabulary, symbols, np.array([len(p) for p in owners], dtype=np.int64),
                   [sorted(o) for o in owners.values()])


def occurrences(docs: list[bytes | None], asked: Phrases) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, and per occurrence its document, first word and window."""
    none = np.empty(0, dtype=np.int64)
    get, counts, parts = asked.vocabulary.get, [], []
    for text in docs:
        words = words_of(text)
        counts.append(len(words))
        parts.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
    if not len(asked.lengths) or not any(counts):
        return counts, none, none, none
    # documents side by side, each followed by a separator
    starts = np.cumsum([0, *(c + 1 for c in counts)])
    flat = np.zeros(starts[-1], dtype=np.int64)
    for start, part in zip(starts, parts):
        flat[start:start + len(part)] = part
    inside = np.concatenate([[0], (flat != 0).astype(np.int8), [0]])
    edges = np.diff(inside)
    runs = np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)])
    runs = runs[:, runs[1] - runs[0] >= asked.lengths.min()]
    if not runs.shape[1]:
        return counts, none, none, none
    sizes = runs[1] - runs[0] + 1
    ends = np.cumsum(sizes)
    origin = np.arange(ends[-1]) + np.repeat(runs[0] - (ends - sizes), sizes)
    index = FmIndex(flat[origin], len(asked.vocabulary))
    lo, hi = index.search(asked.symbols, asked.lengths)
    hits = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(hits)), hits)
    rows = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(lo, hits)
    at = origin[index.locate(rows)]
    doc = np.searchsorted(starts, at, side="right") - 1
    return counts, doc, at - starts[doc], window


def spans(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Union of stretches as maximal disjoint ones."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return list(zip(start[new].tolist(), stop[last].tolist()))


def _task(asked, ids: list[list], id_type: pa.DataType):
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Phrases = asked.value
        for batch in slices(batches, size=SHARD_BYTES):
            counts, doc, word, window = occurrences(as_bytes(batch.column(1)), block)
            found, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            order = np.argsort(doc, kind="stable")
            doc, word, window = doc[order], word[order], window[order]
            cuts = [*(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)] if len(doc) else []
            for a, b in zip([0, *cuts], cuts):
                d, known = doc[a], [(s["start"], s["stop"]) for s in found[doc[a]]]
                first = np.concatenate([[s for s, _ in known], word[a:b]]).astype(np.int64)
                stop = np.concatenate([[e for _, e in known], word[a:b] + block.lengths[window[a:b]]]).astype(np.int64)
                found[d] = [{"start": s, "stop": e} for s, e in spans(first, stop)]
                named = {name for w in np.unique(window[a:b]).tolist() for i in block.items[w] for name in ids[i]}
                items[d] = sorted(named | set(items[d]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(found, span_type),
                 pa.array(items, pa.list_(id_type)), *batch.columns[5:]], ["id", "text", "n_words", "spans", "items", *batch.schema.names[5:]])
    return run


def _scan(docs: DataFrame, rest: list[str], benchmark: DataFrame, id_col: str, text_col: str, item_col: str,
          item_text_col: str, window: int, block_bytes: int, named: bool = True) -> DataFrame:
    """Without ``named``, no item ids are fetched and ``items`` stays empty."""
    spark = docs.sparkSession
    # equal items are searched once, with their ids beside the text
    ids = F.collect_set(item_col) if named else F.expr(f"CAST(array() AS array<{sql_type(benchmark, item_col)}>)")
    asked = benchmark.filter(F.col(item_text_col).isNotNull()).groupBy(F.col(item_text_col).alias("text")).agg(ids.alias("ids"))
    total = asked.agg(F.sum(F.octet_length("text") + ID_BYTES * F.size("ids"))).first()[0] or 0
    parts = 1 + total // block_bytes
    item_type = sql_type(benchmark, item_col)
    out = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.expr("CAST(array() AS array<struct<start: bigint, stop: bigint>>)").alias("spans"),
        F.expr(f"CAST(array() AS array<{item_type}>)").alias("items"), *([F.struct(*rest).alias("rest")] if rest else []))
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    for part in range(parts):  # a block of the stated query set is bounded by block_bytes and its largest item with its ids
        rows = asked.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()
        block = spark.sparkContext.broadcast(phrases([r.text.encode() for r in rows], window))
        out = out.mapInArrow(_task(block, [r.ids for r in rows], kind), out.schema)
    return out


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_words``, ``spans`` (array of word ranges ``start``, ``stop`` to remove,
    merged and in order), ``n_hit`` (words in them) and ``items`` (ids of the items found).

    A window is ``window`` consecutive words of an item, or all words of a shorter item. Null and blank texts have no
    words: such documents come back without spans and such items are in nothing. Items that share a window are all
    named; equal items are searched once and each named, repeated rows once; an item without id marks words but is not named. Repeated documents each come
    back. Other columns are not looked at. Empty tables give empty spans, or no rows.
    """
    out = _scan(docs, [], benchmark, id_col, text_col, item_col, item_text_col, window, block_bytes)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", span_words().alias("n_hit"), "items")


def span_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["stop"] - x["start"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: some word is hit, and at least one word in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def filter_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    out = _scan(docs, rest, benchmark, id_col, text_col, "item_id", "text", WINDOW, BLOCK_BYTES, named=False)
    clean = out.filter(~is_contaminated(span_words(), F.col("n_words")))
    return clean.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *([F.col("rest")[c].alias(c) for c in rest])).select(*docs.columns)
