"""Packing of documents into training sequences by power-of-two decomposition.

A document of n tokens is cut from the front into pieces of the longest allowed
length and then of the binary digits of the rest, largest first. Each piece is a
sequence of its own: its length is a power of two, so it needs no padding, and no
sequence crosses documents. Trainers read the sequences bucket by bucket, all of
one length. There is no shuffle.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import bound_batches, give_back, slices, sql_type

END_ID = 1
CACHE_WORDS = 150_000
BLOCK_BYTES = 4 << 20
OUT_IDS = 4 << 20
AT_ONCE = 8192  # words the tokenizer gets at a time; its results take some hundred bytes a token
BREAK = re.compile("[ \n]")
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Byte-level vocabularies write the bytes that are no visible Latin-1 characters as characters from 256 on.
BYTE_CHARS = np.arange(256, dtype="<u2")
for _i, _b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b != 173)):
    if _b != 32:
        BYTE_CHARS[_b] = 256 + _i


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordCache:
    """Token ids of texts, remembered per word.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in order;
    letters and a following comma or full stop are separate pieces too. Unknown words of plain Latin letters, one
    piece each, are encoded side by side and told apart by the tokens that end a piece.

    The ids of all known words stand in one pool. A block of texts is cut into words and these are numbered in Arrow,
    so each distinct word is looked up once, and the ids of the block are gathered from the pool. When more than
    ``limit`` words are known, all but those of the present block are forgotten.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        # plain words need no normalising beyond lower case, and no splitting but at blanks
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stops = {mark: self._encode([mark])[0] for mark in ",."}
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self._forget({})

    def _encode(self, words: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        return [found for a in range(0, len(words), AT_ONCE) for found in self._encode_groups(words[a:a + AT_ONCE])]

    def _encode_groups(self, words: list[str]) -> list[bytes]:
        groups = [words[i:i + 64] for i in range(0, len(words), 64)]
        out: list[bytes] = []
        texts = [" ".join(g).lower() for g in groups]
        texts = [t if t.isascii() else BYTE_CHARS[np.frombuffer(t.encode(), dtype=np.uint8)].tobytes().decode("utf-16-le") for t in texts]
        for group, got in zip(groups, self._encode(texts, self.bare)):
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(got, dtype="<u4")]) + 1)).tolist()
            out += [got[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(group) else self._encode(group)
        return out

    def _forget(self, kept: dict[str, bytes]) -> None:
        """Start anew with the words of ``kept``; place 0 of the pool is the end of a document, 1 is no word."""
        found = [self.end, b"", *kept.values()]
        self.number = {"": 1, **{w: i + 2 for i, w in enumerate(kept)}}
        self.pool = np.frombuffer(b"".join(found), dtype="<u4")
        self.sizes = np.array([len(f) // 4 for f in found], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _learn(self, words: list[str]) -> None:
        stops = self.stops
        bases = [w[:-1] if w[-1] in stops and is_plain(w[:-1]) else w for w in words]
        distinct = dict.fromkeys(bases)
        fresh = {w: self._ids_of(self.number[w]) for w in distinct if w in self.number}
        plain = [w for w in distinct if w not in fresh and is_plain(w)]
        fresh.update(zip(plain, self._encode_plain(plain)))
        other = [w for w in distinct if w not in fresh]
        fresh.update(zip(other, self._encode(other)))
        found = [fresh[b] if len(b) == len(w) else fresh[b] + stops[w[-1]] for w, b in zip(words, bases)]
        self.number.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        sizes = np.array([len(f) // 4 for f in found], dtype=np.int64)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(found), dtype="<u4")])

    def _ids_of(self, number: int) -> bytes:
        start = self.starts[number]
        return self.pool[start:start + self.sizes[number]].tobytes()

    def _numbers(self, words: list[str]) -> np.ndarray:
        missing = list(filterfalse(self.number.__contains__, words))
        if missing and len(self.number) + len(missing) > self.limit:
            self._forget({w: self._ids_of(self.number[w]) for w in words if w and w in self.number})
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without the end id."""
        found, totals = self.block(pa.array(texts, pa.string()))
        stops = np.cumsum(totals).tolist()
        return [found[stop - n:stop - 1].tobytes() for stop, n in zip(stops, totals.tolist())]

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id behind, and how many each has. Null: empty."""
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        numbers = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(words.indices)]
        stops = np.cumsum(np.asarray(split.value_lengths(), dtype=np.int64))
        numbers = np.insert(numbers, stops, 0)
        sizes = self.sizes[numbers]
        before = np.concatenate([[0], np.cumsum(sizes)])
        edges = before[np.concatenate([[0], stops + np.arange(1, len(stops) + 1)])]
        wide = np.int32 if max(before[-1], len(self.pool)) < 1 << 31 else np.int64
        at = np.repeat((self.starts[numbers] - before[:-1]).astype(wide), sizes)
        at += np.arange(before[-1], dtype=wide)
        return self.pool[at], np.diff(edges)


def is_plain(word: str) -> bool:
    return word.isalpha() and (word.isascii() or PLAIN.fullmatch(word) is not None)


#: The caches of this worker process, kept from task to task.
CACHES: dict[tuple[str, int], WordCache] = {}


def parts_of(text: str, size: int) -> list[str]:
    """``text`` in parts of about ``size`` characters, cut at blanks or line ends, which are dropped."""
    out, at = [], 0
    while len(text) - at > size and (cut := BREAK.search(text, at + size)):
        out.append(text[at:cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def pieces(tokens: int, longest: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document."""
    whole, rest = divmod(tokens, longest)
    out = [(i * longest, longest) for i in range(whole)]
    at = whole * longest
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def _task(path: str, longest: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = CACHES.get((path, end_id)) or CACHES.setdefault((path, end_id), WordCache(path, end_id=end_id))
        for batch in slices(batches, size=BLOCK_BYTES):
            if batch.num_rows == 1 and len(batch.column(1)[0].as_py() or "") > 2 * BLOCK_BYTES:
                found = [cache.block(pa.array([part]))[0] for part in parts_of(batch.column(1)[0].as_py(), BLOCK_BYTES)]
                ids = np.concatenate([*(f[:-1] for f in found), found[-1][-1:]])
                totals = np.array([len(ids)])
            else:
                ids, totals = cache.block(batch.column(1))
            yield from _rows(batch.column(0), ids, totals, longest)
        batch = ids = totals = None
        give_back()
    return run


def _rows(names: pa.Array, ids: np.ndarray, totals: np.ndarray, longest: int) -> Iterator[pa.RecordBatch]:
    """A row per piece. Pieces follow each other as the ids do, so their bytes are cut by places alone."""
    cuts = [pieces(t, longest) for t in totals.tolist()]
    row = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    start, length = np.array([p for c in cuts for p in c], dtype=np.int64).T
    stop = np.cumsum(length)
    block = (stop - 1) // OUT_IDS
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(row)]
    for a, b in zip(edges, edges[1:]):
        first = stop[a] - length[a]
        places = np.concatenate([[0], stop[a:b] - first]).astype(np.int32) * np.int32(4)
        data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(ids[first:stop[b - 1]].tobytes())])
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(row[a:b])), pa.array(start[a:b]), pa.array(length[a:b]), pa.array(totals[row[a:b]]), data],
            ["id", "start", "length", "tokens", "ids"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048,
         end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Per piece: ``id_col``, ``start``, ``length``, ``doc_tokens``, ``ids`` (little-endian unsigned 32-bit),
    ``sequence_id`` and ``offset`` (0: a piece is a sequence). ``longest`` must be a power of two.

    A null text counts as empty: one piece with the end id alone. Repeated rows are packed each for itself. Other
    columns are not looked at. An empty table gives no sequences.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    bound_batches(docs.sparkSession)
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        _task(path or vocabulary_path(), longest, end_id),
        f"id {sql_type(docs, id_col)}, start bigint, length bigint, tokens bigint, ids binary")
    return packed.select(F.col("id").alias(id_col), "start", "length", F.col("tokens").alias("doc_tokens"), "ids",
                         F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
