"""Byte-level BPE over whole documents by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap, and each chunk is
pre-tokenised by itself, in tasks of their own. The first chunk starts at a
border of pre-tokens; a later one may start inside of one, but soon falls into
step. Where two neighbours have a border in common in their overlap, between
characters of different kinds, the text is cut for good: such a border does not
depend on what stands before. Neighbours that never meet (one very long run) are
put together again. The pieces between these borders are encoded one by one and
joined in order, so the ids are those of the text encoded at once.

Decoding looks up the bytes of each id and joins them.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import slices, sql_type, store

CHUNK = 1 << 16
OVERLAP = 1 << 10
#: Longer runs of white space are not given to the pattern of the library, whose look-ahead runs out of stack on them.
BLANKS = regex.compile(r"\s{4096,}")


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Token ids of a text, as the tiktoken library gives them without special tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        out, at = [], 0
        if len(text) >= 4096:
            for run in BLANKS.finditer(text):
                # a run of blanks is one pre-token, but its last blank goes to what follows
                end = run.end() if run.end() == len(text) else run.end() - 1
                out += self.encoding.encode_ordinary(text[at:run.start()])
                out += self.encoding._encode_single_piece(text[run.start():end].encode())
                at = end
        out += self.encoding.encode_ordinary(text[at:] if at else text)
        return np.array(out, dtype="<u4").tobytes()


class Decoder:
    def __init__(self, path: str):
        ranks = read_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        self.known = np.zeros(len(tokens), dtype=bool)
        for token, rank in ranks.items():
            tokens[rank] = token
            self.known[rank] = True
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def raw(self, ids: list[bytes | None]) -> list[bytes | None]:
        """Bytes of each row of ids; null stays null, an id the vocabulary lacks is an error."""
        counts = np.array([len(i or b"") // 4 for i in ids], dtype=np.int64)
        every = np.frombuffer(b"".join([i or b"" for i in ids]), dtype="<u4").astype(np.int64)
        if len(every) and (every.max() >= len(self.known) or not self.known[every].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[every]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[every] - stops[:-1], sizes) + np.arange(stops[-1])
        data, edges = self.flat[at].tobytes(), stops[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [None if row is None else data[a:b] for row, a, b in zip(ids, edges, edges[1:])]


def kind(char: str) -> str | None:
    """Blank, letter, number or other, as the pattern tells them apart; None where Unicode versions may differ."""
    group = unicodedata.category(char)
    if group == "Cn" or "\x1c" <= char <= "\x1f":
        return None
    if char.isspace():
        return "blank"
    return {"L": "letter", "N": "number"}.get(group[0], "other")


def is_settled(text: str, at: int) -> bool:
    """Whether a pre-token starts at ``at`` whatever stands before: after the end of a run of one kind, which no
    pre-token crosses. After a blank or an apostrophe it depends on more than the neighbours."""
    before, after = kind(text[at - 1]), kind(text[at])
    return None not in (before, after) and before != after and before != "blank" and text[at - 1] != "'"


def borders(text: str, pattern: regex.Pattern, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Starts of pre-tokens in each span (a range of places, from its start on) that are settled."""
    out: list[list[int]] = [[] for _ in spans]
    for match in pattern.finditer(text):
        at = match.start()
        for found, (a, b) in zip(out, spans):
            if a <= at < b and at and is_settled(text, at):
                found.append(at - a)
    return out


def _cut_task(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=chunk):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = range(0, len(text), chunk)
                group = max(1, (4 << 20) // chunk)
                for a in range(0, len(starts), group):
                    now = starts[a:a + group]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(now)), pa.array([s // chunk for s in now], pa.int64()),
                         pa.array([len(starts)] * len(now), pa.int64()),
                         pa.array([text[s:s + chunk + overlap] for s in now], pa.string())], ["key", "part", "parts", "text"])
    return run


def _border_task(pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in slices(batches, text=2):
            found = [borders(t, compiled, [(0, overlap), (chunk, chunk + overlap)]) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([h for h, _ in found], pa.list_(pa.int32())),
                 pa.array([t for _, t in found], pa.list_(pa.int32()))], ["key", "part", "head", "tail"])
    return run


def _encode_task(path: str, pattern: str, text: int):
    """Rows in, with ``ids`` in place of the text at that column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, text=text):
            encoder = encoder or Encoder(path, pattern)
            found = pa.array([encoder.ids(t or "") for t in batch.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([found if c == text else batch.column(c) for c in range(batch.num_columns)],
                                             ["ids" if c == text else batch.schema.names[c] for c in range(batch.num_columns)])
    return run


def _join_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([b"".join(batch.column(1)[row].as_py())], pa.binary())],
                                             ["key", "ids"])


def pieces(texts: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(key, piece, text)`` of ``texts (key, text)``: each distinct key's text in pieces that may be encoded by
    themselves, numbered in order. Rows of one key must have one text, of one character at least."""
    cut = store(texts.mapInArrow(_cut_task(chunk, overlap), "key string, part bigint, parts bigint, text string")
                .dropDuplicates(["key", "part"]), "chunks")
    marks = cut.select("key", "part", "text").mapInArrow(
        _border_task(pattern, chunk, overlap), "key string, part bigint, head array<int>, tail array<int>")
    marks = store(marks, "borders")
    before = marks.select("key", (F.col("part") + 1).alias("part"), "tail")
    met = marks.select("key", "part", "head").join(before, ["key", "part"], "left").select(
        "key", "part", F.when(F.col("part") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "tail"))).alias("met"))
    in_order = Window.partitionBy("key").orderBy("part")
    placed = met.select("key", "part", "met", F.lead("met").over(in_order).alias("next"),
                        F.max(F.when(F.col("met").isNotNull(), F.col("part"))).over(in_order).alias("piece"))
    last = F.col("part") == F.col("parts") - 1
    start = F.coalesce("met", F.lit(0))
    stop = F.when(last, F.lit(chunk + overlap)).otherwise(chunk + F.coalesce("next", F.lit(0)))
    whole = F.col("met").isNotNull() & (last | F.col("next").isNotNull())
    own = cut.join(placed, ["key", "part"]).select("key", "part", "piece", whole.alias("whole"),
                                                   F.substring("text", start + 1, stop - start).alias("text"))
    alone = own.filter("whole").select("key", "piece", "text")
    apart = own.filter("NOT whole").groupBy("key", "piece").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("p"))
    return alone.unionByName(apart.select("key", "piece", F.array_join("p.text", "").alias("text")))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit).

    A null text counts as empty and has no ids. Repeated rows and ids, null ids too, each come back; equal long texts
    are encoded once. ``chunk`` and ``overlap`` are characters and change no result. Other columns are not looked at.
    An empty table gives an empty result.
    """
    path, pattern = path or vocabulary_path(), pattern or default_pattern()
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be at least one character and at most a chunk")
    kind_of_id = sql_type(docs, id_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = rows.filter(~is_long).mapInArrow(_encode_task(path, pattern, 1), f"id {kind_of_id}, ids binary")
    long = rows.filter(is_long).select("id", F.sha2("text", 256).alias("key"), "text")
    encoded = pieces(long.select("key", "text"), pattern, chunk, overlap).mapInArrow(
        _encode_task(path, pattern, 2), "key string, piece bigint, ids binary")
    joined = (encoded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
              .select("key", F.col("p.ids").alias("p")).mapInArrow(_join_task, "key string, ids binary"))
    whole = long.select("id", "key").join(joined, "key").select("id", "ids")
    return short.unionByName(whole).select(
        F.col("id").alias(id_col), F.expr("octet_length(ids) DIV 4").cast("bigint").alias("n_tokens"), "ids")


def _decode_task(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in slices(batches, text=at):
            decoder = decoder or Decoder(path)
            found = pa.array(decoder.raw(batch.column(at).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "raw"])
    return run


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with a column ``raw``: the bytes of the ids in ``ids_col``, null for null. A column ``raw`` already
    there is replaced. Bytes need not be valid text, as ids may be cut anywhere."""
    rows = encoded.drop("raw")
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_decode_task(path or vocabulary_path(), rows.columns.index(ids_col)), f"{kinds}, raw binary")
