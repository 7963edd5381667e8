"""Structure-aware chunks. All folds run inside one document row on the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.text import fn, sql_call
from .nodes import NODE_BLOCK
from .scan import running

# ---- Fixed values ------------------------------------------------------------
TARGET, OVERLAP, OWN_CHUNK, TABLE_ROWS = 500, 50, 100, 10
PATH_JOINT = " > "
EMBED_BATCH = 32
MAX_DESCRIPTION = 5000
# ------------------------------------------------------------------------------

LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]"
_STRINGS = "cast(array() as array<string>)"


# ---------------------------------------------------------------- splitting one text

def _some(text: Column) -> Column:
    """One-element array, or none for an empty text."""
    return F.when(text != "", F.array(text)).otherwise(F.expr(_STRINGS))


def _hard_cut(text: Column, step: int) -> tuple[Column, Column]:
    """Full pieces of an over-long text and the rest that fits."""
    cuts = F.ceil((F.length(text) - TARGET) / F.lit(float(step))).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), cuts - 1), lambda i: F.substring(text, i * step + 1, F.lit(TARGET)))
    return pieces, F.substring(text, cuts * step + 1, F.length(text))


def _pack(parts: Column, overlong_step: int, joint: str, carry: int) -> Column:
    """Greedy packing of ordered parts into pieces of at most ``TARGET``, each opened by the tail of the last."""
    start = F.expr(f"named_struct('out', {_STRINGS}, 'cur', '')")

    def step(acc: Column, part: Column) -> Column:
        cur, closed = acc["cur"], F.concat(acc["out"], _some(acc["cur"]))
        pieces, rest = _hard_cut(part, overlong_step)
        fits = F.length(cur) + F.length(part) + len(joint) <= TARGET
        tail = F.expr("''") if carry == 0 else F.right(cur, F.lit(carry))
        glued = F.when(cur == "", part).otherwise(F.concat(cur, F.lit(joint), part))
        return (F.when(F.length(part) > TARGET, F.struct(F.concat(closed, pieces).alias("out"), rest.alias("cur")))
                .when(fits, F.struct(acc["out"].alias("out"), glued.alias("cur")))
                .otherwise(F.struct(closed.alias("out"), F.concat(tail, part).alias("cur"))))

    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["out"], _some(acc["cur"])))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def split_lines_array(text: Column) -> Column:
    """Lines as ``str.splitlines`` gives them: no empty last one."""
    lines = F.split(text, LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def long_pieces(text: Column) -> Column:
    """CHK-3: pieces of a long paragraph cut at sentence ends, with overlap."""
    parts = F.filter(F.split(text, r"(?<=[。！？\n])"), lambda p: p != "")
    return F.when(F.length(text) <= TARGET, F.array(text)).otherwise(_pack(parts, TARGET - OVERLAP, "", OVERLAP))


def line_pieces(text: Column) -> Column:
    """CHK-5: pieces of a list or code text cut at line ends, without overlap."""
    return F.when(F.length(text) <= TARGET, F.array(text)).otherwise(_pack(split_lines_array(text), TARGET, "\n", 0))


def table_pieces(text: Column, rows: int = TABLE_ROWS) -> Column:
    """CHK-4: row groups of a Markdown table, each under the header."""
    def grouped(lines: Column) -> Column:
        starts = F.sequence(F.lit(3), F.size(lines), F.lit(rows))
        groups = _let(F.array_join(F.slice(lines, 1, 2), "\n"), lambda head: F.transform(
            starts, lambda i: F.concat(head, F.lit("\n"), F.array_join(F.slice(lines, i, F.lit(rows)), "\n"))))
        return F.when(F.size(lines) <= rows + 2, F.array(text)).otherwise(groups)

    # lines are cut once, not again for each group
    return _let(split_lines_array(text), grouped)


def split_column(df: DataFrame, key: str, pieces: Column) -> DataFrame:
    return df.select(key, F.posexplode_outer(pieces).alias("piece_no", "piece")).filter("piece is not null").withColumn(
        "piece_no", F.col("piece_no").cast("bigint"))


# ---------------------------------------------------------------- heading paths on a node table

def _open_paths(nodes: Column) -> Column:
    """Heading path at each of ``nodes (type, text, level, ..)``: the open titles are a stack with rising levels.

    Only headings are folded; the nodes from one heading to the next share its path. A heading without level takes the
    level of the heading before it. A heading has its own title in its path.
    """
    start = F.expr("named_struct('s', cast(array() as array<struct<level:bigint,title:string>>), 'o', array(''))")

    def step(acc: Column, n: Column) -> Column:
        level = F.coalesce(n["level"].cast("bigint"), F.try_element_at(acc["s"], F.lit(-1))["level"], F.lit(1).cast("bigint"))
        stack = F.concat(F.filter(acc["s"], lambda e: e["level"] < level),
                         F.array(F.struct(level.alias("level"), n["text"].alias("title"))))
        path = F.array_join(F.transform(stack, lambda e: e["title"]), PATH_JOINT)
        return F.struct(stack.alias("s"), F.concat(acc["o"], F.array(path)).alias("o"))

    def spread(paths: Column) -> Column:
        at = F.filter(F.transform(nodes, lambda n, i: F.when(n["type"] == "heading", i)), lambda i: i.isNotNull())
        edges = F.concat(F.array(F.lit(0)), at, F.array(F.size(nodes)))
        return _let(edges, lambda e: F.flatten(F.transform(paths, lambda p, k: F.array_repeat(p, F.get(e, k + 1) - F.get(e, k)))))

    heads = F.filter(nodes, lambda n: n["type"] == "heading")
    return _let(F.aggregate(heads, start, step, lambda acc: acc["o"]), spread)


def with_heading_path(nodes: DataFrame) -> DataFrame:
    """CHK-1: titles above each node that is not a heading. A file is put into one row, as the chunker holds it."""
    text = F.expr(sql_call("strip_text", t="text"))
    used = nodes.withColumn("text", text).filter(F.col("text") != "").filter(~fn("is_junk", t="text"))
    files = used.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("idx", "type", "text", "level", "page"))).alias("n"))
    rows = files.select("file_id", F.explode(F.arrays_zip("n", _open_paths(F.col("n")).alias("p"))).alias("r"))
    return rows.filter("r.n.type <> 'heading'").select(
        "file_id", "r.n.idx", "r.n.type", "r.n.text", "r.n.page", F.col("r.p").alias("heading_path"))


# ---------------------------------------------------------------- whole chunker inside a row

def _usable(nodes: str) -> Column:
    strip = sql_call("strip_text", t="n.text")
    junk = sql_call("is_junk", t="n.text")
    return F.expr(f"filter(transform({nodes}, n -> named_struct('type', n.type, 'text', {strip}, 'level', n.level, 'page', n.page)), "
                  f"n -> n.text <> '' and not {junk})")


def _with_paths(nodes: Column) -> Column:
    """Nodes with their heading path."""
    return _let(nodes, lambda held: F.zip_with(held, _open_paths(held), lambda n, p: F.struct(
        n["type"].alias("type"), n["text"].alias("text"), n["page"].cast("bigint").alias("page"), p.alias("path"))))


def _merge_units(nodes: Column) -> Column:
    """CHK-2: short paragraphs and list items gathered until 500 characters or a break; others stay alone.

    Any other node is a break, so only the stretches between breaks are folded, each for itself.
    """
    unit = "struct<kind:string,text:string,page:bigint,path:string>"
    start = F.expr(f"named_struct('open', cast(null as {unit}), 'n', cast(0 as bigint), 'o', cast(array() as array<{unit}>))")
    nothing = F.expr(f"cast(null as {unit})")

    def row(kind: Column, text: Column, page: Column, path: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"), page.alias("page"), path.alias("path"))

    def state(open_: Column, n: Column, out: Column) -> Column:
        return F.struct(open_.alias("open"), n.cast("bigint").alias("n"), out.alias("o"))

    def small(x: Column) -> Column:
        return (x["type"] == "list") | ((x["type"] == "paragraph") & (F.length(x["text"]) < OWN_CHUNK))

    def step(acc: Column, x: Column) -> Column:
        cur = acc["open"]
        closed = F.when(cur.isNull(), acc["o"]).otherwise(F.concat(acc["o"], F.array(cur)))
        kind = F.when(x["type"] == "list", "list").otherwise("short")
        same = cur["kind"] == kind
        grown = F.when(same, row(kind, F.concat(cur["text"], F.lit("\n"), x["text"]), cur["page"], x["path"])).otherwise(
            row(kind, x["text"], x["page"], x["path"]))
        before = F.when(same, acc["o"]).otherwise(closed)
        total = acc["n"] + F.length(x["text"])
        return (F.when(total >= TARGET, state(nothing, F.lit(0), F.concat(before, F.array(grown))))
                .otherwise(state(grown, total, before)))

    def folded(part: Column) -> Column:
        return F.aggregate(part, start, step, lambda acc: F.when(acc["open"].isNull(), acc["o"]).otherwise(
            F.concat(acc["o"], F.array(acc["open"]))))

    def stretches(held: Column) -> Column:
        breaks = F.filter(F.transform(held, lambda x, i: F.when(~F.coalesce(small(x), F.lit(False)), i)), lambda i: i.isNotNull())

        def stretch(edges: Column, k: Column) -> Column:
            first, last = F.get(edges, k) + 1, F.get(edges, k + 1)
            x = F.get(held, last)
            alone = F.when(x.isNull() | (x["type"] == "heading"), F.expr(f"cast(array() as array<{unit}>)")).otherwise(
                F.array(row(x["type"], x["text"], x["page"], x["path"])))
            return F.concat(folded(F.slice(held, first + 1, last - first)), alone)

        edges = F.concat(F.array(F.lit(-1)), breaks, F.array(F.size(held)))
        return _let(edges, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: stretch(e, k))))

    return _let(nodes, stretches)


def _pieces(units: Column) -> Column:
    def cut(u: Column) -> Column:
        text = u["text"]
        parts = (F.when(u["kind"] == "paragraph", long_pieces(text)).when(u["kind"] == "table", table_pieces(text))
                 .when(u["kind"].isin("list", "code"), line_pieces(text)).otherwise(F.array(text)))
        kind = F.when(u["kind"] == "short", "paragraph").otherwise(u["kind"])
        return F.transform(parts, lambda p: F.struct(kind.alias("chunk_type"), p.alias("content"),
                                                     u["path"].alias("heading_path"), u["page"].alias("page_no")))
    return F.flatten(F.transform(units, cut))


def merge_short(docs: DataFrame, key: str = "file_id", nodes: str = "nodes") -> DataFrame:
    """CHK-2 as rows: merged units of each document before they are cut."""
    units = _merge_units(_with_paths(_usable(nodes)))
    return docs.select(key, F.posexplode_outer(units).alias("unit_no", "u")).filter("u is not null").select(
        key, F.col("unit_no").cast("bigint").alias("unit_no"), "u.kind", "u.text", F.col("u.page").alias("page_no"), F.col("u.path").alias("heading_path"))


def chunk_documents(docs: DataFrame, key: str = "file_id", nodes: str = "nodes") -> DataFrame:
    """CHK-7: chunks of documents held as ``nodes array<struct<type,text,level,page>>``.

    Sequence numbers are given before equal contents are dropped, so gaps stay.
    No shuffle: a document is cut, numbered and de-duplicated in its own row.
    """
    staged = docs.select(key, _pieces(_merge_units(_with_paths(_usable(nodes)))).alias("_p"))
    # equal contents are neighbours once sorted; the first of each has the least number
    by_content = F.sort_array(F.transform("_p", lambda p, i: F.struct(p["content"].alias("content"), i.alias("i"))))
    first = _let(by_content, lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, k: (k == 0) | (F.get(s, k - 1)["content"] != x["content"])), lambda x: x["i"])))
    kept = F.transform(first, lambda i: F.struct((i + 1).cast("bigint").alias("seq"), F.get("_p", i).alias("p")))
    return staged.select(key, F.explode_outer(kept).alias("x")).filter("x is not null").select(
        key, "x.p.chunk_type", "x.seq", "x.p.content", F.length("x.p.content").cast("bigint").alias("chars"),
        "x.p.heading_path", "x.p.page_no")


def nest_nodes(nodes: DataFrame) -> DataFrame:
    """Node table to one row per file, the form the chunker takes."""
    packed = nodes.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("idx", "type", "text", "level", "page"))).alias("nodes"))
    return packed.withColumn("nodes", F.transform("nodes", lambda n: F.struct(
        n["type"].alias("type"), n["text"].alias("text"), n["level"].cast("bigint").alias("level"), n["page"].cast("bigint").alias("page"))))


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """CHK-6: of equal contents in a file the first stays."""
    rest = [c for c in chunks.columns if c not in ("file_id", "content")]
    return (chunks.groupBy("file_id", "content").agg(F.min_by(F.struct(*rest), "seq").alias("r"))
            .select("file_id", "content", *[F.col(f"r.{c}").alias(c) for c in rest]).select(*chunks.columns))


# ---------------------------------------------------------------- indexing

def embed_text(chunks: DataFrame) -> DataFrame:
    """IDX-1: text given to the encoder, the heading path in front."""
    return chunks.withColumn("embed_text", F.when(
        F.coalesce("heading_path", F.lit("")) == "", F.col("content")).otherwise(F.concat_ws(" ", "heading_path", "content")))


class Encoder(Protocol):
    """Plug-in that maps texts to one vector each; loaded once per Python worker."""

    dims: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Default encoder: signed feature hashing of words, no model needed."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        from zlib import crc32
        out = np.zeros((len(texts), self.dims), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                code = crc32(word.encode())
                out[row, code % self.dims] += 1.0 if code & 0x10000 else -1.0
        return out


def embed(df: DataFrame, make_encoder: Callable[[], Encoder] = HashingEncoder, text: str = "embed_text",
          batch: int = EMBED_BATCH) -> DataFrame:
    """IDX-2: vectors in batches, one per text, scaled to unit length."""
    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for series in batches:
            rows: list[np.ndarray] = []
            texts = series.fillna("").tolist()
            for at in range(0, len(texts), batch):
                part = encoder.encode(texts[at:at + batch])
                if len(part) != len(texts[at:at + batch]):
                    raise ValueError("encoder returned a wrong number of vectors")
                rows.extend(part)
            yield pd.Series(rows, dtype=object)

    return df.withColumn("_raw", encode(F.col(text))).withColumn(
        "embedding", fn("unit_vector", a="_raw").cast("array<float>")).drop("_raw")


def map_distinct(df: DataFrame, column: str, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """IDX-3: run a costly step once per distinct text and hand the result to every row.

    ``apply`` gets one row per content and adds columns. The join back is keyed by
    content; a content with many copies is split by the adaptive skew join.
    """
    key = F.sha2(F.col(column), 256)
    once = df.select(key.alias("_key"), column).dropDuplicates(["_key"])
    done = apply(once).drop(column)
    return df.withColumn("_key", key).join(done, "_key", "left").drop("_key")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """IDX-4: chunks per file and type."""
    return chunks.groupBy("file_id", "chunk_type").agg(F.count(F.lit(1)).alias("chunks"), F.min("seq").alias("first_seq"))


def _refusal(text: str) -> Column:
    pattern = fn("injection_pattern", t=text)
    return (F.when(F.coalesce(F.col(text), F.lit("")) == "", "empty").when(F.length(text) > MAX_DESCRIPTION, "too_long")
            .when(pattern != "", F.concat(F.lit("prompt_injection:"), pattern)).otherwise(""))


def refused_descriptions(descriptions: DataFrame) -> DataFrame:
    """IDX-5: descriptions that are not taken, each with the reason."""
    clean = descriptions.withColumn("text", F.expr(sql_call("strip_text", t="text")))
    return clean.withColumn("reason", _refusal("text")).filter("reason <> ''").select("desc_id", "file_id", "reason")


def append_descriptions(chunks: DataFrame, descriptions: DataFrame) -> DataFrame:
    """IDX-5: manual descriptions become the next chunks of their file after screening.

    ``descriptions(desc_id, file_id, page_no, text)``; several for one file follow each other by ``desc_id``. Those
    that do not pass are in ``refused_descriptions``.
    """
    clean = descriptions.withColumn("text", F.expr(sql_call("strip_text", t="text")))
    passed = clean.filter(_refusal("text") == "")
    last = chunks.groupBy("file_id").agg(F.max("seq").alias("_last"))
    nth = running(passed, ["file_id"], ["desc_id"], F.floor(F.col("desc_id") / NODE_BLOCK), {"_n": ("count", F.lit(1))})
    return nth.join(last, "file_id", "left").select(
        "file_id", F.lit("text").alias("chunk_type"), (F.coalesce("_last", F.lit(-1)) + F.col("_n")).alias("seq"),
        F.col("text").alias("content"), F.length("text").cast("bigint").alias("chars"), F.lit("").alias("heading_path"), "page_no")
