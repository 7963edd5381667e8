"""Document structure: text to typed nodes, page clean-up, blocks and rendering.

Where the input is one text per row the work stays inside the row, so no shuffle
is needed and a document is never spread or gathered. Node and block tables are
joined, aggregated and scanned by (file, block of rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql_call
from .scan import running

# ---- Fixed values ------------------------------------------------------------
SENTENCE_END = "。！？；：”’）】》"
EDGE_SHARE = 0.07
NOISE_MIN, NOISE_SHARE = 2, 0.5
PAGE_ELEMENTS = 20
CONTAIN_SLACK = 2
READING_BAND = 30
MIN_PAGE_CHARS = 50
IMAGE_MIN_SHARE, IMAGE_MAX_FACTOR, IMAGES_PER_PAGE = 0.02, 2, 8
INNER_TEXT_CHARS = 300
# ------------------------------------------------------------------------------

NODE_BLOCK = 65536


def strip(column: str) -> Column:
    return F.expr(sql_call("strip_text", t=column))


# ---------------------------------------------------------------- text and Markdown

def text_to_nodes(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """DOC-1: paragraphs of plain text, split at blank lines."""
    parts = F.expr(f"filter(transform(split(text, '\\n\\n'), p -> {sql_call('strip_text', t='p')}), p -> p <> '')")
    # the outer form keeps the optimizer from adding a second evaluation of the split as a filter
    nodes = df.select(key, F.posexplode_outer(parts).alias("idx", "text")).filter("text is not null")
    return nodes.withColumn("idx", F.col("idx").cast("bigint"))


_BLANK = r"[\s&&[^\n]]*"
_ROW = rf"{_BLANK}\|[^\n]*\|{_BLANK}$"
_RULE = r"[\s:|\-&&[^\n]]+$"
_FENCE_LINE = rf"^{_BLANK}(?:```|~~~)[^\n]*"
_FENCED = rf"{_FENCE_LINE}(?:\n.*?(?:{_FENCE_LINE}|\z)|\z)"
_TABLE = (rf"^(?={_RULE}|[^\n]*\n(?=[^\n]*\|)(?=[^\n]*-){_RULE}){_ROW}"
          rf".*?(?=\n(?!{_ROW})|\z)")
_ANY_LINE = rf"^{_BLANK}[^\s][^\n]*"
# One scan of the text: a fenced block, a table, or one line that is not blank. Group 1 marks tables.
MARKDOWN_BLOCK = rf"(?dmsU)(?:{_FENCED})|({_TABLE})|(?:{_ANY_LINE})"

MARKDOWN_NODES = (
    "transform(zip_with(regexp_extract_all({t}, r\"" + MARKDOWN_BLOCK + "\", 0), "
    "regexp_extract_all({t}, r\"" + MARKDOWN_BLOCK + "\", 1), (x, y) -> named_struct('raw', x, 'tab', y)), b -> "
    r"""CASE
      WHEN b.tab <> '' THEN named_struct('type', 'table', 'text', b.raw, 'level', cast(null as bigint))
      WHEN b.raw RLIKE r'(?U)^\s*(```|~~~)' THEN named_struct('type', 'code', 'text', b.raw, 'level', cast(null as bigint))
      WHEN {s} RLIKE r'(?U)^#{1,6}\s+[^\n]*$' THEN named_struct('type', 'heading',
           'text', regexp_extract({s}, r'(?U)^#{1,6}\s+([^\n]*)$', 1),
           'level', cast(length(regexp_extract({s}, r'^(#{1,6})', 1)) as bigint))
      WHEN b.raw RLIKE r'(?U)^\s*([-*+]|\d+\.)\s+' THEN named_struct('type', 'list', 'text', {s}, 'level', cast(null as bigint))
      ELSE named_struct('type', 'paragraph', 'text', {s}, 'level', cast(null as bigint)) END)""")


def markdown_array(text: str) -> Column:
    """Ordered nodes of a Markdown text as one array value."""
    return F.expr(MARKDOWN_NODES.replace("{s}", sql_call("strip_text", t="b.raw")).replace("{t}", text))


def markdown_to_nodes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """DOC-2: code, headings, tables, list items and paragraphs of a Markdown text in order."""
    nodes = df.select(key, F.posexplode_outer(markdown_array(text)).alias("idx", "n")).filter("n is not null")
    return nodes.select(key, F.col("idx").cast("bigint").alias("idx"), "n.type", "n.text", "n.level")


def markdown_sections(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """DOC-3: sections before each level 1-2 heading; the number counts empty parts too.

    The JVM splitter drops an empty first part, which the numbering must count.
    """
    plain = F.regexp_replace(F.regexp_replace("text", r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]+)\]\([^)]*\)", "$1")
    parts = df.select(key, plain.alias("text")).select(
        key, F.col("text").rlike(r"^#{1,2}\s").cast("bigint").alias("shift"),
        F.posexplode_outer(F.split("text", r"(?m)(?=^#{1,2}\s)")).alias("pos", "part"))
    return (parts.select(key, (F.col("pos") + F.col("shift")).alias("page_no"), strip("part").alias("text"))
            .filter("text <> ''"))


def paginate(elements: DataFrame, n: int = PAGE_ELEMENTS) -> DataFrame:
    """DOC-4: every ``n`` elements form a page; empty pages take no number.

    ``elements(file_id, idx, type, text)`` with ``idx`` counting from 0 per file.
    """
    body = strip("text")
    pages = elements.withColumn("body", body).groupBy("file_id", F.floor(F.col("idx") / n).alias("slot")).agg(
        F.array_sort(F.collect_list(F.when((F.col("type") != "table") & (F.col("body") != ""), F.struct("idx", "body")))).alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "table", F.struct("idx", "text")))).alias("tables"))
    shown = pages.filter((F.size("t") > 0) | (F.size("tables") > 0))
    numbered = running(shown, ["file_id"], ["slot"], F.floor(F.col("slot") / NODE_BLOCK), {"nth": ("count", F.lit(1))})
    return numbered.select(
        "file_id", (F.col("nth") - 1).alias("page_no"),
        F.array_join(F.transform("t", lambda x: F.concat(x["body"], F.lit("\n"))), "").alias("text"),
        F.size("tables").cast("bigint").alias("tables"))


def rows_to_markdown(rows: DataFrame, group: str = "table_id", order: str = "row_no", drop_blank: bool = False) -> DataFrame:
    """DOC-5: one Markdown table per group, short rows padded to the widest.

    A table is one text value of the result, so its rows meet in one group.
    """
    if drop_blank:
        rows = rows.filter(F.exists("cells", lambda c: c != ""))
    packed = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "cells"))).alias("r"))
    width = F.array_max(F.transform("r", lambda x: F.size(x["cells"])))
    lines = F.transform("r", lambda x: F.concat(
        F.lit("| "), F.array_join(F.concat(x["cells"], F.array_repeat(F.lit(""), F.col("w") - F.size(x["cells"]))), " | "),
        F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.col("w")), "|"), F.lit("|"))
    return (packed.withColumn("w", width).withColumn("l", lines).select(
        group, F.array_join(F.concat(F.slice("l", 1, 1), F.array(rule), F.slice("l", F.lit(2), F.size("l"))), "\n").alias("markdown")))


# ---------------------------------------------------------------- page text clean-up

def _solid_lines(text: str) -> Column:
    return F.expr(f"filter(transform(split({text}, '\\n'), l -> {sql_call('strip_text', t='l')}), l -> l <> '')")


def drop_headers_footers(nodes: DataFrame) -> DataFrame:
    """DOC-6: drop one-line nodes in the page edge whose line repeats over the pages of its file.

    ``nodes(file_id, idx, text, page, y0, y1)``; without boxes every one-line repeat goes.
    """
    lined = nodes.withColumn("_lines", _solid_lines("text"))
    counts = (lined.select("file_id", F.explode("_lines").alias("_line"))
              .groupBy("file_id", "_line").agg(F.count(F.lit(1)).alias("_n")))
    extent = nodes.groupBy("file_id").agg(
        F.count_distinct("page").alias("_pages"), F.coalesce(F.max("y1"), F.lit(0.0)).alias("_height"))
    noisy = counts.join(extent, "file_id").filter(
        F.col("_n") >= F.greatest(F.lit(float(NOISE_MIN)), F.col("_pages") * NOISE_SHARE)).select("file_id", "_line", "_height")
    single = lined.withColumn("_line", F.when(F.size("_lines") == 1, F.col("_lines")[0]))
    joined = single.join(noisy, ["file_id", "_line"], "left")
    boxed = F.col("y0").isNotNull() & (F.col("_height") > 0)
    edge = (F.col("y0") < F.col("_height") * EDGE_SHARE) | (F.col("y1") > F.col("_height") * (1 - EDGE_SHARE))
    drop = F.col("_height").isNotNull() & (~boxed | edge)
    return joined.filter(~F.coalesce(drop, F.lit(False))).select(*nodes.columns)


def _last_char(c: Column) -> Column:
    return F.substring(c, -1, 1)


def _space_between(left_char: Column, right: Column) -> Column:
    both = left_char.rlike("^[A-Za-z]$") & right.rlike("^[A-Za-z]")
    return F.when(both, F.lit(" ")).otherwise(F.lit(""))


def _join_inner(text: str) -> Column:
    """Lines of one paragraph joined until a sentence end or a blank line."""
    start = F.expr("named_struct('out', cast(array() as array<string>), 'cur', cast(null as string))")

    def step(acc: Column, line: Column) -> Column:
        cur = acc["cur"]
        ended = (cur != "") & F.lit(SENTENCE_END).contains(_last_char(cur))
        fresh = cur.isNull() | (line == "") | ended
        return F.struct(
            F.when(fresh & cur.isNotNull(), F.concat(acc["out"], F.array(cur))).otherwise(acc["out"]).alias("out"),
            F.when(fresh, line).otherwise(F.concat(cur, _space_between(_last_char(cur), line), line)).alias("cur"))

    lines = F.expr(f"transform(split({text}, '\\n'), l -> {sql_call('strip_text', t='l')})")
    joined = F.aggregate(lines, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(acc["cur"])), "\n"))
    return F.when(F.contains(F.col(text), F.lit("\n")), joined).otherwise(F.col(text))


def merge_broken_lines(nodes: DataFrame) -> DataFrame:
    """DOC-7: join lines broken by the page layout, inside a paragraph and over following paragraphs of the page.

    Whether a node continues the one before depends on the two texts only, so
    group starts come from a look-back and groups from a running count.
    """
    base = nodes.withColumns({"_t": strip("text"), "_para": F.col("type") == "paragraph"})
    look = running(base, ["file_id"], ["idx"], F.floor(F.col("idx") / NODE_BLOCK),
                   {"_prev": ("last", F.struct("_para", "page", _last_char(F.col("_t")).alias("end")))}, inclusive=False)
    end = F.col("_prev.end")
    joins = (F.col("_para") & F.col("_prev._para") & F.col("page").eqNullSafe(F.col("_prev.page"))
             & (end != "") & ~F.lit(SENTENCE_END).contains(end) & (F.col("_t") != "")
             & ~F.col("text").rlike("^[ \t　]"))
    flagged = look.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    grouped = running(flagged, ["file_id"], ["idx"], F.floor(F.col("idx") / NODE_BLOCK),
                      {"_grp": ("count", F.when(~F.col("_joins"), 1))})
    inner = F.when(F.col("_para"), _join_inner("text")).otherwise(F.col("text"))
    piece = F.when(F.col("_joins"), F.concat(_space_between(end, F.col("_t")), F.col("_t"))).otherwise(inner)
    parts = grouped.withColumns({"_piece": piece, "_inner": F.col("_para") & ~F.col("_joins") & (
        F.size(F.split("text", "\n")) > F.size(F.split(inner, "\n")))})
    out = parts.groupBy("file_id", "_grp").agg(
        F.min("idx").alias("idx"), F.min_by("type", "idx").alias("type"), F.min_by("page", "idx").alias("page"),
        F.array_sort(F.collect_list(F.struct("idx", "_piece"))).alias("p"), F.max("_inner").alias("_inner"))
    head = F.when(F.size("p") > 1, F.regexp_replace(F.col("p")[0]["_piece"], r"(?U)\s+$", "")).otherwise(F.col("p")[0]["_piece"])
    rest = F.array_join(F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x["_piece"]), "")
    return out.select("file_id", "idx", "type", "page", F.concat(head, rest).alias("text"),
                      (F.col("_inner") | (F.size("p") > 1)).alias("joined"))


# ---------------------------------------------------------------- page blocks

def resolve_blocks(blocks: DataFrame, band: int = 50) -> DataFrame:
    """DOC-8: tables and images swallow the text inside them; the rest in reading order.

    ``blocks(file_id, page_no, ord, kind, x0, y0, x1, y1, text)``. Containers are
    spread over the horizontal bands they cover, so a text only meets containers
    of its own band.
    """
    key = ["file_id", "page_no", "ord"]
    slack = CONTAIN_SLACK
    outer = blocks.filter("kind in ('table', 'image')").select(
        "file_id", "page_no", F.col("ord").alias("c_ord"), F.col("kind").alias("c_kind"),
        *[F.col(c).alias(f"c_{c}") for c in ("x0", "y0", "x1", "y1")],
        F.explode(F.sequence(F.floor((F.col("y0") - slack) / band), F.floor((F.col("y1") + slack) / band))).alias("band"))
    texts = blocks.filter("kind = 'text'").withColumn("band", F.floor(F.col("y0") / band))
    inside = texts.join(outer, ["file_id", "page_no", "band"]).filter(
        (F.col("c_x0") - slack <= F.col("x0")) & (F.col("c_y0") - slack <= F.col("y0"))
        & (F.col("c_x1") + slack >= F.col("x1")) & (F.col("c_y1") + slack >= F.col("y1")))
    owner = inside.groupBy(*key).agg(
        F.min_by(F.struct("c_kind", "c_ord"), F.struct(F.when(F.col("c_kind") == "table", 0).otherwise(1), "c_ord")).alias("o"),
        F.first("text").alias("text"))
    swallowed = owner.select(*key)
    captions = owner.filter("o.c_kind = 'image'").groupBy("file_id", "page_no", F.col("o.c_ord").alias("ord")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("i"), "text"))),
                                 lambda x: x["text"]), " ").alias("inner_text"))
    kept = (blocks.join(swallowed, key, "left_anti").join(captions, key, "left")
            .withColumn("text", F.when(F.col("kind") == "text", F.col("text")).otherwise(F.coalesce("inner_text", F.lit("")))))
    rank = F.expr("case kind when 'table' then 0 when 'image' then 1 else 2 end")
    order = F.struct(F.bround(F.col("y0") / READING_BAND).alias("row"), "x0", rank.alias("k"), F.col("ord").alias("o"))
    sort_key = kept.withColumn("_o", order)
    paged = sort_key.groupBy("file_id", "page_no").agg(
        F.array_sort(F.collect_list(F.struct("_o", "kind", "text", "x0", "y0", "x1", "y1"))).alias("b"))
    return paged.select("file_id", "page_no", F.posexplode("b").alias("pos", "b")).select(
        "file_id", "page_no", F.col("pos").cast("bigint").alias("pos"), F.col("b._o.o").alias("ord"),
        "b.kind", "b.text", "b.x0", "b.y0", "b.x1", "b.y1")


def page_channel(blocks: DataFrame) -> DataFrame:
    """DOC-9: how a page must be read, from the blocks left after DOC-8 and its characters."""
    chars = blocks.groupBy("file_id", "page_no").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "text", F.length(strip("text")))), F.lit(0)).alias("chars"),
        F.bool_or(F.col("kind") == "image").alias("any_image"))
    left = resolve_blocks(blocks).groupBy("file_id", "page_no").agg(
        *[F.bool_or(F.col("kind") == k).alias(f"has_{k}") for k in ("table", "image", "text")])
    few = F.col("chars") < MIN_PAGE_CHARS
    return chars.join(left, ["file_id", "page_no"]).select(
        "file_id", "page_no",
        F.when(few, "C").when(F.col("has_image") & F.col("has_text"), "M")
        .when(F.col("has_table"), "B").when(F.col("has_text"), "A").otherwise("C").alias("channel"),
        F.when(few & ~F.col("any_image"), "skipped").otherwise("ok").alias("page_status"))


def image_candidates(boxes: DataFrame) -> DataFrame:
    """DOC-10: usable image boxes of a page, the first eight from top left.

    ``boxes(file_id, page_no, ord, x0, y0, x1, y1, page_w, page_h)``.
    """
    from .scan import top_per_group
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ok = ((w > 0) & (h > 0) & (F.col("x0") >= -1) & (F.col("y0") >= -1)
          & (w <= F.col("page_w") * IMAGE_MAX_FACTOR) & (h <= F.col("page_h") * IMAGE_MAX_FACTOR)
          & (w * h >= F.col("page_w") * F.col("page_h") * IMAGE_MIN_SHARE))
    return top_per_group(boxes.filter(ok), ["file_id", "page_no"], [F.col("y0"), F.col("x0"), F.col("ord")], IMAGES_PER_PAGE)


def blocks_to_pages(blocks: DataFrame) -> DataFrame:
    """DOC-11: one record per page; failed blocks are left out."""
    def part(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("status") == "ok"),
                                                  F.struct("ord", "text", "text_in_image"))))
    pages = blocks.groupBy("file_id", "page_no").agg(part("text").alias("t"), part("table").alias("tables"), part("image").alias("images"))
    return pages.select("file_id", "page_no",
                        F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"),
                        F.transform("tables", lambda x: x["text"]).alias("tables"),
                        F.transform("images", lambda x: F.struct(
                            x["text"].alias("description"), F.coalesce(x["text_in_image"], F.lit("")).alias("text_in_image"))).alias("images"))


def render_pages(blocks: DataFrame) -> DataFrame:
    """DOC-12: Markdown of each page, its blocks in order."""
    packed = blocks.groupBy("file_id", "page_no").agg(F.array_sort(F.collect_list(F.struct(
        "ord", "kind", "text", "status", "error", "text_in_image"))).alias("b"))
    def fragment(b: Column, pos: Column) -> Column:
        seq = (pos + 1).cast("string")
        body = F.regexp_replace(b["text"], r"(?U)\s+$", "")
        desc = F.regexp_replace(F.when(b["text"] == "", F.lit("图")).otherwise(b["text"]), r"(?U)^\s+|\s+$", "")
        image = F.concat(F.lit("![图"), seq, F.lit("："), F.when(desc == "", F.concat(F.lit("图"), seq)).otherwise(desc), F.lit("]"),
                         F.when(F.coalesce(b["text_in_image"], F.lit("")) != "", F.concat(
                             F.lit("\n> 图中文字："), F.substring(b["text_in_image"], 1, INNER_TEXT_CHARS))).otherwise(F.lit("")))
        failed = F.concat(F.lit("<!-- 第"), b["ord"].cast("string"), F.lit("块("), b["kind"], F.lit(")识别失败："),
                          F.regexp_replace(F.coalesce(b["error"], b["status"]), r"(?U)^\s+|\s+$", ""), F.lit(" -->"))
        return F.concat(F.when(b["status"] != "ok", failed).when(b["kind"] == "image", image).otherwise(body), F.lit("\n"))

    text = F.array_join(F.transform("b", fragment), "\n")
    return packed.select("file_id", "page_no", F.concat(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def render_document(blocks: DataFrame) -> DataFrame:
    """DOC-12: Markdown of a document, pages by number with a separator before each."""
    pages = render_pages(blocks).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "markdown"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(
        F.lit("\n\n---\n\n<!-- page "), x["page_no"].cast("string"), F.lit(" -->\n\n"), x["markdown"])), "\n")
    return pages.select("file_id", F.concat(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def replace_page(nodes: DataFrame, new: DataFrame, order_block: int = NODE_BLOCK) -> DataFrame:
    """DOC-13: nodes of a page give way to new nodes where the page first stood, or at the end.

    ``nodes(file_id, idx, page, type, text)``; ``new`` names one page per file.
    """
    target = new.select("file_id", F.col("page").alias("_page")).distinct()
    old = nodes.withColumn("page", F.coalesce("page", F.lit(0)))
    place = (old.join(target, "file_id").groupBy("file_id").agg(
        F.min(F.when(F.col("page") == F.col("_page"), F.col("idx"))).alias("_at"), F.max("idx").alias("_end")))
    kept = old.join(target.select("file_id", F.col("_page").alias("page")), ["file_id", "page"], "left_anti").select(
        "file_id", "page", "type", "text", F.col("idx").alias("_major"), F.lit(0).cast("bigint").alias("_minor"))
    added = new.join(place, "file_id", "left").select(
        "file_id", "page", "type", "text", F.coalesce("_at", F.col("_end") + 1, F.lit(0)).alias("_major"), F.col("idx").alias("_minor"))
    return running(kept.unionByName(added), ["file_id"], ["_major", "_minor"], F.floor(F.col("_major") / order_block),
                   {"n": ("count", F.lit(1))}).select("file_id", (F.col("n") - 1).alias("idx"), "page", "type", "text")
