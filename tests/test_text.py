"""Unit cases for nodes, cleaning and chunks, and comparison with small specifications in plain Python or SQL."""

import random
import re
from functools import reduce
from itertools import batched, groupby

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillwork.functions.text import fn
from quillwork.operators import chunking as ck
from quillwork.operators import clean as cl
from quillwork.operators import nodes as nd
from quillwork.plans.doc_queries import MARKDOWN_SQL
from quillwork.sources import files as src

NODE = "file_id long, idx long, type string, text string, level long, page long"


def nodes_df(spark, rows):
    return spark.createDataFrame(rows, NODE)


# ---------------------------------------------------------------- readers and gates

def test_decoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo\r\nb\rc".encode())
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfbom")
    (tmp_path / "c.txt").write_bytes("中文内容".encode("gbk"))
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\xfa\x00\xff")
    got = {r["path"][-5:]: (r["text"], r["error"] is None) for r in src.read_text_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("héllo\nb\nc", True)
    assert got["b.txt"] == ("bom", True)
    assert got["c.txt"] == ("中文内容", True)
    assert got["d.txt"][1] is False


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"questions": [{"id": "1", "question": "x?", "evidence_keywords": ["a", "b"]}]}')
    rows = src.read_questions(spark, str(tmp_path / "q.json")).collect()
    assert [(r["question"], r["evidence_keywords"]) for r in rows] == [("x?", ["a", "b"])]


def test_magic(spark):
    df = spark.createDataFrame([("pdf", bytearray(b"xx%PDF-1.4")), ("pdf", bytearray(b"%PDF-1.4")), ("png", bytearray(b"\x89PNG..")),
                                ("docx", bytearray(b"%PDF")), ("md", bytearray(b"#"))], "ext string, content binary")
    assert [r["magic_ok"] for r in src.with_magic_ok(df).collect()] == [False, True, True, False, True]
    assert [r["magic_ok"] for r in src.with_magic_ok(df, mode="scan").collect()] == [True, True, True, False, True]


# ---------------------------------------------------------------- Markdown

def test_markdown_against_line_windows(spark):
    """The one-pass pattern against a line-by-line formulation in SQL windows, on random line mixes."""
    rng = random.Random(7)
    parts = ["# A", "## B c", "####### no", "text one", "  indented", "", "- item", "1. first", "```", "~~~", "| a | b |", "|---|---|",
             "| x |", "a | b", "---|---", "#tag", "  ", "* star", "|", "||"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in nd.markdown_to_nodes(df).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append((r["type"], r["text"], r["level"]))
    con = duckdb.connect()
    con.execute("create table t (doc_id bigint, text varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    want = {}
    for doc, _, kind, text, level in con.execute(f"select doc_id, idx, type, text, level from ({MARKDOWN_SQL.replace('{v_markdown}', 't')}) order by 1, 2").fetchall():
        want.setdefault(doc, []).append((kind, text, level))
    for i, text in enumerate(texts):
        assert got.get(i, []) == want.get(i, []), text


# ---------------------------------------------------------------- cleaning

def test_cleaning_flags(spark):
    rows = [(1, 0, "paragraph", "a\r\nb", None, None), (1, 1, "paragraph", " x　　y ", None, None), (1, 2, "code", "  a  b ", None, None),
            (1, 3, "paragraph", "z​z\x07", None, None), (1, 4, "table", "| a  | b |", None, None)]
    got = [(r["text"], r["flags"]) for r in cl.clean_nodes(nodes_df(spark, rows)).orderBy("idx").collect()]
    assert got == [("a\nb", ["nl"]), ("x y", ["space", "mspace", "strip"]), ("  a  b ", []), ("zz", ["ctrl", "zw"]), ("| a  | b |", [])]


def test_junk_keeps_cjk(spark):
    df = spark.createDataFrame([("。。__ -",), ("中",), ("",)], "t string")
    assert [r[0] for r in df.select(fn("is_junk", t="t")).collect()] == [True, False, True]


# ---------------------------------------------------------------- broken lines

ENDS = set("。！？；：”’）】》")


def glue(left, right):
    both = re.search("[A-Za-z]$", left) and re.match("[A-Za-z]", right)
    return f"{left} {right}" if both else left + right


def merged_lines(text):
    """A line starts anew when it is empty, or follows a line that ended a sentence."""
    def add(lines, line):
        if lines and line and lines[-1][-1:] not in ENDS:
            return lines[:-1] + [glue(lines[-1], line)]
        return lines + [line]
    return "\n".join(reduce(add, (x.strip() for x in text.split("\n")), [])) if "\n" in text else text


def merged_nodes(nodes):
    """Groups of nodes where each continues the one before, told from the pair alone."""
    def continues(a, b):
        tail, body = a[1].strip(), b[1].strip()
        return (a[0] == b[0] == "paragraph" and a[2] == b[2] and tail and body
                and tail[-1] not in ENDS and b[1][0] not in " \t　")
    starts = [i for i in range(len(nodes)) if i == 0 or not continues(nodes[i - 1], nodes[i])] + [len(nodes)]
    for at, end in zip(starts, starts[1:]):
        kind, first, _ = nodes[at]
        head = merged_lines(first) if kind == "paragraph" else first
        rest = [n[1].strip() for n in nodes[at + 1:end]]
        yield kind, reduce(glue, rest, head.rstrip()) if rest else head


def test_merge_against_pairs(spark):
    rng = random.Random(3)
    texts = ["ab", "cd。", " in", "x\ny", "x。\ny\n", "", "中", "q\n\nr", "end！", "　z"]
    files = {f: [(rng.choice(["paragraph"] * 5 + ["table"]), rng.choice(texts), rng.randint(0, 1)) for _ in range(rng.randint(1, 9))] for f in range(300)}
    rows = [(f, i, k, t, None, p) for f, ns in files.items() for i, (k, t, p) in enumerate(ns)]
    got = {}
    for r in nd.merge_broken_lines(nodes_df(spark, rows)).orderBy("file_id", "idx").collect():
        got.setdefault(r["file_id"], []).append((r["type"], r["text"]))
    for f, ns in files.items():
        assert got[f] == list(merged_nodes(ns)), ns


# ---------------------------------------------------------------- chunks

def packed(parts, step, joint, carry):
    def add(state, part):
        done, cur = state
        closed = done + [cur] * bool(cur)
        if len(part) > 500:
            cuts = -(-(len(part) - 500) // step)
            return closed + [part[i * step:i * step + 500] for i in range(cuts)], part[cuts * step:]
        if len(cur) + len(joint) + len(part) <= 500:
            return done, joint.join((cur, part) if cur else (part,))
        return closed, cur[len(cur) - min(carry, len(cur)):] + part
    done, cur = reduce(add, parts, ([], ""))
    return done + [cur] * bool(cur)


def cut(kind, text):
    lines = text.splitlines()
    if kind == "table" and len(lines) > 12:
        return ["\n".join(lines[:2] + list(rows)) for rows in batched(lines[2:], 10)]
    if kind in ("paragraph", "list", "code") and len(text) > 500:
        sentences = re.findall(r"[^。！？\n]*[。！？\n]|[^。！？\n]+$", text)
        return packed(sentences, 450, "", 50) if kind == "paragraph" else packed(lines, 500, "\n", 0)
    return [text]


def open_titles(heads):
    """Titles still open after ``heads``: those no later heading of the same or a lower level follows."""
    return " > ".join(t for i, (level, t) in enumerate(heads) if all(later > level for later, _ in heads[i + 1:]))


def expected_chunks(nodes):
    heads, units = [], []          # unit: (may be gathered, kind, text, path, page)
    for kind, text, level, page in nodes:
        text = text.strip()
        if not re.search(r"[^\W_]", text):
            continue
        if kind == "heading":
            heads.append((level or (heads[-1][0] if heads else 1), text))
            units.append((False, None, "", "", None))
        else:
            small = kind == "list" or (kind == "paragraph" and len(text) < 100)
            units.append((small, kind, text, open_titles(heads), page))
    rows = []
    for small, run in groupby(units, key=lambda u: u[0]):
        if not small:
            rows += [(k, piece, path, page) for _, k, t, path, page in run if k for piece in cut(k, t)]
            continue
        run, totals = list(run), []
        for u in run:              # number of the gathering each unit falls into
            number, size = totals[-1] if totals else (0, 0)
            totals.append((number + (size >= 500), (0 if size >= 500 else size) + len(u[2])))
        for (_, kind), members in groupby(zip(totals, run), key=lambda m: (m[0][0], m[1][1])):
            members = [u for _, u in members]
            text = "\n".join(u[2] for u in members)
            rows += [(kind, piece, members[0][3], members[0][4]) for piece in (cut("list", text) if kind == "list" else [text])]
    first = {}
    for seq, (kind, text, path, page) in enumerate(rows, 1):
        first.setdefault(text, (kind, seq, text, path, page))
    return list(first.values())


def random_nodes(rng):
    def text():
        size = rng.choice([3, 40, 91, 120, 600, 1300])
        return "".join(rng.choice("abc defg 中文。！\n") for _ in range(size))
    kinds = ["heading", "paragraph", "paragraph", "paragraph", "list", "list", "table", "image", "code"]
    out = []
    for _ in range(rng.randint(0, 25)):
        kind = rng.choice(kinds)
        body = "h" + str(rng.randint(0, 9)) if kind == "heading" else text()
        if kind == "table":
            body = "\n".join(f"| {i} |" for i in range(rng.choice([3, 12, 13, 40])))
        out.append((kind, body, rng.choice([None, 1, 2, 3]) if kind == "heading" else None, rng.choice([None, 1, 2])))
    return out


def test_chunker_against_units(spark):
    rng = random.Random(11)
    docs = {d: random_nodes(rng) for d in range(150)}
    rows = [(d, [Row(type=k, text=t, level=lv, page=p) for k, t, lv, p in ns]) for d, ns in docs.items()]
    df = spark.createDataFrame(rows, "file_id long, nodes array<struct<type:string,text:string,level:long,page:long>>")
    got = {}
    for r in ck.chunk_documents(df).orderBy("file_id", "seq").collect():
        got.setdefault(r["file_id"], []).append((r["chunk_type"], r["seq"], r["content"], r["heading_path"], r["page_no"]))
        assert r["chars"] == len(r["content"])
    for d, ns in docs.items():
        assert got.get(d, []) == expected_chunks(ns)


def test_long_pieces_bounds(spark):
    text = "字" * 1300
    pieces = spark.createDataFrame([(text,)], "t string").select(ck.long_pieces(F.col("t"))).first()[0]
    assert [len(p) for p in pieces] == [500, 500, 400]
    assert pieces[0][-50:] == pieces[1][:50]


def test_heading_path_replaces_top(spark):
    rows = [(1, 0, "heading", "A", 1, None), (1, 1, "heading", "B", 2, None), (1, 2, "paragraph", "p", None, None),
            (1, 3, "heading", "C", None, None), (1, 4, "paragraph", "q", None, None), (1, 5, "heading", "D", 1, None), (1, 6, "paragraph", "r", None, None)]
    got = [r["heading_path"] for r in ck.with_heading_path(nodes_df(spark, rows)).orderBy("idx").collect()]
    assert got == ["A > B", "A > C", "D"]


def test_encoder_plugin(spark):
    class Two:
        dims = 2

        def encode(self, texts):
            import numpy as np
            return np.array([[3.0, 4.0]] * len(texts))
    out = ck.embed(spark.createDataFrame([("a",), ("b",)], "embed_text string"), Two).first()["embedding"]
    assert out == pytest.approx([0.6, 0.8])
