"""Work that grows no faster than its input: long tables, many keys, repeated reads."""

import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from quillwork.functions.tables import register_table_functions
from quillwork.functions.text import sql_call
from quillwork.operators import chunking, clean, postings, search, textmatch, vectors
from quillwork.plans import load_all
from quillwork.plans.inputs import TABLES, Inputs
from quillwork.plans.search_queries import visible
from quillwork.streaming import folds

SF = "/root/testdata/sf0.001"
load_all()


def folder_with(tmp_path, **changed) -> str:
    """The small tables, some of them replaced."""
    for name in TABLES:
        if name in changed:
            changed[name].toPandas().to_parquet(tmp_path / f"{name}.parquet", index=False, coerce_timestamps="us")
        else:
            (tmp_path / f"{name}.parquet").symlink_to(Path(SF) / f"{name}.parquet")
    return str(tmp_path)


def test_long_tables_are_cut_in_linear_steps(spark):
    """Each group of ten rows once cut the whole table into lines again: minutes for this one."""
    rows = 60_000
    text = spark.range(1).selectExpr("1L as table_id", f"concat('| a | b |\\n|---|---|\\n', array_join(transform(sequence(1, {rows}), i -> concat('| ', i, ' | x |')), '\\n')) as text").localCheckpoint()
    register_table_functions(spark)
    start = time.time()
    forms = [chunking.split_column(text, "table_id", chunking.table_pieces(F.col("text"))).select("piece_no", "piece"),
             spark.sql("select cast(n.piece_no as bigint) as piece_no, n.piece from {t} t, lateral split_table(t.text) n", t=text)]
    for form in forms:
        got = {r.piece_no: r.piece for r in form.collect()}
        assert len(got) == rows // 10 and got[1].split("\n") == ["| a | b |", "|---|---|", *[f"| {i} | x |" for i in range(11, 21)]]
    assert time.time() - start < 30


@pytest.mark.parametrize("name", ["str10_live_metrics", "str10_live_metrics_sliding", "str10_live_metrics_stream"])
def test_hours_and_halves_are_exact(spark, tmp_path, name):
    """The last half millisecond of an hour belongs to it, and a mean of 1030.2495 is rounded up."""
    events = spark.range(2000).selectExpr(
        "id as event_id", "timestamp'2024-01-01 00:59:59.999700' as ts", "id % 7 as user_id", "'view' as event_type",
        "if(id < 499, 10.315D, 10.305D) as value", "'p' as props")
    folder = folder_with(tmp_path, events=events)
    assert compare(spark, connect(folder), name, folder).startswith("ok")


def test_token_budget_holds_all_days_of_a_user():
    """One state a user: days have their own sums, and a late event finds that of its day again."""
    fold = folds.token_budget(10, "day")
    state = fold.fresh()
    first = fold.run(state, pd.DataFrame({"id": [1, 2, 3], "day": [5, 5, 6], "tokens": [8, 4, 3]}))
    late = fold.run(state, pd.DataFrame({"id": [4, 5], "day": [5, 6], "tokens": [1, 1]}))
    assert [*first.used_before, *late.used_before] == [0, 8, 0, 12, 3]
    assert [*first.allowed, *late.allowed] == [True, True, True, False, True]


def test_vectors_are_read_once(spark):
    """Counts, sizes and cells once evaluated the chunks four times, texts and all."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def vector(i):
        seen.add(1)
        return [float(i % 7), float(i % 11), 1.0]

    chunks = spark.range(7000).select(F.col("id").alias("chunk_id"), vector("id").alias("embedding"))
    asked = spark.createDataFrame([(1, [1.0, 2.0, 1.0])], "query_id bigint, embedding array<float>")
    assert vectors.vector_topk(asked, chunks, 50).count() == 50
    assert seen.value <= 7000 * 2   # a null check may ask for a vector of its own


@pytest.mark.parametrize("cells", [None, 5])
def test_blocks_and_tiles_keep_every_hit(spark, monkeypatch, cells):
    """Screened in single precision; ties, copies, zero vectors and near misses rank as by brute force."""
    for name, value in {"QUERY_TILE": 16, "TILE": 32, "CHUNK_BLOCK": 150, "QUERY_BLOCK": 40, "BLOCK_BYTES": 0, "EXACT": 7}.items():
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 6)).astype("f4")
    m[100:180], m[200:210], m[300:340] = m[0], 0, m[1] + rng.normal(size=(40, 6)).astype("f4") * 1e-6
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    got = vectors.vector_topk(spark.createDataFrame(rows, "query_id bigint, embedding array<float>"),
                              spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>"), 9, cells=cells).collect()
    d = m.astype("f8")
    u = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
    sims = np.round(u @ u.T, 9)
    want = {(q, int(c), r + 1) for q in range(400) for r, c in enumerate(np.lexsort((np.arange(400), -sims[q]))[:9])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == want


def test_search_reads_no_blobs(spark):
    """The files of a search have no blob; to find it, all texts were hashed, dealt and joined again at each use."""
    fx = Inputs(spark, SF)
    plan = visible(fx).select("chunk_id", "content", "filename", "org_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "Aggregate" not in plan
    assert visible(fx).count() == fx.sql("select c.chunk_id from {v_chunk_row} c join {v_user_file} f on f.id = c.file_id and f.status = 1").count()


def test_index_moves_postings_once(spark, monkeypatch):
    """Blocks were built by two shuffles of all postings; a search moved all blocks, then every hit."""
    chunks = spark.range(3000).selectExpr("id as chunk_id", "'h' as heading_path", "concat('w', id % 7, ' w', id % 11, ' w', id % 7, ' x', id) as content")
    asked = spark.createDataFrame([(1, "w1 w2 x5"), (2, "w6 w10"), (3, "none")], "query_id bigint, question string")
    index = postings.build_index(chunks, segment=64)
    assert index.read(spark, "frequencies").groupBy("segment", "term").count().filter("count > 1").isEmpty()
    want = sorted(search.bm25_topk(asked, chunks, 9).select("query_id", "chunk_id", "rank").collect())
    found = postings.search_index(asked, index, 9)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    assert sorted(found.select("query_id", "chunk_id", "rank").collect()) == want
    monkeypatch.setattr(postings, "LISTED", 0)
    assert sorted(postings.search_index(asked, index, 9).select("query_id", "chunk_id", "rank").collect()) == want


def test_packing_workers_stay_small():
    """A worker that has seen many words stays below the share of an executor it has beside another worker."""
    code = """if True:
        import random, resource
        from quillwork.llm.packing import BLOCK_BYTES, WordCache, vocabulary_path
        import pyarrow as pa
        cache, rng = WordCache(vocabulary_path()), random.Random(1)
        for _ in range(4 * (8 << 20) // BLOCK_BYTES):
            text = " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(BLOCK_BYTES // 60))
            cache.block(pa.array([text] * 6))
        print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 300


def test_short_needles_shuffle_no_texts(spark):
    """All runs of three characters of all texts were once written, shuffled and joined with whole texts."""
    words = [f"w{i * i % 977}x{i}" for i in range(400)]
    hays = spark.createDataFrame([(i, " ".join(words[i % 7::1 + i % 5])) for i in range(300)], "hay_id long, hay string")
    needles = spark.createDataFrame([(i, w) for i, w in enumerate(["w", "x1", "7x", "1 w", " ", "x399", "nowhere"])], "needle_id long, needle string")
    found = textmatch.contains_join(needles, hays)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan.split("Union")[1].split("MapInArrow")[1].lower()
    want = sorted((n.needle_id, h.hay_id) for n in needles.collect() for h in hays.collect() if n.needle in h.hay)
    for block_bytes in (textmatch.BLOCK_BYTES, 200):
        assert sorted(map(tuple, textmatch.contains_join(needles, hays, block_bytes).collect())) == want


def test_blanks_and_junk_are_found_without_rewriting_texts(spark):
    """Same results as the plain rules; a long text once was rewritten as a whole to see that it holds a word."""
    rng = np.random.default_rng(5)
    signs = list("ab._-é中 \n\r\t") + ["\r\n", "\x00", "\x0b", "\x1f", "\x85", "\xa0", " ", " ", "​", " ", " ", " ", "⁠", "　", "﻿", "\U0001f600"]
    rows = [("", "text"), (None, "text")] + [("".join(rng.choice(signs, rng.integers(1, 7))), str(rng.choice(["text", "code", "table"]))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "t string, k string")
    same = df.select(
        F.expr(sql_call("strip_text", t="t")).eqNullSafe(F.expr(r"regexp_replace(t, r'(?U)^\s+|\s+$', '')")).alias("strip"),
        F.expr(sql_call("is_junk", t="t")).eqNullSafe(F.expr(r"regexp_replace(t, r'(?U)[\s\W_]+', '') = ''")).alias("junk"),
        F.element_at(F.transform(F.array(F.struct("t", "k")), lambda n: clean.clean_text(n["t"], n["k"])), 1).alias("one"), "t", "k")
    assert same.filter("not strip or not junk").count() == 0
    rules = clean.clean_nodes(df.withColumnRenamed("t", "text").withColumnRenamed("k", "type")).select("text")
    assert [r.one for r in same.collect()] == [r.text for r in rules.collect()]
    long = spark.range(0, 400, 1, 4).selectExpr("concat(id, repeat(' some, words', 100000)) as t").localCheckpoint()
    took = []
    for junk in ("max(1)", r"max(regexp_replace(t, r'(?U)[\s\W_]+', '') = '')", f"max({sql_call('is_junk', t='t')})"):
        start = time.time()
        long.agg(F.expr(junk)).collect()
        took.append(time.time() - start)
    assert took[2] < took[1] / 4


def test_keyword_search_scores_where_the_text_is(spark, monkeypatch):
    """Each common word of a text once met every question as a row of its own, and all found words were shuffled."""
    words = [f"w{i}" for i in range(40)]
    texts = spark.range(0, 3000, 1, 6).selectExpr(
        "concat('c', lpad(id, 5, '0')) as chunk_id", "'' as heading_path",
        "array_join(transform(sequence(1, 30), i -> concat('w', cast(pmod(xxhash64(if(id < 500, 0, id), i), 40) as string))), ' ') as content").localCheckpoint()
    texts = texts.unionByName(spark.createDataFrame([("empty", None, None), ("x", "w1", "")], "chunk_id string, heading_path string, content string"))
    questions = spark.createDataFrame([(i, " ".join([words[i % 40], words[i * 7 % 40], "the", words[i * 11 % 40]])) for i in range(60)]
                                      + [(60, None), (61, "nowhere"), (None, "w3 w3")], "query_id bigint, question string")
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> dict[str, int]:
        found = manager.getAllFiles()
        return {f.getName(): f.length() for f in (found.apply(i) for i in range(found.size())) if f.getName().endswith(".data")}

    def answer() -> tuple[list, int]:
        before = shuffled()
        rows = search.bm25_topk(questions, texts, 9).orderBy("query_id", "rank").select("query_id", "rank", "chunk_id", "bm25").collect()
        return rows, sum(size for name, size in shuffled().items() if name not in before)

    whole, few = answer()
    monkeypatch.setattr(search, "CELLS", 64, raising=False)
    monkeypatch.setattr(search, "PAIRS", 16, raising=False)
    cut, _ = answer()
    monkeypatch.setattr(search, "BROADCAST_BYTES", -1)
    joined, many = answer()
    assert [tuple(r)[:3] for r in whole] == [tuple(r)[:3] for r in cut] == [tuple(r)[:3] for r in joined] and len(whole) > 500
    assert max(abs(a.bm25 - b.bm25) for a, b in zip(whole, joined)) < 1e-8
    assert 2 * few < many
