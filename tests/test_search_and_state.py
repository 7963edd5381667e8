"""Search pieces against brute force, sharing rules, ledgers and keyed folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.functions.names import compose_nfc
from quillwork.operators import cache, ledger, scan, search, textmatch, vectors
from quillwork.plans import load_all
from quillwork.plans.inputs import Inputs
from quillwork.sources import tables
from quillwork.streaming import folds, jobs
from quillwork.streaming.processors import fold_stream


def vec_df(spark, matrix, name):
    return spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(matrix)], f"{name} long, embedding array<float>, owner long")


def brute(q, c, k):
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    c = c / np.linalg.norm(c, axis=1, keepdims=True)
    sims = np.round(q @ c.T, 9)
    return {i: [int(j) for j in np.lexsort((np.arange(len(c)), -row))[:k]] for i, row in enumerate(sims)}


def test_vector_topk_is_exact_on_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16)) * 4
    c = np.float32(np.concatenate([x + rng.normal(size=(60, 16)) for x in centres] + [np.ones((40, 16))]))
    q = np.float32(np.concatenate([c[::23], rng.normal(size=(5, 16))]))
    got = {}
    for r in vectors.vector_topk(vec_df(spark, q, "query_id"), vec_df(spark, c, "chunk_id"), 7, cells=8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == brute(q.astype(float), c.astype(float), 7)


def test_blocks_split_a_hot_scope(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_BLOCK", 16)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 8)
    m = np.float32(np.random.default_rng(1).normal(size=(90, 8)))
    got = vectors.vector_topk(vec_df(spark, m, "query_id"), vec_df(spark, m, "chunk_id"), 3, keys=["owner"])
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append(r["chunk_id"])
    for own in range(3):
        ids = [i for i in range(90) if i % 3 == own]
        want = brute(m[ids].astype(float), m[ids].astype(float), 3)
        assert {i: rows[i] for i in ids} == {ids[a]: [ids[b] for b in v] for a, v in want.items()}


def test_scope_excludes(spark):
    files = spark.createDataFrame([(1, "org", 3, None, 1), (2, "personal", None, 7, 2)], "id long, owner_type string, org_id long, user_id long, dir_id long")
    assert [r["id"] for r in search.scope(files, org=3).collect()] == [1]
    assert [r["id"] for r in search.scope(files, user=7, directory=2).collect()] == [2]
    assert search.scope(files).count() == 2
    with pytest.raises(ValueError):
        search.scope(files, user=1, org=1)


def test_pair_scorer_and_tokenizer_plugins(spark):
    class Length:
        def score(self, questions, passages):
            return [float(len(p)) for p in passages]
    df = spark.createDataFrame([("q", "abc"), (None, "abcd")], "q string, p string")
    assert [r[0] for r in df.select(search.pair_scorer(Length)(F.col("q"), F.col("p"))).collect()] == [3.0, None]
    tok = search.batch_tokenizer(lambda: (lambda s: list(s)))
    assert df.select(tok("p")).first()[0] == ["a", "b", "c"]


def test_contains_join(spark):
    hay = spark.createDataFrame([(1, "x a big needle here y"), (2, "a big needle he"), (3, "none")], "hay_id long, hay string")
    needle = spark.createDataFrame([(9, "a big needle here")], "needle_id long, needle string")
    assert [(r["needle_id"], r["hay_id"]) for r in textmatch.contains_join(needle, hay).collect()] == [(9, 1)]


def test_contains_join_takes_needles_of_any_length(spark):
    rng = random.Random(4)
    signs = ["a", "b", "?", " ", "\n", "\u4e2d", "\u6587", "\U0001f600", "\U0001f601", "\u00e9"]
    text = lambda n: "".join(rng.choice(signs) for _ in range(n))
    hays = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, ""), (61, None), (62, "ab" * 50_000 + "end")]
    needles = [(i, text(rng.randint(1, 6))) for i in range(150)] + [(150, ""), (151, None), (152, "bend"), (153, "a b ? c"), (154, "\u4e2d\u6587"), (155, " ")]
    needles += [(200 + i, h[5:5 + rng.randint(1, 40)]) for i, h in hays[:60] if len(h) > 6]
    got = textmatch.contains_join(spark.createDataFrame(needles, "needle_id long, needle string"),
                                  spark.createDataFrame(hays, "hay_id long, hay string")).collect()
    assert sorted(map(tuple, got)) == sorted((n, h) for n, a in needles for h, b in hays if a and b is not None and a in b)


def test_running_matches_window_with_tiny_blocks(spark):
    from pyspark.sql import Window as W
    rng = random.Random(2)
    rows = [(k, i, rng.choice([None, 1, 2, 5])) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    got = scan.running(df, ["k"], ["i"], F.floor(F.col("i") / 7), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "c": ("count", F.col("v"))})
    w = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("k", "i", "v", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"),
                     F.last("v", True).over(w).alias("l"), F.count("v").over(w).alias("c"))
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_ledger_versions_and_uniqueness(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    ledger.publish(df, str(tmp_path / "t"), 1)
    ledger.publish(df.withColumn("v", F.lit("b")), str(tmp_path / "t"), 2)
    assert ledger.latest_version(spark, str(tmp_path / "t")).first()["v"] == "b"
    assert ledger.assert_unique(df, ["id"]).count() == 1
    with pytest.raises(Exception):
        ledger.assert_unique(df.unionByName(df), ["id"]).collect()


def test_log_append_and_artefacts(spark, tmp_path):
    log = spark.createDataFrame([(1, "2024-01-01", "x" * 600)], "id long, day string, target string")
    ledger.append_log(ledger.audit_rows(log), str(tmp_path / "log"))
    ledger.append_log(ledger.audit_rows(log), str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 and len(back.first()["target"]) == 500
    nodes = spark.createDataFrame([(1, 1, "paragraph", "b"), (1, 0, "paragraph", "a")], "file_id long, idx long, type string, text string")
    ledger.write_artefacts(ledger.to_artefacts(nodes, spark.createDataFrame([(1, "ok"), (2, "failed")], "file_id long, status string")), str(tmp_path / "art"))
    schema = "file_id bigint, status string, nodes array<struct<idx:bigint,type:string,text:string>>"
    got = {r["file_id"]: r["preview"] for r in ledger.preview(spark.read.schema(schema).json(str(tmp_path / "art"))).collect()}
    assert got == {1: "a\n\nb\n\n", 2: ""}


def test_load_relation(spark, tmp_path):
    spark.createDataFrame([(1, 2, "a.md", 5, 1)], "id long, user_id long, filename string, file_size long, status short").write.parquet(str(tmp_path / "user_file"))
    assert tables.load(spark, str(tmp_path), "user_file").select("filename").first()[0] == "a.md"
    with pytest.raises(KeyError):
        tables.load(spark, str(tmp_path), "nope")


def test_nfc(spark):
    assert spark.createDataFrame([("é",)], "s string").select(compose_nfc("s")).first()[0] == "é"


def test_shared_cache_rules(spark):
    """A asked over a shared and over a private file; B holds the shared blob, C does not."""
    files = spark.createDataFrame([(1, 10, 100, 1), (2, 10, 200, 1), (3, 20, 100, 1), (4, 30, 300, 1), (5, 40, None, 1)],
                                  "id long, user_id long, blob_id long, status int")
    entries = spark.createDataFrame([(1, 10, "h1", [1], 5, 1, False), (2, 10, "h2", [1, 2], 5, 1, False), (3, 10, "h3", [], 1, 1, False)],
                                    "id long, user_id long, query_hash string, file_ids array<long>, hit_count long, updated_s long, invalidated boolean")
    asks = spark.createDataFrame([(u * 10 + n, u, f"h{n}") for u in (10, 20, 30, 40) for n in (1, 2, 3)], "ask_id long, user_id long, query_hash string")
    strict = {(r["user_id"], r["query_hash"]) for r in cache.cache_shared(asks, entries, files).collect()}
    assert strict == {(20, "h1")}
    lax = {(r["user_id"], r["query_hash"]) for r in cache.cache_shared(asks, entries, files, compat=True).collect()}
    assert lax == {(20, "h1"), (20, "h3"), (30, "h3"), (40, "h1"), (40, "h2"), (40, "h3")}


# ---------------------------------------------------------------- keyed folds

def replay_loop(rows, fold, key):
    states, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts_ms, r.id)):
        out[r.id] = fold.step(states.setdefault(getattr(r, key), fold.fresh()), r)
    return out


def test_rate_limit_rule(spark):
    rows = [(i, "a", i * 1000) for i in range(25)] + [(100, "a", 90_000), (101, "b", 5)]
    df = spark.createDataFrame(rows, "id long, key string, ts_ms long")
    got = {r["id"]: r["allowed"] for r in folds.replay(df, folds.rate_limit(), ["key"]).collect()}
    assert [got[i] for i in range(25)] == [True] * 20 + [False] * 5
    assert got[100] and got[101]


def test_segments_do_not_change_results(spark):
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(3000):
        t += rng.choice([0, 10, 500, 3000, 30_000, 61_000, 130_000, 1_000_000])
        rows.append((i, f"k{rng.randint(0, 2)}", t, rng.random() < 0.4, rng.random() < 0.1, f"ip{rng.randint(0, 2)}", f"n{rng.randint(0, 4)}",
                     rng.choice(["failure", "failure", "failure", "success", "register"])))
    df = spark.createDataFrame(rows, "id long, key string, ts_ms long, ok boolean, forced boolean, ip string, name string, action string")
    local = df.collect()
    cases = [(folds.rate_limit(3), lambda d: folds.quiet_segments(d, ["key"], folds.WINDOW_MS), "allowed"),
             (folds.throttle(), lambda d: folds.quiet_segments(d, ["key"], folds.THROTTLE_MS), "kept"),
             (folds.login_guard(), lambda d: folds.quiet_segments(d, ["key"], folds.LOCK_MS), "verdict"),
             (folds.breaker(), lambda d: folds.reset_segments(d, ["key"], folds.BREAKERS["qa"][1]), "state_after")]
    for fold, cut, column in cases:
        want = replay_loop(local, fold, "key")
        at = [f.name for f in fold.out].index(column)
        got = {r["id"]: r[column] for r in folds.replay(cut(df), fold, ["key", "segment"]).collect()}
        assert got == {i: v[at] for i, v in want.items()}, column


def test_login_guard_locks_and_clears():
    from types import SimpleNamespace as N
    fold, state = folds.login_guard(), folds.login_guard().fresh()
    go = lambda t, action, ip="i", name="n": fold.step(state, N(ts_ms=t, ip=ip, name=name, action=action))[0]
    assert [go(t * 1000, "failure") for t in range(6)] == ["failure"] * 5 + ["locked"]
    assert go(4_000 + folds.LOCK_MS, "success") == "success"
    assert [go(10**7 + t, "register", ip="j") for t in range(4)] == ["registered"] * 3 + ["rate_limited"]


def test_semantic_cache_fold_evicts():
    from types import SimpleNamespace as N
    fold = folds.semantic_cache(cap=5)
    state = fold.fresh()
    eye = np.eye(8)
    for i in range(5):
        assert fold.step(state, N(id=i, query=f"q{i}", ts_ms=i, embedding=eye[i]))[0] is None
    assert fold.step(state, N(id=9, query="again", ts_ms=9, embedding=eye[0])) == (0, 5)
    assert fold.step(state, N(id=10, query="new", ts_ms=10, embedding=eye[6])) == (None, 5)
    assert fold.step(state, N(id=11, query="gone", ts_ms=11, embedding=eye[1]))[0] is None   # q1 was the oldest


def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    load_all()
    fx = Inputs(spark, "/root/testdata/sf0.001")
    rows = fx.v_fast.selectExpr("id", "user_id % 5 as key", "ts_ms")
    schema = rows.schema
    for part in range(3):   # files in event order
        rows.orderBy("ts_ms", "id").offset(part * 340).limit(340).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (fold_stream(source, folds.rate_limit(4), ["key"]).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert query.awaitTermination(120)
    got = {r["id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["id"]: r["allowed"] for r in folds.replay(rows, folds.rate_limit(4), ["key"]).collect()}
    assert len(got) == rows.count() and got == want


def test_idle_state_expires(spark, tmp_path):
    """STR-2: with a time to live the limiter forgets an idle key."""
    import time
    schema = "id long, key string, ts_ms long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, "a", 1000), (2, "a", 1001)])
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (fold_stream(source, folds.rate_limit(2), ["key"], ttl_ms=500).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start())
    try:
        deadline = time.time() + 60
        seen = lambda: {r["id"]: r["allowed"] for r in spark.read.schema(schema + ", allowed boolean").parquet(str(tmp_path / "out")).collect()}
        (tmp_path / "out").mkdir(exist_ok=True)
        while time.time() < deadline and len(seen()) < 2:
            time.sleep(1)
        time.sleep(2)
        put([(3, "a", 1002)])   # inside the minute by event time, but the state is gone
        while time.time() < deadline and len(seen()) < 3:
            time.sleep(1)
        assert seen() == {1: True, 2: True, 3: True}
    finally:
        query.stop()


def test_ingest_replaces_old_chunks(spark, tmp_path):
    root = str(tmp_path)
    write = lambda rows, mode: spark.createDataFrame(rows, jobs.DOCUMENT + ", seen bigint").write.mode(mode).parquet(f"{root}/in")
    run = lambda: jobs.start_ingest(spark, f"{root}/in", f"{root}/out", f"{root}/cp").awaitTermination(120)
    write([(1, "a.md", "# T\n\nold text of the file", 1), (2, "b.txt", "kept", 1)], "errorifexists")
    assert run()
    write([(1, "a.md", "# T\n\nnew text", 2)], "append")
    assert run()
    got = {r["file_id"]: (r["heading_path"], r["content"]) for r in jobs.current_chunks(spark, f"{root}/out").collect()}
    assert got == {1: ("T", "new text"), 2: ("", "kept")}
