"""The pipeline's stages against plain versions, each on its own input, and the registered queries."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillwork.llm import packing, toxicity
from quillwork.llm.queries import ORACLES, QUERIES
from quillwork.llm.textkit import store, table
from test_operators import classes, fingerprint, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark: copies, near copies, shared lines, passages, nulls and odd rows."""
    base, item = prose(1, 200), " ".join(prose(50, 40))
    lines = ["\n".join(" ".join(prose(300 + 9 * i + k, 8)) for k in range(6)) for i in range(4)]
    docs = [(i, " ".join(prose(500 + i, 40 + i)) + (" grubwort fiesling grubwort" if i % 4 == 0 else "")) for i in range(60)]
    docs += [(100, " ".join(base)), (101, " ".join(base)), (102, " ".join(base[:99] + ["new"] + base[100:])),
             (103, lines[0]), (104, "top\n" + lines[0] + "\nend"), (105, item + " " + " ".join(prose(60, 100))),
             (106, item + " " + " ".join(prose(61, 2000))), (107, None), (108, ""), (109, "short"), (None, "no id"), (110, "twice"), (110, "twice")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, None if i == 5 else "xx", None, len(t) if t else None) for i, t in docs],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_stages(spark, folder):
    docs, taken = table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = store(stage(spark, before, folder), name)
        taken[name] = before, docs
        if name != "packing":
            assert docs.columns == before.columns

    before, after = taken["toxicity"]
    scores = {(r.doc_id, r.score) for r in toxicity.score(before, toxicity.train(before, table(spark, folder, "labels"))).collect()}
    gone = {i for i, s in scores if s >= 0.5}
    assert rows_of(after) == collections.Counter({r: n for r, n in rows_of(before).items() if r[0] not in gone})
    assert len(gone & set(range(0, 60, 4))) >= 13 and len(gone - set(range(0, 60, 4))) <= 1

    before, after = taken["line_dedup"]
    first, want = {}, collections.Counter()
    for step in (0, 1):
        for (i, t, *rest, n), count in rows_of(before).items():
            lines, drop = [] if t is None else t.split("\n"), set()
            for k in range(len(lines) if i is not None else 0):
                for size in (1, 2, 3):
                    run = tuple(x.strip() for x in lines[k:k + size])
                    if len(run) == size and (size == 3 or sum(len(x.split()) for x in run) >= 50):
                        first[run] = min((i, k), first.get(run, (i, k)))
                        drop |= set(range(k, k + size)) if first[run] < (i, k) else set()
            if step:
                text = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop)
                want[(i, text, *rest, len(text) if drop else n)] += count
    assert rows_of(after) == want and sum(r[0] == 104 and r[1] == "top\nend" for r in want) == 1

    before, after = taken["near_dedup"]
    given = sorted(rows_of(before), key=lambda r: (r[0] is None, r[0] or 0))
    label = classes([fingerprint(r[1], 5) for r in given], lambda a, b: (a ^ b).bit_count() <= 4)
    assert rows_of(after) == collections.Counter(r for k, r in enumerate(given) if label[k] == k or r[0] is None)

    before, after = taken["decontamination"]
    item = prose(50, 40)
    kept = {r for r in rows_of(before) if not (r[1] and r[1].split()[:40] == item and 20 * 40 >= len(r[1].split()))}
    assert set(rows_of(after)) == kept and not any(r[0] == 105 for r in kept) and any(r[0] == 106 for r in kept)

    before, after = taken["packing"]
    tokenizer = packing.WordCache(packing.vocabulary_path()).tokenizer
    pieces = collections.defaultdict(list)
    for r in after.collect():
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for r in before.collect():
        assert [x for _, p in sorted(pieces[r.doc_id]) for x in p] == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]

    whole = corpus_pipeline.run(spark, folder)
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == collections.Counter(
        (r.doc_id, r.start, r.ids_crc32) for r in after.collect())


def test_near_dedup_links_at_similarity(spark, folder):
    """Copies with words replaced, at similarities from 0.6 to 0.98, against all pairs compared in full."""
    rng, rows = np.random.default_rng(3), []
    for i in range(60):
        words = prose(2000 + i, 250)
        changed = list(words)
        for at in rng.choice(250, 1 + i % 9, replace=False):
            changed[at] = f"new{i}x{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    sets = [{tuple(t.split()[k:k + 5]) for k in range(246)} for _, t in rows]
    same = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    label = classes(sets, same)
    table_ = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, table_, folder).collect()}
    assert kept == {rows[k][0] for k in range(len(rows)) if label[k] == k}
    assert 20 < len(rows) - len(kept) < 60


def test_stages_take_empty_tables_and_more_columns(spark, folder):
    docs = table(spark, folder, "documents")
    odd = docs.withColumns({c: F.lit("z") for c in ("fp", "id", "key", "rest", "starts", "component_id", "score", "n_words", "label", "k", "t")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, odd, folder)
        assert name == "packing" or out.columns == odd.columns
        assert out.count() == stage(spark, docs, folder).count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    from oracle_check import connect
    sf = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = connect(sf).execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert collections.Counter(tuple(r[c] for c in columns) for r in df.collect()) == collections.Counter(want)


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_langid"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
