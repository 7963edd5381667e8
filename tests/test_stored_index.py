"""Stored postings against the search over texts, with ties, empty texts, scopes and segments of all sizes."""

import random

import pytest
from pyspark.sql import functions as F

from quillwork.operators import postings, search


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    out = [(i, "h > x" if i % 3 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return out + [(5000, None, ""), (5001, None, "w1 w1 w1"), (5002, None, "w1 w1 w1"), (70000, "h", "rare word once"), (-7, None, "rare again")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, h, t, i % 4) for i, h, t in corpus()], "chunk_id bigint, heading_path string, content string, org_id bigint").repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(9)
    asked = [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(1, 6))) for _ in range(30)]
    asked += ["", "nothing known", "rare", "w1 w1 rare word", "once W1"]
    return spark.createDataFrame([(q, t, q % 4) for q, t in enumerate(asked)], "query_id bigint, question string, org_id bigint")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["bm25"], 8)) for r in df.collect())


@pytest.mark.parametrize("segment,k", [(1, 3), (16, 5), (128, 50), (10 ** 6, 5)])
def test_index_gives_the_ranks_of_a_full_search(spark, chunks, questions, segment, k):
    index = postings.build_index(chunks, segment=segment)
    assert rows(postings.search_index(questions, index, k)) == rows(search.bm25_topk(questions, chunks, k))


def test_index_by_scope(spark, chunks, questions):
    index = postings.build_index(chunks, keys=["org_id"], segment=32)
    assert rows(postings.search_index(questions, index, 7)) == rows(search.bm25_topk(questions, chunks, 7, ["org_id"]))


def test_index_skips_segments_and_reads_no_texts(spark, chunks, questions):
    index = postings.build_index(chunks, segment=16)
    asked = postings.weights(questions, index)
    heads = index.read(spark, "postings")
    every = asked.join(heads, ["bucket", "term"]).select("query_id", "segment").distinct().count()
    live = postings.live_segments(asked, index, 3).count()
    assert live < 0.7 * every
    assert "content" not in heads.columns and heads.agg(F.max(F.size("entries"))).first()[0] <= 16


def test_empty_index(spark, chunks, questions):
    index = postings.build_index(chunks.limit(0))
    assert postings.search_index(questions, index).count() == 0
    assert postings.search_index(questions.limit(0), postings.build_index(chunks)).count() == 0


@pytest.mark.parametrize("keys", [None, ["org_id"]])
def test_search_is_the_same_with_and_without_broadcast(spark, chunks, questions, keys, monkeypatch):
    sent = rows(search.bm25_topk(questions, chunks, 7, keys))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    terms = search.query_terms(questions, [])
    assert search.fitting(terms) is terms and search.fitting(terms.limit(0)) is not terms
    assert rows(search.bm25_topk(questions, chunks, 7, keys)) == sent
