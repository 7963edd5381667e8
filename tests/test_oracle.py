"""Every registered query with an oracle, on the smallest tables. Searches repeat one chain, so a few stand for it."""

import pytest

from oracle_check import compare, connect
from quillwork.plans import load_all
from quillwork.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
load_all()
SLOW = {n for n in QUERIES if n.startswith(("ret", "ans2", "ans6", "ans8", "evl2", "evl3", "evl6", "evl7", "dia8", "str", "idx2_embed", "chk1"))}
KEEP = {"ret1_scope_org", "ret2_visible_chunks", "ret3_vector_topk", "ret3_vector_topk_scoped", "ret5_tokenize", "ret6_bm25_org",
        "ret12_hybrid_cascade", "str1_rate_limit", "str4_token_budget", "str7_throttle_stream", "str10_live_metrics", "chk1_heading_path"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SLOW or n in KEEP))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, SF).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
