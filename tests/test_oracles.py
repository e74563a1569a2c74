"""Registered queries beside their SQL at the smallest scale.

By default a representative part runs; QUORATE_ALL_ORACLES=1 runs all.
"""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
PART = (
    "panel_grid annotation_draw stratified_sample agent_weights isotonic_apply decisions_weighted tau_star "
    "baseline_solo minimal_slice risk_coverage ece_quantile reliability_bins aurc risk_at_coverage "
    "response_probability ablation_variants operating_point error_concordance all_wrong_ratio kappa "
    "paired_comparison cost_by_stage chunk_documents html_text repair_audit article_anchors verdict_parse "
    "json_answer_parse bm25_topk split_index_topk dense_topk retrieval_sweep rrf_fusion quota_retrieval "
    "passage_recall corpus_records question_items citation_lines request_table retrieval_ladder"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("QUORATE_ALL_ORACLES") else PART


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name]) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 3
