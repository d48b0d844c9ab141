"""Physical plans: what reaches the scan, and which joins are never planned."""

import re

import pytest

from glosswork import plans

QUERIES = plans.queries()
#: Queries whose nested-loop join is with one row or with a stated, bounded set.
SMALL_LOOPS = {"cross_scores", "cosine_scores", "duration_stats", "label_import", "threshold_sweep", "tradeoff_curve", "ir_metrics_scored"}
NATIVE = [
    "sentence_split", "neighbor_context", "topn_per_group", "crosstab_pivot", "line_clean", "section_split", "chunk_pack", "heading_promotion", "interval_overlap_join", "chapter_assign", "asof_lookup", "interval_merge",
    "rolling_dedup", "segment_chunk", "guard_output_v2", "substring_join", "grounding_check", "vocab_overlap", "keep_last", "ledger_merge", "qa_siblings", "ordered_distinct", "corpus_fingerprint", "stratified_sample", "validate_rows", "backfill_merge", "flatten_props", "degree_stats",
]


def plan(spark, small, name):
    return QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_product(spark, small, name):
    text = plan(spark, small, name)
    assert "CartesianProduct" not in text
    assert name in SMALL_LOOPS or "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Python|Pandas|MapInArrow", text)


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(spark, small, "eligible_filter")
    assert "GreaterThanOrEqual(n_chars,200)" in text
    assert re.search(r"ReadSchema: struct<doc_id:bigint,n_chars:bigint>", text)
    text = plan(spark, small, "hash_join_lookup")
    assert "l_extendedprice" not in text and "p_retailprice" not in text


def test_ranks_are_limited_before_the_shuffle(spark, small):
    assert plan(spark, small, "stratified_sample").count("WindowGroupLimit") >= 2
    assert plan(spark, small, "topn_per_group").count("WindowGroupLimit") >= 2


def test_keep_first_merges_where_rows_are_read(spark, small):
    assert re.search(r"partial_min", plan(spark, small, "keep_last"))


@pytest.mark.parametrize("name", ["sentence_split", "neighbor_context", "chunk_pack", "hard_wrap", "line_clean", "token_window", "numeric_hits"])
def test_what_lies_in_one_row_is_not_shuffled(spark, small, name):
    assert "Exchange" not in plan(spark, small, name)
