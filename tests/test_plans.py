"""Plan checks: no nested-loop joins, no row-wise Python, pruned scans."""

import re

import pytest

from tidemark.plans.catalog import all_queries

QUERIES = {n: q for n, q in all_queries().items() if not q.build.__module__.endswith("modelling")}
PYTHON_OK = {
    "dense_topk", "dense_topk_grid", "dense_topk_cells", "rrf_fusion", "compare_methods", "two_stage_rerank", "answer_prompt",
    "longest_alias", "geo_answer", "role_alias", "route_cascade",
}


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loops_or_row_python(tables, name):
    text = plan(QUERIES[name].build(tables)).split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in PYTHON_OK:
        assert "Pandas" not in text and "ArrowEvalPython" not in text


def test_filter_and_columns_reach_the_scan(tables):
    text = plan(QUERIES["predicate_string"].build(tables))
    assert "GreaterThan(c_acctbal,5000.0)" in text
    assert re.search(r"ReadSchema: struct<c_custkey:bigint,c_acctbal:double,c_mktsegment:string>", text)
    text = plan(QUERIES["value_counts"].build(tables))
    assert "ReadSchema: struct<event_type:string>" in text


def test_top_k_is_pruned_before_the_shuffle(tables):
    assert "WindowGroupLimit" in plan(QUERIES["format_list"].build(tables))


def test_rows_per_key_combine_before_the_shuffle(tables):
    assert "partial_min_by" in plan(QUERIES["dedup_keep_first"].build(tables))


def test_no_fold_stands_above_the_explosion_of_terms(spark):
    """Length and norm of a document are worked out once a row, not once a term."""
    from tidemark.functions.text import search_tokens
    from tidemark.operators import retrieval as rt

    docs = spark.createDataFrame([(1, "a b a")], "doc long, text string")
    rows = rt.document_terms(docs, "doc", "text", search_tokens)
    out = rows.selectExpr("doc", "dl", "norm", "explode(runs) as r").selectExpr("doc", "r.term", "r.tf", "dl", "norm")
    optimised = plan(out).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    above = optimised[: optimised.rindex("Generate explode", 0, optimised.rindex("Generate explode"))]
    assert "aggregate(" not in above


@pytest.mark.parametrize("name", ["assemble_context", "answer_prompt"])
def test_texts_do_not_move_to_meet_their_few_hits(spark, tables, name):
    """The hits are written before they meet the texts, so the planner knows that they are few."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        text = plan(QUERIES[name].build(tables)).split("== Physical Plan ==")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"BroadcastHashJoin \[doc_id", text)
