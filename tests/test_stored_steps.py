"""Steps that several others read are worked out once."""

import pytest

import workload
from workload.registry import Inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    lines = [(1, 1, 1, 1, "A"), (1, 2, 1, 2, "N"), (1, 3, 2, 2, "R"), (2, 1, 1, 1, "N"), (2, 1, 1, 1, "N"), (None, 4, 1, 1, "A")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    pages = [(1, "https://a.com/", "<p>x</p>"), (2, "https://b.com/", "<p>x</p>"), (3, "https://c.com/", None)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_case_graphs_are_derived_once(spark, folder):
    t = Inputs(spark, folder)
    edges, pages = t.case_transitions, t.case_pages
    assert "lineitem" not in plan(edges) and "lineitem" not in plan(pages) and "lineitem" not in plan(t.case_states)
    assert sorted((r.target_id, r.from_state, r.to_state, r.kind) for r in edges.collect()) == [("1", "1A", "1N", "click"), ("1", "1N", "1R", "js_location")]
    assert sorted((str(r.target_id), str(r.state_id), str(r.dom_hash)) for r in t.case_states.collect()) == [
        ("1", "1A", "A"), ("1", "1N", "N"), ("1", "1R", "A"), ("2", "2N", "N"), ("None", "None", "A")]


def test_pages_are_parsed_once(spark, folder):
    states = workload.QUERIES["page_state_hashes"](spark, folder)
    assert "ArrowEvalPython" not in plan(states)
    assert {(r.page_id, r.capture): (r.state, r.captures) for r in states.collect() if r.page_id == 2}[(2, "first")] == (1, 6)
