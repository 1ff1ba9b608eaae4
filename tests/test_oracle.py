"""Registered queries against their SQL. A quick selection by default, all of them with ``ALL_QUERIES=1``."""

import math
import os

import duckdb
import pandas as pd
import pytest

import workload
from workload.registry import TABLES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "refang_urls", "unwrap_steps", "canonical_urls", "registrable_domains", "urls_from_access_log", "page_text", "challenge_gates",
    "host_entropy", "dga_scores", "typosquat_matches", "dns_records", "sibling_domains", "misp_summary", "active_indicators",
    "redirect_summary", "cloaking", "deduped_states", "leaf_states", "evidence_flags", "model_answers", "listing_page", "latest_runs",
    "deleted_graphs", "har_requests", "override_matches", "streamed_repeat_suppression",
)
NAMES = sorted(workload.ORACLES) if os.environ.get("ALL_QUERIES") else QUICK


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 9) if isinstance(value, float) else value.item() if hasattr(value, "item") else value


def content(frame: pd.DataFrame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = content(workload.QUERIES[name](spark, FOLDER).toPandas())
    assert got == content(duck.execute(workload.ORACLES[name]).df())
    assert got[1]
