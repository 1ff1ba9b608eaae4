"""Registered queries of the corpus operators against their SQL."""

from collections import Counter

import duckdb
import pytest

from lurelens.llm.queries import ORACLES, QUERIES
from workload.registry import TABLES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    rows = connection.execute(ORACLES[name])
    names = [column[0] for column in rows.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(row[n] for n in names) for row in got.collect()) == Counter(rows.fetchall())


def test_every_operator_has_one_query():
    numbers = [name.split("_")[0] for name in QUERIES if name.startswith("op")]
    assert sorted(numbers, key=lambda x: int(x[2:])) == [f"op{n}" for n in range(1, 14)]
    assert "pipeline" in QUERIES
