"""Every registered query against its SQL, and what its plan must not contain."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_file
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    found = df.collect()
    if name not in ORACLES:
        assert found
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, found) == table(columns, result.fetchall())


def test_entry_runs(spark):
    assert entry_file.entry(spark).count() > 0
    assert QUERIES.items() <= entry_file.queries().items() and ORACLES.items() <= entry_file.oracle_sql().items()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_lsh_finds_most_exact_neighbours(spark):
    exact = QUERIES["match_label"](spark, SF).select("query_id", "base_id")
    near = QUERIES["vector_topk_lsh"](spark, SF).select("query_id", "base_id")
    assert exact.intersect(near).count() > 0.9 * exact.count()


def test_scans_read_only_what_is_needed(spark):
    def plan(name):
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    rate = plan("erab_success_rate")
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in rate
    assert "BroadcastHashJoin" in plan("missed_kpis") and "BroadcastHashJoin" in plan("cell_trace_stats")
