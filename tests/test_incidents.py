from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from cellwarden.operators import incidents as inc
from cellwarden.schemas import INCIDENTS
from cellwarden.session import scratch_path
from cellwarden.sources import snapshots
from tests.conftest import rows, ts

NOW = ts("2025-01-01 10:00:00")
CANDIDATE = (
    "incident_id string, start_ts timestamp, end_ts timestamp, status string, description string, "
    "kpi_missed array<struct<kpi:string,value:double>>, enodeb_id string, cell_id string"
)


def candidates(spark, ids):
    return spark.createDataFrame(
        [(i, NOW, NOW + timedelta(hours=1), "NEW", "it's down", [("retainability", 4.0)], None, "c") for i in ids], CANDIDATE
    )


def keyed(spark, pairs):
    return spark.createDataFrame(pairs, "id string, v int")


def test_insert_keeps_existing_and_upsert_replaces(spark):
    old, new = keyed(spark, [("a", 1), ("b", 2)]), keyed(spark, [("b", 20), ("c", 30)])
    assert rows(inc.insert_new(old, new, "id")) == [("a", 1), ("b", 2), ("c", 30)]
    assert rows(inc.upsert(old, new, "id")) == [("a", 1), ("b", 20), ("c", 30)]
    assert rows(inc.upsert(inc.upsert(old, new, "id"), new, "id")) == rows(inc.upsert(old, new, "id"))


def test_lookup_statuses(spark):
    table = candidates(spark, ["a", "b", "b"])
    ids = spark.createDataFrame([("a",), ("b",), ("x",), ("a",)], "incident_id string")
    found = {r.incident_id: r for r in inc.get_incidents(table, ids).collect()}
    assert {k: r.lookup_status for k, r in found.items()} == {"a": "success", "b": "duplicate", "x": "not found"}
    assert found["a"].description == "it's down" and found["a"].enodeb_id is None
    assert found["b"].description is None and len(found) == 3


def test_create_only_approved_and_not_twice(spark):
    approved = spark.createDataFrame([("a",), ("b",), ("b",)], "incident_id string")
    created = inc.create_incidents(candidates(spark, ["a", "b", "c"]), approved, candidates(spark, ["b"]))
    assert [f.name for f in created.schema] == [f.name for f in INCIDENTS]
    row = created.collect()
    assert [r.incident_id for r in row] == ["a"]
    assert row[0].events_embeddings == [] and row[0].created_ts is not None and row[0].severity is None


def test_update_and_failed_cases(spark):
    table = inc.create_incidents(candidates(spark, "abcd"), candidates(spark, "abcd"))
    cases = spark.createDataFrame(
        [("a", "r", "HIGH", "ev", [1.0]), ("b", "r", "LOW", "ev", []), ("c", "r", "LOW", "ev", None)],
        "incident_id string, report string, severity string, events string, events_embeddings array<double>",
    )
    updated, failed = inc.update_incidents(table, cases)
    assert rows(updated, "incident_id", "status", "severity", "preliminary_analysis") == [
        ("a", "ANALYZED", "HIGH", "r"), ("b", "NEW", None, None), ("c", "NEW", None, None), ("d", "NEW", None, None)
    ]
    assert rows(failed, "incident_id", "status") == [("b", "error"), ("c", "error")]


def test_snapshots_switch_to_the_newest_complete_version(spark):
    root = scratch_path(spark, "table")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, root)
    snapshots.write_snapshot(keyed(spark, [("a", 1)]), root)
    current = snapshots.read_snapshot(spark, root)
    snapshots.write_snapshot(inc.upsert(current, keyed(spark, [("a", 2)]), "id"), root)
    assert rows(snapshots.read_snapshot(spark, root)) == [("a", 2)]
    # A folder without the success marker is an unfinished write and is not read.
    keyed(spark, [("z", 9)]).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/v=9")
    assert rows(snapshots.read_snapshot(spark, root)) == [("a", 2)]
