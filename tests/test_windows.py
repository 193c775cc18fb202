import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cellwarden.operators import sweep, traces, uplink
from cellwarden.operators.windows import facts_in_windows
from cellwarden.sources import layout
from cellwarden.session import scratch_path
from tests.conftest import rows, ts

KEYS = (("enodeb_id", "start_enodeb_id"), ("cell_id", "start_cell_id"))
INCIDENT = "incident_id string, enodeb_id string, cell_id string, start_ts timestamp, end_ts timestamp"
TRACE = (
    "start_enodeb_id string, start_cell_id string, starttime timestamp, endtime timestamp, "
    "s1_sig_conn_setup_sig_conn_result string, imsi string, imeisv string"
)


def when(rng, days=12):
    return datetime(2025, 3, 1) + timedelta(minutes=rng.randrange(days * 24 * 60))


def random_case(seed, open_windows):
    rng = random.Random(seed)
    windows, facts = [], []
    for i in range(40):
        start = when(rng)
        end = start + timedelta(minutes=rng.choice([0, 30, 60 * 30, 60 * 24 * 5, -10]))
        if open_windows and i % 6 == 0:
            end = None
        windows.append((f"i{i}", "e", f"c{rng.randrange(3)}", start, end))
    for i in range(600):
        cell = "c0" if rng.random() < 0.5 else f"c{rng.randrange(4)}"
        start = when(rng)
        end = start + timedelta(minutes=rng.choice([0, 1, 600, -500, -6000]))
        facts.append(("e", cell, start, None if i % 50 == 0 else end, rng.choice(["OK", "", None, "SECURITY_FAILURE"]),
                      f"imsi{i % 9}", f"sv{i % 2}"))
    return windows, facts


def brute(windows, facts):
    return sorted(
        (w[0], f[2])
        for w in windows
        for f in facts
        if w[1] == f[0] and w[2] == f[1] and f[2] >= w[3] and (w[4] is None or (f[3] is not None and f[3] <= w[4]))
    )


@pytest.mark.parametrize("open_windows", [False, True])
@pytest.mark.parametrize("bound", [1000, 0])
def test_windows_match_brute_force(spark, open_windows, bound):
    windows, facts = random_case(5, open_windows)
    found = facts_in_windows(
        spark.createDataFrame(windows, INCIDENT), spark.createDataFrame(facts, TRACE), KEYS, "starttime", "endtime",
        max_broadcast_rows=bound, salts=3,
    )
    assert sorted(tuple(r) for r in found.select("incident_id", "starttime").collect()) == brute(windows, facts)


def test_sweep_cuts_hot_cells_and_repeats_only_windows_over_a_cut(spark):
    """Half of the facts are in one cell: it is cut by time, and every pair is still found once."""
    windows, facts = random_case(9, True)
    facts = [f for f in facts if f[3] is None or f[3] >= f[2]]
    made = spark.createDataFrame(facts, TRACE)
    counts = sweep.count_by_hour(made, ["start_enodeb_id", "start_cell_id"], "starttime", "endtime")
    cuts = {r["start_cell_id"]: r["_cuts"] for r in sweep.hot_cuts(counts, ["start_enodeb_id", "start_cell_id"], 8).collect()}
    assert "c0" in cuts and len(cuts["c0"]) >= 3 and cuts["c0"] == sorted(cuts["c0"])
    found = facts_in_windows(spark.createDataFrame(windows, INCIDENT), made, KEYS, "starttime", "endtime", max_broadcast_rows=0)
    assert sorted(tuple(r) for r in found.select("incident_id", "starttime").collect()) == brute(windows, facts)


def test_sweep_over_small_batches_and_equal_times(spark):
    """Cells that go on from batch to batch, windows and facts at the same moment, repeated rows."""
    start = datetime(2025, 3, 1)
    windows = [(f"i{i}", "e", f"c{i % 2}", start + timedelta(hours=i // 4), start + timedelta(hours=i // 4 + i % 3)) for i in range(40)]
    facts = [("e", f"c{i % 3}", start + timedelta(hours=i // 9), start + timedelta(hours=i // 9 + i % 2), "OK", "m", "s") for i in range(90)] * 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = facts_in_windows(
            spark.createDataFrame(windows, INCIDENT), spark.createDataFrame(facts, TRACE), KEYS, "starttime", "endtime", max_broadcast_rows=0
        )
        assert sorted(tuple(r) for r in found.select("incident_id", "starttime").collect()) == brute(windows, facts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    none = facts_in_windows(spark.createDataFrame([], INCIDENT), spark.createDataFrame([], TRACE), KEYS, "starttime", "endtime", max_broadcast_rows=0)
    assert none.count() == 0


def test_sweep_reads_the_facts_once_between_both_days(spark):
    windows, facts = random_case(3, False)
    path = scratch_path(spark, "days")
    layout.write_partitioned(spark.createDataFrame(facts, TRACE), "starttime", ["start_enodeb_id", "start_cell_id"], path)
    some = [w for w in windows if w[4] is not None and w[3].day in (4, 5)]
    found = facts_in_windows(
        spark.createDataFrame(some, INCIDENT), spark.read.parquet(path), KEYS, "starttime", "endtime", max_broadcast_rows=0, ordered=True
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "days-" in line]
    assert len(scans) == 1 and "date" in scans[0]
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", scans[0])[1]
    assert ">=" in filters and "<=" in filters
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_broadcast_plan_does_not_move_the_facts(spark):
    windows, facts = random_case(1, False)
    path = scratch_path(spark, "facts")
    spark.createDataFrame(facts, TRACE).write.parquet(path)
    found = facts_in_windows(
        spark.createDataFrame(windows, INCIDENT), spark.read.parquet(path), KEYS, "starttime", "endtime"
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert "GreaterThanOrEqual(starttime" in plan


def test_day_partitions_are_pruned(spark):
    windows = [("i", "e", "c0", ts("2025-03-03 10:00:00"), ts("2025-03-04 10:00:00"))]
    _, facts = random_case(2, False)
    path = scratch_path(spark, "daily")
    frame = spark.createDataFrame(facts, TRACE)
    layout.write_partitioned(frame, "starttime", ["start_enodeb_id", "start_cell_id"], path)
    stored = spark.read.parquet(path)
    assert stored.count() == len(facts)
    incidents = spark.createDataFrame(windows, INCIDENT)
    found = facts_in_windows(incidents, stored, KEYS, "starttime", "endtime")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert sorted(tuple(r) for r in found.select("incident_id", "starttime").collect()) == brute(windows, facts)


def test_no_incidents_give_no_facts(spark):
    _, facts = random_case(2, False)
    found = facts_in_windows(
        spark.createDataFrame([], INCIDENT), spark.createDataFrame(facts, TRACE), KEYS, "starttime", "endtime"
    )
    assert found.count() == 0


def test_statistics_merge_null_and_blank_and_lead_widens(spark):
    start = ts("2025-01-01 10:00:00")
    incidents = spark.createDataFrame([("i", "e", "c", start, start + timedelta(hours=1))], INCIDENT)
    minute = timedelta(minutes=1)
    facts = [
        ("e", "c", start, start + minute, None, "a", "s"),
        ("e", "c", start + minute, start + 2 * minute, "", "a", "s"),
        ("e", "c", start + minute, start + 2 * minute, "SECURITY_FAILURE", "b", "s"),
        ("e", "c", start + minute, start + 2 * minute, "SECURITY_FAILURE", "b", "s"),
        ("e", "c", start - 5 * minute, start, "EARLY", "a", "s"),
        ("e", "other", start, start + minute, "SUCCESS", "a", "s"),
    ]
    frame = spark.createDataFrame(facts, TRACE)
    stats = traces.cell_trace_stats(incidents, frame)
    assert rows(stats) == [("i", "OTHER", 2), ("i", "SECURITY_FAILURE", 2)]
    wider = traces.cell_trace_stats(incidents, frame, lead="15 minutes")
    assert ("i", "EARLY", 1) in rows(wider)
    shares = traces.outcome_share(stats).agg(F.sum("pct"), F.max("security_failure_pct")).first()
    assert shares[0] == pytest.approx(100.0) and shares[1] == pytest.approx(50.0)
    assert rows(traces.failing_devices(incidents, frame, k=1)) == [("i", "b", "s", 2, 1)]
    summary = traces.trace_summary(stats).first()
    assert summary.trace_statistics == "OTHER: 2, SECURITY_FAILURE: 2" and summary.traces == 4


@pytest.mark.parametrize("bound", [1000, 0])
def test_uplink_level_keeps_cells_without_data(spark, bound):
    start = ts("2025-01-01 10:00:00")
    end = start + timedelta(hours=1)
    incidents = spark.createDataFrame([("i", "e", "c", start, end), ("j", "e", "none", start, end)], INCIDENT)
    data = [("e", "c", start, -100), ("e", "c", end, -110), ("e", "c", end + timedelta(seconds=1), 0), ("e", "c", start, None)]
    levels = spark.createDataFrame(data, "enodeb_id string, cell_id string, measurement_end timestamp, UL_RSSI long")
    found = uplink.uplink_rssi(incidents, levels, max_broadcast_rows=bound, salts=2)
    assert rows(found, "incident_id", "uplink_rssi") == [("i", -105.0), ("j", None)]
