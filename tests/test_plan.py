"""The whole analysis, from counters to the updated incident table."""

from datetime import timedelta

from pyspark.sql import functions as F

from cellwarden.operators import incidents
from cellwarden.plans import detect, rca
from cellwarden.schemas import CELL_TRACES, ERAB_ATTEMPTS, ERAB_RELEASES, ERAB_SUCCESSES, PERFORMANCE
from cellwarden.session import scratch_path
from cellwarden.sources import snapshots
from tests.conftest import rows, ts

T0 = ts("2025-01-01 00:15:00")


def performance(spark):
    def row(cell, step, att, succ, rel, time, rssi):
        values = {f.name: 0 for f in PERFORMANCE.fields}
        values.update({n: None for n in values if PERFORMANCE[n].dataType.typeName() == "string"})
        values.update(enodeb_id="e1", cell_id=cell, measurement_end=T0 + timedelta(minutes=15 * step))
        values.update({ERAB_ATTEMPTS[0]: att, ERAB_SUCCESSES[0]: succ, ERAB_RELEASES[0]: rel})
        values.update(ERAB_SessionTimeUE=time, UL_RSSI=rssi)
        return tuple(values[f.name] for f in PERFORMANCE.fields)

    data = []
    for step in range(6):
        data.append(row("low", step, 100, 90 if step in (1, 2, 4) else 99, 0, 3600, -116))
        data.append(row("drop", step, 100, 100, 4, 3600, -100))
        data.append(row("fine", step, 100, 99, 1, 3600, -116))
    return spark.createDataFrame(data, PERFORMANCE)


def traces(spark):
    def row(cell, minutes, outcome):
        values = {f.name: None for f in CELL_TRACES.fields}
        start = T0 + timedelta(minutes=minutes)
        values.update(start_enodeb_id="e1", start_cell_id=cell, starttime=start, endtime=start + timedelta(seconds=5))
        values["s1_sig_conn_setup_sig_conn_result"] = outcome
        return tuple(values[f.name] for f in CELL_TRACES.fields)

    outcomes = ["SECURITY_FAILURE"] * 3 + ["SUCCESS", None]
    return spark.createDataFrame([row("low", 20 + i, o) for i, o in enumerate(outcomes)], CELL_TRACES)


def rules(spark):
    return spark.createDataFrame(
        [
            ("rate", ["erab_success_rate"], "look at traces", ["get_cell_trace_statistics"], "grade", [], True),
            ("drops", ["retainability"], "look at uplink", ["get_uplink_rssi_level", "get_uplink_configuration",
             "initiate_uplink_configuration_adjustment"], "grade", ["get_uplink_rssi_level"], True),
        ],
        "rule_id string, kpi_missed array<string>, processing_rule string, processing_rule_tools array<string>, "
        "severity_determination_rule string, severity_determination_rule_tools array<string>, is_current boolean",
    )


def test_incidents_are_analysed_and_stored(spark):
    perf = performance(spark)
    found = detect.potential_incidents(perf)
    assert rows(found, "cell_id", "start_ts", "end_ts") == [
        ("drop", T0, T0 + timedelta(minutes=75)), ("low", T0 + timedelta(minutes=15), T0 + timedelta(minutes=60))
    ]
    root = scratch_path(spark, "incidents")
    snapshots.write_snapshot(detect.new_incidents(perf, found), root)
    current = snapshots.read_snapshot(spark, root)
    assert detect.new_incidents(perf, found, current).count() == 0

    config = spark.createDataFrame([("e1", "drop", -110.0, -94.0), ("e1", "low", -110.0, -94.0)],
                                   "enodeb_id string, cell_id string, pZeroNominalPucch double, pZeroNominalPusch double")
    docs = spark.createDataFrame([(1, "retainability drops", "Drops guide")], "doc_id long, text string, title string")
    pages = spark.createDataFrame([(1, "http://a/", "<title>Rates</title>erab success rate")], "page_id long, url string, html string")
    inputs = (rules(spark), traces(spark), perf, config)
    allow = pages.select("url")
    cases = rca.analyse_incidents(current, *inputs, current, docs, pages, allow)
    first = {r.cell_id: r for r in cases.collect()}
    low, drop = first["low"], first["drop"]
    assert low.analysis == "failed security setup (security_failure_pct = 60.0)" and low.severity == "HIGH"
    assert low.actions == [] and "OTHER: 1, SECURITY_FAILURE: 3, SUCCESS: 1" in low.events
    assert "pZeroNominalPusch differs" in drop.analysis and [a.status for a in drop.actions] == ["SUGGESTED"]
    assert "Cell traces statistics" not in drop.events and drop.events.startswith("**General info**\nMissed KPIs: retainability")
    assert "[Drops guide](documents/1)" in drop.report and "[Rates](http://a/)" in low.report
    assert low.prior_incidents == []

    updated, failed = incidents.update_incidents(current, cases)
    snapshots.write_snapshot(updated, root)
    stored = snapshots.read_snapshot(spark, root)
    assert failed.count() == 0 and stored.where("status = 'ANALYZED' and size(events_embeddings) = 64").count() == 2

    again = rca.analyse_incidents(stored, *inputs, stored, docs, pages, allow)
    similar = {r.cell_id: r.prior_incidents for r in again.collect()}
    assert len(similar["low"]) == 1 and f"*Incident {low.incident_id}*" in similar["low"][0]
    assert stored.select(F.size("events_embeddings")).distinct().count() == 1
