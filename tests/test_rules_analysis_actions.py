import pytest
from pyspark.sql import functions as F

from cellwarden.operators import actions, analysis, rules, uplink
from tests.conftest import rows

RULE = (
    "rule_id string, kpi_missed array<string>, processing_rule string, processing_rule_tools array<string>, "
    "severity_determination_rule string, severity_determination_rule_tools array<string>, is_current boolean"
)
INCIDENT = "incident_id string, kpi_missed array<struct<kpi:string,value:double>>"


def rule_table(spark):
    return spark.createDataFrame(
        [
            ("r1", ["a"], "p1", ["t2", "t1"], "s1", [], True),
            ("r2", ["a", "b", "a"], "p2", ["t1"], "s2", ["t3"], False),
            ("r3", ["z"], "p3", ["t9"], "s3", ["t9"], True),
            ("r4", [], "p4", [], "s4", [], True),
        ],
        RULE,
    )


def incident_table(spark):
    return spark.createDataFrame(
        [("one", [("a", 1.0)]), ("two", [("b", 1.0), ("a", 1.0)]), ("none", [("q", 1.0)]), ("empty", [])], INCIDENT
    )


@pytest.mark.parametrize("bound", [1000, 0])
def test_rules_sharing_any_kpi_match_once(spark, bound):
    found = rules.match_rules(incident_table(spark), rule_table(spark), max_broadcast_rows=bound, salts=3)
    assert rows(found, "incident_id", "rule_id") == [("one", "r1"), ("one", "r2"), ("two", "r1"), ("two", "r2")]
    current = rules.match_rules(incident_table(spark), rule_table(spark), current_only=True)
    assert rows(current, "incident_id", "rule_id") == [("one", "r1"), ("two", "r1")]


@pytest.mark.parametrize("bound", [1000, 0])
def test_collected_rules(spark, bound):
    found = {r.incident_id: r for r in rules.collect_rules(
        incident_table(spark), rule_table(spark), max_broadcast_rows=bound, salts=2).collect()}
    assert set(found) == {"one", "two", "none", "empty"}
    assert found["two"].processing_rules == ["p1", "p2"]
    assert found["two"].processing_rule_tools == ["t1", "t2"]
    assert found["two"].severity_determination_rule_tools == ["t3"]
    for name in ("none", "empty"):
        assert found[name].processing_rules == [] and found[name].processing_rule_tools == []
        assert found[name].rules_status == rules.NO_RULES


def test_rules_are_collected_once_per_set_of_kpis(spark):
    incidents = incident_table(spark).union(spark.createDataFrame([("again", [("a", 9.0), ("b", 2.0)]), ("null", None)], INCIDENT))
    found = {r.incident_id: r for r in rules.collect_rules(incidents, rule_table(spark)).collect()}
    assert found["again"][1:] == found["two"][1:] and found["null"].rules_status == rules.NO_RULES
    assert [(m.rule_id, m.kpis, m.tools) for m in found["two"].matched_rules] == [("r1", ["a"], ["t2", "t1"]), ("r2", ["a", "b"], ["t1"])]
    assert found["none"].matched_rules == []
    plan = rules.collect_rules(incidents, rule_table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # texts come from the written table of sets


def test_gate_keeps_registered_tools_only(spark):
    df = spark.createDataFrame([(["open_ticket", "get_uplink_rssi_level", "get_cell_trace_statistics"],), ([],)], "t array<string>")
    found = [r[0] for r in df.select(rules.gate_tools(F.col("t"))).collect()]
    assert found == [["get_cell_trace_statistics", "get_uplink_rssi_level"], []]


def severity(spark, kpis, rssi):
    df = spark.createDataFrame([(kpis, rssi)], "kpi_missed array<struct<kpi:string,value:double>>, uplink_rssi double")
    return analysis.classify_severity(df).first()


@pytest.mark.parametrize(
    "kpis, rssi, level",
    [
        ([("erab_success_rate", 94.9)], None, "HIGH"),
        ([("erab_success_rate", 95.0)], None, "LOW"),
        ([("retainability", 3.6)], None, "HIGH"),
        ([("retainability", 3.5)], None, "LOW"),
        ([("retainability", 3.2)], -121.0, "MEDIUM"),
        ([("retainability", 3.2)], -104.0, "HIGH"),
        ([("retainability", 3.2)], -100.0, "HIGH"),
        ([("retainability", 3.2)], -115.0, "LOW"),
        ([("erab_success_rate", 96.0)], -121.0, "LOW"),
        ([("erab_success_rate", 96.0), ("retainability", 3.2)], -121.0, "MEDIUM"),
        ([], None, "LOW"),
    ],
)
def test_severity_levels(spark, kpis, rssi, level):
    found = severity(spark, kpis, rssi)
    assert found.severity_level == level and found.severity_level_explanation


def test_configuration_check_of_the_rule_document(spark):
    df = spark.createDataFrame([(-110.0, -94.0), (None, None)], "pZeroNominalPucch double, pZeroNominalPusch double")
    first, empty = uplink.config_deviation(df).collect()
    assert first.pZeroNominalPucch_deviation == pytest.approx(0.0351, abs=1e-4) and not first.pZeroNominalPucch_off
    assert first.pZeroNominalPusch_deviation == pytest.approx(0.06) and first.pZeroNominalPusch_off
    assert empty.pZeroNominalPucch_off is None
    levels = spark.createDataFrame([(-100.0,), (-114.0,), (-120.0,), (-120.5,), (None,)], "r double")
    assert [r[0] for r in levels.select(uplink.rssi_out_of_range(F.col("r"))).collect()] == [True, False, False, True, None]


CASE = (
    "incident_id string, enodeb_id string, cell_id string, kpi_missed array<struct<kpi:string,value:double>>, "
    "processing_rule_tools array<string>, security_failure_pct double, uplink_rssi double, "
    "pZeroNominalPucch_deviation double, pZeroNominalPusch_deviation double, rssi_out_of_range boolean, "
    "pZeroNominalPucch_off boolean, pZeroNominalPusch_off boolean"
)
TOOLS = list(rules.ANALYSES)


def cases(spark):
    drop = [("retainability", 4.0)]
    return spark.createDataFrame(
        [
            ("act", "e", "c", drop, TOOLS, 80.0, -100.0, 0.0351, 0.06, True, False, True),
            ("inside", "e", "c", drop, TOOLS, 80.0, -116.0, None, None, False, False, True),
            ("gated", "e", "c", drop, [], 80.0, -100.0, 0.0351, 0.06, True, False, True),
            ("success", "e", "c", [("erab_success_rate", 90.0)], TOOLS, 80.0, -100.0, 0.0351, 0.06, True, False, True),
            ("unknown", "e", "c", drop, TOOLS, None, None, None, None, None, None, None),
        ],
        CASE,
    )


def test_findings_follow_conditions_and_gates(spark):
    found = {r.incident_id: r for r in analysis.analyze_incidents(cases(spark)).collect()}
    assert [f.metric for f in found["act"].findings] == ["uplink_rssi", "pZeroNominalPusch_deviation"]
    assert found["act"].analysis.splitlines()[0] == "uplink RSSI outside the normal range (uplink_rssi = -100.0)"
    assert [f.cause for f in found["success"].findings] == ["failed security setup"]
    for name in ("inside", "gated", "unknown"):
        assert found[name].findings == [] and found[name].analysis == analysis.NO_FINDINGS


def test_findings_name_the_matched_rules_that_ask_for_them(spark):
    def matched(*found):
        return F.array(*[
            F.struct(F.lit(i).alias("rule_id"), F.array(F.lit(k)).alias("kpis"), F.array(F.lit(t)).alias("tools")) for i, k, t in found
        ])

    drops = [("r1", "retainability", "get_uplink_rssi_level"), ("r2", "retainability", "get_uplink_rssi_level"),
             ("r3", "erab_success_rate", "get_uplink_configuration")]
    found = {r.incident_id: r for r in analysis.analyze_incidents(cases(spark).withColumn("matched_rules", matched(*drops))).collect()}
    # The tool for the configuration is among the incident's tools, but no rule of its KPI asks for it.
    assert [(f.metric, f.rules) for f in found["act"].findings] == [("uplink_rssi", ["r1", "r2"])]
    assert found["success"].findings == []


def test_actions_append_and_split(spark):
    suggested = actions.suggest_actions(cases(spark))
    found = {r.incident_id: r.actions for r in suggested.collect()}
    assert {k for k, v in found.items() if v} == {"act"}
    action = found["act"][0]
    assert action.tool_name == actions.ADJUST and action.status == "SUGGESTED"
    assert action.parameters == {"enodeb_id": "e", "cell_id": "c"}
    twice = actions.suggest_actions(suggested)
    assert {r.incident_id: len(r.actions) for r in twice.collect()}["act"] == 2
    listed = rows(actions.split_actions(suggested), "incident_id", "listing", "message")
    assert ("act", "suggested", None) in listed and ("gated", "none", actions.NO_ACTIONS) in listed
    assert len(listed) == 5
    tools = {r.incident_id: r.action_tools for r in actions.actions_toolset(suggested).collect()}
    assert tools["act"] == [actions.ADJUST] and tools["inside"] == []
    approved = spark.createDataFrame([("act", actions.ADJUST), ("gated", actions.ADJUST)], "incident_id string, tool_name string")
    issued = actions.issue_adjustments(suggested, approved).collect()
    assert [(r.incident_id, r.enodeb_id, r.details) for r in issued] == [("act", "e", actions.ADJUSTMENT_ISSUED)]
    assert actions.split_actions(cases(spark)).where("listing = 'none'").count() == 5
