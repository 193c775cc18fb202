from datetime import timedelta

from pyspark.sql import functions as F

from cellwarden.operators import report
from tests.conftest import rows, ts

START = ts("2025-01-01 10:00:00")


def test_sections_append_with_blank_line(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "**A**\nx")], "id int, events string")
    grown = report.append_section(df, "B", F.lit("y"))
    assert rows(grown) == [(1, "**B**\ny"), (2, "**B**\ny"), (3, "**A**\nx\n\n**B**\ny")]
    kept = report.append_section(df, "B", F.lit("y"), where=F.col("id") == 3)
    assert rows(kept) == [(1, ""), (2, ""), (3, "**A**\nx\n\n**B**\ny")]


def test_general_info_and_open_incident(spark):
    df = spark.createDataFrame(
        [
            (1, [("a", 1.5), ("b", 2.0)], START, START + timedelta(minutes=15)),
            (2, [("a", 1.5)], START, None),
            (3, [], START, START + timedelta(milliseconds=1500)),
        ],
        "id int, kpi_missed array<struct<kpi:string,value:double>>, s timestamp, e timestamp",
    )
    text = report.general_info(F.col("kpi_missed"), F.col("s"), F.col("e"))
    assert rows(df.select("id", text)) == [
        (1, "Missed KPIs: a (value=1.5), b (value=2.0). Duration: 900.0 seconds."),
        (2, "Missed KPIs: a (value=1.5)."),
        (3, "Missed KPIs: . Duration: 1.5 seconds."),
    ]


def test_trace_section_states_missing_traces(spark):
    incidents = spark.createDataFrame([("i",), ("j",)], "incident_id string")
    stats = spark.createDataFrame([("i", "SUCCESS", 3), ("i", "OTHER", 1)], "incident_id string, connection_outcome string, n long")
    assert rows(report.trace_section(incidents, stats)) == [
        ("i", "OTHER: 1, SUCCESS: 3", "Success"), ("j", "", report.NO_TRACES)
    ]


def test_report_has_all_sections_even_when_empty(spark):
    result = "struct<search_result:string,references:array<struct<url:string,title:string>>>"
    df = spark.createDataFrame(
        [
            (1, "d", [("a", 1.0)], START, START, "cause", "HIGH", "why", ["p1", "p2"], ("found", [("u", "t")]),
             [("tool", "because", None, "SUGGESTED")]),
            (2, "d", [], START, None, None, None, None, [], None, []),
        ],
        "id int, description string, kpi_missed array<struct<kpi:string,value:double>>, start_ts timestamp, end_ts timestamp, "
        "analysis string, severity_level string, severity_level_explanation string, prior_incidents array<string>, "
        f"internal_search_results {result}, actions array<struct<tool_name:string,reason_to_perform:string,"
        "parameters:map<string,string>,status:string>>",
    )
    found = {r.id: r.report for r in report.build_report(df).collect()}
    for text in found.values():
        for i, title in enumerate(report.REPORT_SECTIONS, start=1):
            assert f"## {i}. {title}\n" in text
    assert "## 8. References\n- [t](u)" in found[1] and "p1\np2" in found[1]
    assert "tool (SUGGESTED): because" in found[1] and "HIGH. why" in found[1]
    assert found[2].count(report.NOTHING) == 7
