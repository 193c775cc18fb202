"""Event log sections and the incident report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.functions.columns import seconds_text
from cellwarden.functions.markdown import links, section
from cellwarden.operators.traces import trace_summary

# Section names and order.
GENERAL_INFO = "General info"
TRACE_STATISTICS = "Cell traces statistics"
REPORT_SECTIONS = (
    "Incident description",
    "Root cause analysis",
    "Severity level",
    "Similar prior incidents",
    "Internal documentation",
    "External documentation",
    "Recommendations",
    "References",
)
NOTHING = "No relevant information."
NO_TRACES = "No cell traces found"


def append_section(
    df: DataFrame, name: str, details: Column, log_col: str = "events", where: Column | None = None
) -> DataFrame:
    """Append ``**name**`` and the details to the log, after a blank line if it has text.

    Rows where ``where`` does not hold keep their log.
    """
    earlier = F.nullif(F.col(log_col), F.lit("")) if log_col in df.columns else F.lit(None).cast("string")
    added = section(name, details)
    if where is not None:
        added = F.when(where, added)
    return df.withColumn(log_col, F.concat_ws("\n\n", earlier, added))


def missed_kpi_text(kpi_missed: Column) -> Column:
    parts = F.transform(
        kpi_missed,
        lambda m: F.concat(m["kpi"], F.lit(" (value="), m["value"].cast("string"), F.lit(")")),
    )
    return F.array_join(parts, ", ")


def general_info(kpi_missed: Column, start: Column, end: Column) -> Column:
    """Missed KPIs and duration; an open incident has no duration."""
    duration = F.concat(F.lit(" Duration: "), seconds_text(start, end), F.lit(" seconds."))
    return F.concat(
        F.lit("Missed KPIs: "), missed_kpi_text(kpi_missed), F.lit("."), F.coalesce(duration, F.lit(""))
    )


def trace_section(incidents: DataFrame, stats: DataFrame) -> DataFrame:
    """Per incident the text of its trace outcomes and the status of the retrieval."""
    joined = incidents.select("incident_id").join(trace_summary(stats), "incident_id", "left")
    return joined.select(
        "incident_id",
        F.coalesce("trace_statistics", F.lit("")).alias("trace_statistics"),
        F.when(F.col("traces").isNull(), NO_TRACES).otherwise("Success").alias("trace_status"),
    )


def recommendations(actions: Column) -> Column:
    lines = F.transform(
        actions,
        lambda a: F.concat(a["tool_name"], F.lit(" ("), a["status"], F.lit("): "), a["reason_to_perform"]),
    )
    return F.array_join(lines, "\n")


def build_report(cases: DataFrame) -> DataFrame:
    """Add ``report``: eight sections per case, each present even when it has no content.

    Reads description, kpi_missed, start_ts, end_ts, analysis, severity_level,
    severity_level_explanation, prior_incidents, internal_search_results,
    external_search_results and actions; columns that are absent count as empty.
    """

    def text(name: str, value=None) -> Column:
        if name not in cases.columns:
            return F.lit(None).cast("string")
        return F.col(name) if value is None else value(F.col(name))

    def result(name: str) -> Column:
        return text(name, lambda c: c["search_result"])

    def references() -> Column:
        known = [
            F.coalesce(F.col(c)["references"], F.array().cast("array<struct<url:string,title:string>>"))
            for c in ("internal_search_results", "external_search_results")
            if c in cases.columns
        ]
        return links(F.concat(*known)) if known else F.lit(None).cast("string")

    body = (
        F.concat(
            F.col("description"), F.lit("\n"),
            general_info(F.col("kpi_missed"), F.col("start_ts"), F.col("end_ts")),
        ),
        text("analysis"),
        F.concat_ws(". ", text("severity_level"), text("severity_level_explanation")),
        text("prior_incidents", lambda c: F.array_join(c, "\n")),
        result("internal_search_results"),
        result("external_search_results"),
        text("actions", recommendations),
        references(),
    )
    parts = [
        F.concat(
            F.lit(f"## {i}. {title}\n"),
            F.coalesce(F.nullif(content, F.lit("")), F.lit(NOTHING)),
        )
        for i, (title, content) in enumerate(zip(REPORT_SECTIONS, body), start=1)
    ]
    return cases.withColumn("report", F.concat_ws("\n\n", *parts))
