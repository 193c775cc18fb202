"""Root-cause analysis of all given incidents in one pass over the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.operators.actions import suggest_actions
from cellwarden.operators.analysis import CONDITIONS, SEVERITY_RULES, Condition, SeverityRule, analyze_incidents, classify_severity
from cellwarden.operators.documents import retrieve_docs, retrieve_pages
from cellwarden.operators.embedding import embed_texts
from cellwarden.operators.report import (
    GENERAL_INFO,
    TRACE_STATISTICS,
    append_section,
    build_report,
    general_info,
)
from cellwarden.operators.rules import collect_rules
from cellwarden.operators.similarity import (
    CUTOFF,
    LIKELY,
    TOP_K,
    distance_cutoff,
    format_prior_incidents,
    match_label,
    vector_topk,
    with_incident_columns,
)
from cellwarden.operators.text_index import TextIndex
from cellwarden.operators.traces import cell_trace_stats, trace_summary
from cellwarden.operators.uplink import config_deviation, rssi_levels, rssi_out_of_range, uplink_configuration
from cellwarden.session import cut_lineage

#: Numbers of a case that conditions and severity rules judge.
METRICS = ("uplink_rssi", "security_failure_pct", "pZeroNominalPucch_deviation", "pZeroNominalPusch_deviation")


def _with_tool(value: str, tool: str, tools_col: str) -> Column:
    return F.when(F.array_contains(tools_col, tool), F.col(value))


def measured_cases(
    incidents: DataFrame,
    rules: DataFrame,
    traces: DataFrame,
    performance: DataFrame,
    cell_config: DataFrame,
) -> DataFrame:
    """One row per incident with its rules, event log and every metric the conditions use.

    All parts are keyed by incident_id, so their aggregates meet without moving the large
    tables again. Configuration is compared only where the uplink level is out of range.
    """
    summary = trace_summary(cell_trace_stats(incidents, traces))
    levels = rssi_levels(incidents, performance)
    cases = (
        incidents.select(
            "incident_id", "start_ts", "end_ts", "description", "kpi_missed", "enodeb_id", "cell_id"
        )
        .join(collect_rules(incidents, rules), "incident_id", "left")
        .join(levels, "incident_id", "left")
        .join(summary, "incident_id", "left")
    )
    cases = uplink_configuration(cases, cell_config)
    cases = config_deviation(
        cases.withColumn("rssi_out_of_range", rssi_out_of_range(F.col("uplink_rssi")))
    )
    for name in ("pZeroNominalPucch", "pZeroNominalPusch"):
        cases = cases.withColumn(
            f"{name}_deviation", F.when(F.col("rssi_out_of_range"), F.col(f"{name}_deviation"))
        )
    cases = append_section(
        cases, GENERAL_INFO, general_info(F.col("kpi_missed"), F.col("start_ts"), F.col("end_ts"))
    )
    uses_traces = F.array_contains("processing_rule_tools", "get_cell_trace_statistics")
    outcomes = F.coalesce("trace_statistics", F.lit(""))
    return append_section(cases, TRACE_STATISTICS, outcomes, where=uses_traces)


def analysed_cases(
    measured: DataFrame, conditions: Sequence[Condition] = CONDITIONS, severity_rules: Sequence[SeverityRule] = SEVERITY_RULES
) -> DataFrame:
    """Findings, actions and severity: one projection over the measured cases."""
    cases = suggest_actions(analyze_incidents(measured, conditions))
    # Severity may use the uplink level only if the incident's severity rules ask for it.
    level = _with_tool("uplink_rssi", "get_uplink_rssi_level", "severity_determination_rule_tools")
    graded = classify_severity(
        cases.withColumn("_level", F.col("uplink_rssi")).withColumn("uplink_rssi", level), severity_rules
    )
    return graded.withColumn("uplink_rssi", F.col("_level")).drop("_level")


def prior_incidents(
    cases: DataFrame,
    known: DataFrame,
    *,
    k: int = TOP_K,
    cutoff: float = CUTOFF,
    likely: float = LIKELY,
    exclude_self: bool = False,
) -> DataFrame:
    """Formatted similar incidents per case; ``cases`` carry events_embeddings."""
    near = distance_cutoff(vector_topk(known, cases, k, exclude_self=exclude_self, cutoff=cutoff), cutoff)
    columns = ["events", "final_analysis", "cause", "resolution"]
    full = with_incident_columns(match_label(near, likely), known, columns)
    return format_prior_incidents(full, cases)


def analyse_incidents(
    incidents: DataFrame,
    rules: DataFrame,
    traces: DataFrame,
    performance: DataFrame,
    cell_config: DataFrame,
    known: DataFrame | None,
    documents: DataFrame,
    pages: DataFrame,
    allow: DataFrame,
    *,
    dim: int = 64,
    k: int = TOP_K,
    cutoff: float = CUTOFF,
    likely: float = LIKELY,
    exclude_self: bool = False,
    digits: int | None = None,
    conditions: Sequence[Condition] = CONDITIONS,
    severity_rules: Sequence[SeverityRule] = SEVERITY_RULES,
    index: TextIndex | None = None,
) -> DataFrame:
    """Complete cases with report, severity, event log and embedding, ready for the update.

    Without ``known`` the incidents are compared with each other (``exclude_self`` leaves out their own rows). ``digits``
    rounds the metrics before they are judged and written down; ``index`` is a written index of ``documents``. The measured and embedded cases are written once to the checkpoint folder: search, report
    and update all read them.
    """
    incidents = cut_lineage(incidents)
    measured = measured_cases(incidents, rules, traces, performance, cell_config)
    if digits is not None:
        measured = measured.withColumns({c: F.round(c, digits) for c in METRICS})
    cases = analysed_cases(measured, conditions, severity_rules)
    cases = cut_lineage(embed_texts(cases, "events", dim, "events_embeddings"))
    if known is None:
        unknown = F.lit(None).cast("string")
        known = cases.withColumns({c: unknown for c in ("final_analysis", "cause", "resolution")})
    similar = prior_incidents(cases, known, k=k, cutoff=cutoff, likely=likely, exclude_self=exclude_self)
    internal = retrieve_docs(cases, documents, index=index)
    external = retrieve_pages(cases, pages, allow)

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("incident_id", F.struct("search_result", "references").alias(name))

    full = (
        cases.join(similar.select("incident_id", "prior_incidents"), "incident_id", "left")
        .join(packed(internal, "internal_search_results"), "incident_id", "left")
        .join(packed(external, "external_search_results"), "incident_id", "left")
    )
    return build_report(full).withColumn("severity", F.col("severity_level"))
