"""Cell-trace statistics per incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwarden.functions.columns import or_default
from cellwarden.operators.windows import facts_in_windows

CELL_KEYS = (("enodeb_id", "start_enodeb_id"), ("cell_id", "start_cell_id"))
# Outcome column and the name for a missing outcome.
OUTCOME = "s1_sig_conn_setup_sig_conn_result"
OTHER = "OTHER"
SECURITY = "SECURITY"


def traces_of_incidents(incidents: DataFrame, traces: DataFrame, columns=(), **options) -> DataFrame:
    """(incident_id, connection_outcome, columns...) for every trace inside an incident window."""
    times = ["start_enodeb_id", "start_cell_id", "starttime", "endtime", OUTCOME]
    day = [c for c in ("date",) if c in traces.columns]
    narrow = traces.select(*times, *columns, *day)
    joined = facts_in_windows(incidents, narrow, CELL_KEYS, "starttime", "endtime", **options)
    return joined.select(
        "incident_id", or_default(F.col(OUTCOME), OTHER).alias("connection_outcome"), *columns
    )


def cell_trace_stats(incidents: DataFrame, traces: DataFrame, **options) -> DataFrame:
    """Number of traces per incident and connection outcome."""
    return (
        traces_of_incidents(incidents, traces, **options)
        .groupBy("incident_id", "connection_outcome")
        .agg(F.count("*").alias("n"))
    )


def outcome_share(stats: DataFrame, pattern: str = SECURITY) -> DataFrame:
    """Percent of each outcome in its incident, and of all outcomes matching ``pattern``."""
    whole = Window.partitionBy("incident_id")
    total = F.sum("n").over(whole)
    matching = F.sum(F.when(F.col("connection_outcome").rlike(pattern), F.col("n")).otherwise(0))
    return stats.select(
        "incident_id",
        "connection_outcome",
        "n",
        (F.col("n") * 100.0 / total).alias("pct"),
        (matching.over(whole) * 100.0 / total).alias("security_failure_pct"),
    )


def trace_summary(stats: DataFrame, pattern: str = SECURITY) -> DataFrame:
    """One row per incident that has traces: their number, the percent of outcomes matching
    ``pattern``, and the text ``OUTCOME: n, ...`` in order of name.

    The list has one entry per distinct outcome of the incident, already counted.
    """
    matching = F.sum(F.when(F.col("connection_outcome").rlike(pattern), F.col("n")).otherwise(0))
    line = F.concat(F.col("connection_outcome"), F.lit(": "), F.col("n").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("connection_outcome", line.alias("line"))))
    return stats.groupBy("incident_id").agg(
        F.sum("n").alias("traces"),
        (matching * 100.0 / F.sum("n")).alias("security_failure_pct"),
        F.array_join(F.transform(lines, lambda x: x["line"]), ", ").alias("trace_statistics"),
    )


def failing_devices(
    incidents: DataFrame, traces: DataFrame, pattern: str = SECURITY, k: int = 10, **options
) -> DataFrame:
    """The ``k`` devices with most outcomes matching ``pattern`` in each incident."""
    failures = (
        traces_of_incidents(incidents, traces, ("imsi", "imeisv"), **options)
        .where(F.col("connection_outcome").rlike(pattern))
        .groupBy("incident_id", "imsi", "imeisv")
        .agg(F.count("*").alias("failures"))
    )
    order = Window.partitionBy("incident_id").orderBy(F.col("failures").desc(), "imsi", "imeisv")
    return (
        failures.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
    )
