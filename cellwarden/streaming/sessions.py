"""Incremental detection of incidents from a stream of KPI values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.operators.detection import CELL, KPI_RULES, SERIES, KpiRule, describe, missed_kpis


def session_incidents(
    kpis: DataFrame, gap: str, delay: str, rules: Sequence[KpiRule] = KPI_RULES
) -> DataFrame:
    """Violations grouped into sessions that close ``gap`` after their last violation.

    ``measurement_end`` must be a timestamp with time zone for the watermark. Rows more than
    ``delay`` behind the newest are dropped; a session is emitted once, when it can no longer
    grow. The state holds one running aggregate per open session, not its rows.
    """
    found = (
        missed_kpis(kpis.withWatermark("measurement_end", delay), rules)
        .groupBy(*SERIES, F.session_window("measurement_end", gap))
        .agg(
            F.min("measurement_end").alias("started"),
            F.max("measurement_end").alias("ended"),
            F.avg("kpi_value").alias("kpi_value"),
            F.count("*").alias("violations"),
        )
    )
    return describe(found, rules).select(
        *CELL, "description", "kpi", "kpi_value", "started", "ended", "violations"
    )


def run_detection(
    kpis: DataFrame, target: str, checkpoint: str, gap: str, delay: str,
    rules: Sequence[KpiRule] = KPI_RULES,
) -> None:
    """Process everything available and append the closed incidents to ``target``."""
    query = (
        session_incidents(kpis, gap, delay, rules)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
