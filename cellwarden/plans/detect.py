"""From performance counters to rows of the incident table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from cellwarden.operators.detection import KPI_RULES, KpiRule, detect_incidents, incident_candidates, performance_kpi
from cellwarden.operators.incidents import create_incidents


def potential_incidents(performance: DataFrame, rules: Sequence[KpiRule] = KPI_RULES) -> DataFrame:
    """Candidates for all cells: one scan of the counters, one shuffle of partial aggregates."""
    return incident_candidates(detect_incidents(performance_kpi(performance), rules))


def new_incidents(
    performance: DataFrame,
    approved: DataFrame,
    existing: DataFrame | None = None,
    rules: Sequence[KpiRule] = KPI_RULES,
) -> DataFrame:
    return create_incidents(potential_incidents(performance, rules), approved, existing)
