"""Root-cause findings and severity from conditions on measured values."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.functions.columns import compares, known_operators
from cellwarden.operators.detection import SEVERITY_ORDER


class Condition(NamedTuple):
    """Holds for an incident that missed ``kpi`` when ``metric`` compares as stated.

    The metric counts only if a matched rule of that KPI asks for ``tool``, the analysis producing it.
    """

    kpi: str
    metric: str
    op: str
    threshold: float
    high: float | None
    tool: str
    cause: str


class SeverityRule(NamedTuple):
    """``metric`` NULL stands for the value of the missed KPI itself."""

    kpi: str
    metric: str | None
    op: str
    threshold: float
    level: str


# Conditions and levels stated by the two rule documents. The percentage of
# security failures that is sufficient is not stated there; 50 is our default.
CONDITIONS = (
    Condition("erab_success_rate", "security_failure_pct", "ge", 50.0, None,
              "get_cell_trace_statistics", "failed security setup"),
    Condition("retainability", "uplink_rssi", "outside", -120.0, -114.0,
              "get_uplink_rssi_level", "uplink RSSI outside the normal range"),
    Condition("retainability", "pZeroNominalPucch_deviation", "gt", 0.05, None,
              "get_uplink_configuration", "pZeroNominalPucch differs from the optimum"),
    Condition("retainability", "pZeroNominalPusch_deviation", "gt", 0.05, None,
              "get_uplink_configuration", "pZeroNominalPusch differs from the optimum"),
)
SEVERITY_RULES = (
    SeverityRule("erab_success_rate", None, "lt", 95.0, "HIGH"),
    SeverityRule("retainability", None, "gt", 3.5, "HIGH"),
    SeverityRule("retainability", "uplink_rssi", "lt", -120.0, "MEDIUM"),
    SeverityRule("retainability", "uplink_rssi", "gt", -105.0, "HIGH"),
)
DEFAULT_LEVEL = "LOW"
NO_FINDINGS = "No root cause was found."


def analyze_incidents(
    cases: DataFrame,
    conditions: Sequence[Condition] = CONDITIONS,
    tools_col: str = "processing_rule_tools",
    rules_col: str = "matched_rules",
) -> DataFrame:
    """Add ``findings`` and the ``analysis`` text.

    A finding names the matched rules that ask for it: those with the condition's KPI and tool; without such a rule there is no finding.
    Cases that carry only the union of their rules' tools are judged by that, and their findings name no rule.
    The conditions are a Python sequence, so they become one projection over the case columns:
    no join and no shuffle, whatever the number of cases.
    """
    by_rule = rules_col in cases.columns
    known_operators(c.op for c in conditions)
    kpis = F.col("kpi_missed.kpi")

    def finding(c: Condition) -> Column:
        value = F.col(c.metric)
        high = F.lit(c.high) if c.high is not None else None
        holds = (
            F.array_contains(kpis, c.kpi)
            & F.array_contains(F.col(tools_col), c.tool)
            & compares(F.lit(c.op), value, F.lit(c.threshold), high)
        )
        asking = F.array().cast("array<string>")
        if by_rule:
            asks = F.filter(rules_col, lambda r: F.array_contains(r["kpis"], c.kpi) & F.array_contains(r["tools"], c.tool))
            asking = F.transform(asks, lambda r: r["rule_id"])
            holds = holds & (F.size(asking) > 0)
        evidence = F.concat(F.lit(f"{c.cause} ({c.metric} = "), value.cast("string"), F.lit(")"))
        return F.when(
            holds,
            F.struct(
                F.lit(c.cause).alias("cause"),
                evidence.alias("evidence"),
                F.lit(c.metric).alias("metric"),
                value.cast("double").alias("value"),
                asking.alias("rules"),
            ),
        )

    found = cases.withColumn("findings", F.array_compact(F.array(*[finding(c) for c in conditions])))
    text = F.array_join(F.transform("findings", lambda f: f["evidence"]), "\n")
    return found.withColumn(
        "analysis", F.when(F.size("findings") > 0, text).otherwise(F.lit(NO_FINDINGS))
    )


def classify_severity(
    cases: DataFrame, rules: Sequence[SeverityRule] = SEVERITY_RULES
) -> DataFrame:
    """Add ``severity_level`` and its explanation.

    Each missed KPI takes the first rule that holds, else LOW; the incident takes the worst
    level of its KPIs. Metric columns that a rule names must be on ``cases``.
    """

    def graded(level: str, why: Column) -> Column:
        rank = SEVERITY_ORDER.index(level)
        return F.struct(F.lit(rank).alias("rank"), F.lit(level).alias("level"), why.alias("why"))

    def grade(missed: Column) -> Column:
        result = graded(
            DEFAULT_LEVEL, F.concat(F.lit("no severity rule holds for "), missed["kpi"])
        )
        for rule in reversed(rules):
            value = missed["value"] if rule.metric is None else F.col(rule.metric)
            holds = (missed["kpi"] == rule.kpi) & compares(
                F.lit(rule.op), value, F.lit(rule.threshold)
            )
            why = F.concat(
                F.lit(f"{rule.metric or rule.kpi} = "),
                value.cast("string"),
                F.lit(f" is {rule.op} {rule.threshold}"),
            )
            result = F.when(holds, graded(rule.level, why)).otherwise(result)
        return result

    worst = F.array_min(F.transform("kpi_missed", grade))
    return (
        cases.withColumn("_worst", worst)
        .withColumn("severity_level", F.coalesce("_worst.level", F.lit(DEFAULT_LEVEL)))
        .withColumn(
            "severity_level_explanation",
            F.coalesce("_worst.why", F.lit("the incident lists no missed KPI")),
        )
        .drop("_worst")
    )
