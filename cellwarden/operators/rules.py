"""Rules that apply to incidents, and the analyses they call for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.scale import BROADCAST_ROWS, SALTS, lookup_join, measured, salt_hot_keys

# Names of the available analyses, and the two retrieval messages.
ANALYSES = (
    "get_cell_trace_statistics",
    "get_uplink_configuration",
    "get_uplink_rssi_level",
    "initiate_uplink_configuration_adjustment",
)
RULES_FOUND = "Successfully retrieved processing rules."
NO_RULES = "Couldn't find incident specific rules."

RULE_COLUMNS = [
    "rule_id",
    "processing_rule",
    "processing_rule_tools",
    "severity_determination_rule",
    "severity_determination_rule_tools",
]


def match_rules(
    incidents: DataFrame,
    rules: DataFrame,
    *,
    current_only: bool = False,
    keep_unmatched: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Every (incident, rule) pair that shares at least one missed KPI.

    Both sides are exploded to single KPIs and joined on equality. A pair that shares several
    KPIs is kept only at the first one the incident lists, so no distinct is needed. With
    ``keep_unmatched`` an incident without rules stays, with NULL rule columns (it may then
    have more than one such row).
    """
    pairs = _pairs(incidents, rules, current_only, keep_unmatched, max_broadcast_rows, salts)
    return pairs.select("incident_id", *RULE_COLUMNS)


def _pairs(
    incidents: DataFrame, rules: DataFrame, current_only: bool, keep_unmatched: bool, max_broadcast_rows: int, salts: int
) -> DataFrame:
    """The pairs of ``match_rules``, with all KPIs of the rule as ``_rule_kpis``."""
    how = "left" if keep_unmatched else "inner"
    if current_only:
        rules = rules.where("is_current")
    split = F.explode_outer if keep_unmatched else F.explode
    left = incidents.select("incident_id", F.array_distinct("kpi_missed.kpi").alias("_kpis")).select(
        "incident_id", "_kpis", split("_kpis").alias("_kpi")
    )
    right = rules.select(
        *RULE_COLUMNS, F.array_distinct("kpi_missed").alias("_rule_kpis")
    ).select("*", F.explode("_rule_kpis").alias("_rule_kpi"))
    condition = [
        F.col("_kpi") == F.col("_rule_kpi"),
        F.get(F.array_intersect("_kpis", "_rule_kpis"), F.lit(0)) == F.col("_kpi"),
    ]
    right, small = measured(right, max_broadcast_rows)
    if small:
        return left.join(F.broadcast(right), condition, how)
    # Few KPIs cover most incidents, so the KPI alone is a hot join key.
    left, right = salt_hot_keys(left, right, [("_kpi", "_rule_kpi")], salts)
    return left.join(right, [*condition, F.col("_salt") == F.col("_table_salt")], how)


def collect_rules(
    incidents: DataFrame,
    rules: DataFrame,
    *,
    current_only: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Per incident: the rule texts, the union of tool names, the matched rules, and whether rules were found.

    Lists are ordered by rule id, tool sets by name. ``matched_rules`` names each rule with its KPIs and its tools, so that findings can
    be traced to rules. Rules are collected once for each set of missed KPIs that occurs, and incidents look their set up:
    rule texts are not shuffled per incident. A list is as long as the rules that name one of the KPIs, never as long as the data.
    """
    kpis = F.coalesce("kpi_missed.kpi", F.array().cast("array<string>"))
    asked = incidents.select("incident_id", F.array_sort(F.array_distinct(F.array_compact(kpis))).alias("_set"))
    sets = asked.select(
        F.col("_set").alias("incident_id"), F.transform("_set", lambda k: F.struct(k.alias("kpi"))).alias("kpi_missed")
    ).distinct()
    matched = _pairs(sets, rules, current_only, True, max_broadcast_rows, salts)

    def texts(name: str) -> Column:
        pairs = F.array_sort(
            F.collect_list(F.when(F.col("rule_id").isNotNull(), F.struct("rule_id", name)))
        )
        return F.transform(pairs, lambda p: p[name])

    def tools(name: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name))))

    rule = F.struct(
        "rule_id", F.col("_rule_kpis").alias("kpis"), F.coalesce("processing_rule_tools", F.array().cast("array<string>")).alias("tools")
    )
    collected = matched.groupBy(F.col("incident_id").alias("_set")).agg(
        texts("processing_rule").alias("processing_rules"),
        tools("processing_rule_tools").alias("processing_rule_tools"),
        texts("severity_determination_rule").alias("severity_determination_rules"),
        tools("severity_determination_rule_tools").alias("severity_determination_rule_tools"),
        F.array_sort(F.collect_list(F.when(F.col("rule_id").isNotNull(), rule))).alias("matched_rules"),
        F.when(F.count("rule_id") > 0, RULES_FOUND).otherwise(NO_RULES).alias("rules_status"),
    )
    return lookup_join(asked, collected, ["_set"], "left", max_rows=max_broadcast_rows, salts=salts).drop("_set")


def gate_tools(required: Column, available: Sequence[str] = ANALYSES) -> Column:
    """The available tools whose name is required, in the order they are registered."""
    return F.array_intersect(F.array(*[F.lit(a) for a in available]), required)
