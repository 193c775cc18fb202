"""Suggested actions of an incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.operators.rules import gate_tools
from cellwarden.scale import lookup_join
from cellwarden.schemas import ACTION

# Action name, states and messages.
ADJUST = "initiate_uplink_configuration_adjustment"
SUGGESTED = "SUGGESTED"
NO_ACTIONS = "There are no suggested automated actions to be taken."
ADJUSTMENT_ISSUED = (
    "Uplink adjustment request has been issued. "
    "It can take up to an hour for the changes to take the effect."
)


def _existing(cases: DataFrame) -> Column:
    empty = F.array().cast(f"array<{ACTION.simpleString()}>")
    return F.coalesce("actions", empty) if "actions" in cases.columns else empty


def suggest_actions(cases: DataFrame, tools_col: str = "processing_rule_tools") -> DataFrame:
    """Append an uplink adjustment where the rule for dropped calls asks for one.

    Needs on ``cases``: kpi_missed, rssi_out_of_range, both ``*_off`` flags and the tool names
    of the matched rules. Earlier actions of the case are kept.
    """
    off = F.coalesce("pZeroNominalPucch_off", F.lit(False)) | F.coalesce(
        "pZeroNominalPusch_off", F.lit(False)
    )
    holds = (
        F.array_contains("kpi_missed.kpi", "retainability")
        & F.array_contains(tools_col, ADJUST)
        & F.col("rssi_out_of_range")
        & off
    )
    action = F.struct(
        F.lit(ADJUST).alias("tool_name"),
        F.lit("The uplink configuration differs from the optimum by more than 5%").alias(
            "reason_to_perform"
        ),
        F.create_map(
            F.lit("enodeb_id"), F.col("enodeb_id"), F.lit("cell_id"), F.col("cell_id")
        ).alias("parameters"),
        F.lit(SUGGESTED).alias("status"),
    )
    added = F.when(holds, F.array(action)).otherwise(F.array())
    return cases.withColumn(
        "actions", F.concat(_existing(cases), added.cast(f"array<{ACTION.simpleString()}>"))
    )


def split_actions(cases: DataFrame) -> DataFrame:
    """List actions: suggested ones in full, others by name and state, none as a message."""
    rows = cases.select("incident_id", F.explode_outer(_existing(cases)).alias("a"))
    suggested = F.col("a.status") == SUGGESTED
    return rows.select(
        "incident_id",
        F.when(F.col("a").isNull(), "none")
        .when(suggested, "suggested")
        .otherwise("other")
        .alias("listing"),
        F.col("a.tool_name").alias("tool_name"),
        F.when(suggested, F.col("a.reason_to_perform")).alias("reason_to_perform"),
        F.when(suggested, F.col("a.parameters")).alias("parameters"),
        F.col("a.status").alias("status"),
        F.when(F.col("a").isNull(), NO_ACTIONS).alias("message"),
    )


def actions_toolset(cases: DataFrame) -> DataFrame:
    """The registered tools an incident's actions name."""
    names = F.transform(_existing(cases), lambda a: a["tool_name"])
    return cases.select("incident_id", gate_tools(names).alias("action_tools"))


def issue_adjustments(cases: DataFrame, approved: DataFrame) -> DataFrame:
    """Requests for the suggested uplink adjustments approved as (incident_id, tool_name, parameters).

    An approval holds for the exact parameters it names; ``parameters`` is a map, and its absence approves an action whatever
    its parameters are. The request id is made from incident, tool and parameters, so a changed action is a new request.
    """
    actions = (
        cases.select("incident_id", F.explode(_existing(cases)).alias("a"))
        .where((F.col("a.status") == SUGGESTED) & (F.col("a.tool_name") == ADJUST))
        .select("incident_id", F.col("a.tool_name").alias("tool_name"), "a.parameters")
        .withColumn("_with", parameter_text(F.col("parameters")))
    )
    keys = ["incident_id", "tool_name"]
    if "parameters" in approved.columns:
        given = approved.select(*keys, parameter_text(F.col("parameters")).alias("_with")).distinct()
        chosen = lookup_join(actions, given, [*keys, "_with"], "left_semi")
    else:
        chosen = lookup_join(actions, approved.select(*keys).distinct(), keys, "left_semi")
    return chosen.select(
        F.sha2(F.concat_ws("|", *keys, "_with"), 256).alias("request_id"),
        "incident_id",
        "tool_name",
        F.col("parameters")["enodeb_id"].alias("enodeb_id"),
        F.col("parameters")["cell_id"].alias("cell_id"),
        F.lit(ADJUSTMENT_ISSUED).alias("details"),
    )


def parameter_text(parameters: Column) -> Column:
    """Parameters as one text in order of their names; empty for none."""
    entries = F.array_sort(F.map_entries(parameters))
    lines = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(lines, "|"), F.lit(""))
