"""Join of fact rows to incident time windows: same cell, fact inside the window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwarden.operators.sweep import count_by_hour, sweep_join
from cellwarden.scale import BROADCAST_ROWS, SALTS, salt_hot_keys
from cellwarden.sources.layout import DAY


def facts_in_windows(
    incidents: DataFrame,
    facts: DataFrame,
    keys: Sequence[tuple[str, str]],
    fact_start: str,
    fact_end: str,
    *,
    lead: str | None = None,
    ordered: bool = False,
    max_broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Fact rows with the ``incident_id`` of every window that contains them.

    A fact belongs to an incident when ``keys`` (incident column, fact column) agree, it starts
    at or after ``start_ts`` (moved back by ``lead``) and ends at or before ``end_ts``; a window
    without end is open. ``ordered`` states that no fact ends before it starts.

    One pass over the narrow window columns counts them and finds their outer bounds. The
    bounds become constant filters that reach the fact scan. Few windows are broadcast and the
    facts do not move; otherwise a sweep over both, sorted by cell and time, finds the pairs.
    """
    start = F.col("start_ts") - F.expr(f"interval {lead}") if lead else F.col("start_ts")
    windows = incidents.select(
        "incident_id",
        *[F.col(i).alias(f"_w_{f}") for i, f in keys],
        start.cast("timestamp").alias("_w_start"),
        F.col("end_ts").cast("timestamp").alias("_w_end"),
    )
    profile = windows.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_w_end").isNull()).alias("open"),
        F.min(F.unix_micros("_w_start")).alias("low"),
        F.max(F.unix_micros("_w_end")).alias("high"),
    ).first()

    facts = _prune(facts, fact_start, fact_end, profile, ordered)
    start_type, end_type = facts.schema[fact_start].dataType, facts.schema[fact_end].dataType
    windows = windows.withColumn("_w_start", F.col("_w_start").cast(start_type)).withColumn(
        "_w_end", F.col("_w_end").cast(end_type)
    )
    same_cell = [F.col(f"_w_{f}") == F.col(f) for _, f in keys]
    inside = (F.col(fact_start) >= F.col("_w_start")) & (
        F.col("_w_end").isNull() | (F.col(fact_end) <= F.col("_w_end"))
    )
    helpers = [f"_w_{f}" for _, f in keys] + ["_w_start", "_w_end"]

    if profile["n"] <= max_broadcast_rows:
        return facts.join(F.broadcast(windows), [*same_cell, inside]).drop(*helpers)

    counts = count_by_hour(facts, [f for _, f in keys], fact_start, fact_end)
    result = sweep_join(_until(facts, profile, fact_start), windows, [f for _, f in keys], fact_start, fact_end, counts)
    if not ordered and counts.where("inverted > 0").limit(1).count():
        # Facts that end before they start match windows that they overlap; they meet by cell.
        pairs = [(f, f"_w_{f}") for _, f in keys]
        left, right = salt_hot_keys(facts.where(F.col(fact_end) < F.col(fact_start)), windows, pairs, salts)
        same = [F.col(f) == F.col(w) for f, w in [*pairs, ("_salt", "_table_salt")]]
        found = left.join(right, [*same, inside]).drop(*helpers, "_salt", "_table_salt")
        result = result.unionByName(found)
    return result


def _until(facts: DataFrame, profile, fact_start: str) -> DataFrame:
    """The upper bound on the day partition, for facts that do not end before they start."""
    if profile["open"] or profile["high"] is None or DAY not in facts.columns:
        return facts
    to_high = F.timestamp_micros(F.lit(profile["high"])).cast(facts.schema[fact_start].dataType)
    return facts.where(F.col(DAY) <= F.to_date(to_high))


def _prune(facts: DataFrame, fact_start: str, fact_end: str, profile, ordered: bool) -> DataFrame:
    """Constant bounds on the fact times and, where the table has it, on the day partition."""
    if not profile["n"]:
        return facts.where(F.lit(False))
    low, high = profile["low"], profile["high"]
    if low is not None:
        from_low = F.timestamp_micros(F.lit(low)).cast(facts.schema[fact_start].dataType)
        facts = facts.where(F.col(fact_start) >= from_low)
        if DAY in facts.columns:
            facts = facts.where(F.col(DAY) >= F.to_date(from_low))
    if not profile["open"] and high is not None:
        to_high = F.timestamp_micros(F.lit(high)).cast(facts.schema[fact_end].dataType)
        facts = facts.where(F.col(fact_end) <= to_high)
        if ordered and DAY in facts.columns:
            facts = facts.where(F.col(DAY) <= F.to_date(to_high))
    return facts
