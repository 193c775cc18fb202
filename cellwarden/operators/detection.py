"""KPIs, threshold violations and candidate incidents."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwarden.functions.columns import compares, known_operators, ratio_kpi
from cellwarden.scale import literal_rows, with_global_rank
from cellwarden.schemas import ERAB_ATTEMPTS, ERAB_RELEASES, ERAB_SUCCESSES

CELL = ["enodeb_id", "cell_id"]
SERIES = [*CELL, "kpi"]


class KpiRule(NamedTuple):
    kpi: str
    op: str
    threshold: float
    description: str


# Watched KPIs, thresholds and texts.
KPI_RULES = (
    KpiRule("erab_success_rate", "lt", 97.0, "ERAB success rate is below 97%"),
    KpiRule("retainability", "gt", 3.0, "Retainability is above 3"),
)
SEVERITY_ORDER = ("HIGH", "MEDIUM", "LOW")

_META = pa.schema(
    [
        ("kpi", pa.string()),
        ("op", pa.string()),
        ("threshold", pa.float64()),
        ("description", pa.string()),
    ]
)


def kpi_meta(spark: SparkSession, rules: Sequence[KpiRule] = KPI_RULES) -> DataFrame:
    """The watched KPIs as a relation; each KPI once, as an incident is one cell's series of one KPI."""
    known_operators(r.op for r in rules)
    if len({r.kpi for r in rules}) < len(rules):
        raise ValueError("a KPI has more than one rule; detect with one rule each")
    return literal_rows(spark, rules, _META)


def erab_success_rate() -> Column:
    return ratio_kpi(ERAB_SUCCESSES, ERAB_ATTEMPTS, 100.0)


def retainability() -> Column:
    return ratio_kpi(ERAB_RELEASES, ["ERAB_SessionTimeUE"], 3600.0)


def performance_kpi(performance: DataFrame) -> DataFrame:
    """The derived KPI table; works on a batch or a streaming frame."""
    return performance.select(
        *CELL,
        "measurement_end",
        erab_success_rate().alias("erab_success_rate"),
        retainability().alias("retainability"),
    )


def missed_kpis(kpis: DataFrame, rules: Sequence[KpiRule] = KPI_RULES) -> DataFrame:
    """Long form of all KPI values on the wrong side of their threshold.

    ``rules`` is a Python sequence, so the broadcast relation is bounded by what the caller
    wrote down; a NULL value never violates.
    """
    meta = kpi_meta(kpis.sparkSession, rules).select("kpi", "op", "threshold")
    keys = [*CELL, "measurement_end"]
    return (
        kpis.unpivot(keys, [r.kpi for r in rules], "kpi", "kpi_value")
        .join(F.broadcast(meta), "kpi")
        .where(compares(F.col("op"), F.col("kpi_value"), F.col("threshold")))
        .select(*keys, "kpi", "kpi_value")
    )


def describe(df: DataFrame, rules: Sequence[KpiRule] = KPI_RULES) -> DataFrame:
    meta = kpi_meta(df.sparkSession, rules).select("kpi", "description")
    return df.join(F.broadcast(meta), "kpi")


def detect_incidents(kpis: DataFrame, rules: Sequence[KpiRule] = KPI_RULES) -> DataFrame:
    """One row per cell and KPI: first and last violation and the mean violating value.

    The aggregate combines before the shuffle, so a hot cell sends one row per map task.
    """
    found = missed_kpis(kpis, rules).groupBy(*SERIES).agg(
        F.min("measurement_end").alias("started"),
        F.max("measurement_end").alias("ended"),
        F.avg("kpi_value").alias("kpi_value"),
    )
    return describe(found, rules).select(
        *CELL, "description", "kpi", "kpi_value", "started", "ended"
    )


def _islands(rows: DataFrame, by: list[str], first: str, last: str, gap: str) -> DataFrame:
    """Number runs of rows whose distance to the row before is at most ``gap``."""
    order = Window.partitionBy(*by).orderBy(first)
    opens = F.col(first) > F.lag(last).over(order) + F.expr(f"interval {gap}")
    flagged = rows.withColumn("_opens", F.when(opens, 1).otherwise(0))
    return flagged.withColumn("_island", F.sum("_opens").over(order)).drop("_opens")


def _merge(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "_island").agg(
        F.min("started").alias("started"),
        F.max("ended").alias("ended"),
        F.sum("total").alias("total"),
        F.sum("n").alias("n"),
    )


def detect_sessions(
    kpis: DataFrame,
    gap: str,
    rules: Sequence[KpiRule] = KPI_RULES,
    chunk: str = "month",
) -> DataFrame:
    """Violations split into separate incidents where they are more than ``gap`` apart.

    Runs are built in two levels so that no task sorts the whole series of a hot cell: first
    inside time chunks, then over the first and last run of each chunk, the only ones that can
    continue in a neighbouring chunk. Rows of one cell, KPI and time are combined before.
    """
    points = (
        missed_kpis(kpis, rules)
        .groupBy(*SERIES, "measurement_end")
        .agg(F.sum("kpi_value").alias("total"), F.count("*").alias("n"))
        .withColumn("started", F.col("measurement_end"))
        .withColumnRenamed("measurement_end", "ended")
        .withColumn("_chunk", F.date_trunc(chunk, "started"))
    )
    local = _merge(_islands(points, [*SERIES, "_chunk"], "started", "ended", gap), [*SERIES, "_chunk"])
    # Edge runs of all chunks form one series; inner runs stay apart, in a series per chunk.
    last = F.max("_island").over(Window.partitionBy(*SERIES, "_chunk"))
    edge = (F.col("_island") == 0) | (F.col("_island") == F.col("_last"))
    runs = local.withColumn("_last", last).select(
        *SERIES, F.when(~edge, F.col("_chunk")).alias("_inner"), "started", "ended", "total", "n"
    )
    by = [*SERIES, "_inner"]
    sessions = _merge(_islands(runs, by, "started", "ended", gap), by)
    return describe(sessions.withColumn("kpi_value", F.col("total") / F.col("n")), rules).select(
        *CELL, "description", "kpi", "kpi_value", "started", "ended", F.col("n").alias("violations")
    )


def incident_id() -> Column:
    """Stable id of a detected incident, so that a repeated run finds the same one."""
    start = F.date_format("started", "yyyy-MM-dd HH:mm:ss")
    return F.sha2(F.concat_ws("|", *SERIES, start), 256)


def incident_candidates(detected: DataFrame) -> DataFrame:
    """Detected violations as new incidents, times at second precision."""
    return detected.select(
        incident_id().alias("incident_id"),
        F.date_trunc("second", "started").alias("start_ts"),
        F.date_trunc("second", "ended").alias("end_ts"),
        F.lit("NEW").alias("status"),
        "description",
        F.array(F.struct("kpi", F.col("kpi_value").alias("value"))).alias("kpi_missed"),
        *CELL,
    )


def overshoot(kpi_missed: Column, rules: Sequence[KpiRule] = KPI_RULES) -> Column:
    """Largest relative distance of a missed KPI from its threshold."""

    def distance(missed: Column) -> Column:
        threshold = F.lit(None).cast("double")
        for rule in rules:
            threshold = F.when(missed["kpi"] == rule.kpi, F.lit(rule.threshold)).otherwise(threshold)
        return F.abs(missed["value"] - threshold) / threshold

    return F.array_max(F.transform(kpi_missed, distance))


def prioritize_incidents(
    candidates: DataFrame, severities: DataFrame, rules: Sequence[KpiRule] = KPI_RULES
) -> DataFrame:
    """Rank all candidates: worst severity first, then the largest overshoot, then the id.

    ``severities`` holds (incident_id, severity); a candidate without one comes last.
    """
    rank = F.lit(len(SEVERITY_ORDER))
    for position, level in enumerate(SEVERITY_ORDER):
        rank = F.when(F.col("severity") == level, F.lit(position)).otherwise(rank)
    scored = (
        candidates.drop("severity")
        .join(severities.select("incident_id", "severity"), "incident_id", "left")
        .withColumn("_rank", rank)
        .withColumn("overshoot", overshoot(F.col("kpi_missed"), rules))
    )
    order = [F.col("_rank").asc(), F.col("overshoot").desc(), F.col("incident_id").asc()]
    return with_global_rank(scored, order, "priority").drop("_rank")
