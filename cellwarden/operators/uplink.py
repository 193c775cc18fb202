"""Uplink signal level and configuration per incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.operators.windows import facts_in_windows
from cellwarden.scale import lookup_join

CELL = ["enodeb_id", "cell_id"]
CELL_KEYS = tuple((c, c) for c in CELL)
# Normal uplink RSSI range, optimal power settings, tolerated deviation.
RSSI_RANGE = (-120.0, -114.0)
OPTIMUM = {"pZeroNominalPucch": -114.0, "pZeroNominalPusch": -100.0}
TOLERANCE = 0.05


def rssi_levels(incidents: DataFrame, performance: DataFrame, **options) -> DataFrame:
    """(incident_id, uplink_rssi): mean UL_RSSI, for incidents whose cell reported any."""
    day = [c for c in ("date",) if c in performance.columns]
    narrow = performance.select(*CELL, "measurement_end", "UL_RSSI", *day)
    inside = facts_in_windows(
        incidents, narrow, CELL_KEYS, "measurement_end", "measurement_end", ordered=True, **options
    )
    return inside.groupBy("incident_id").agg(F.avg("UL_RSSI").alias("uplink_rssi"))


def uplink_rssi(incidents: DataFrame, performance: DataFrame, **options) -> DataFrame:
    """Mean UL_RSSI of the cell over each incident; NULL where the cell reported none."""
    levels = rssi_levels(incidents, performance, **options)
    return incidents.select("incident_id", *CELL).join(levels, "incident_id", "left")


def uplink_configuration(cases: DataFrame, cell_config: DataFrame) -> DataFrame:
    """Add the power settings of the cell.

    Equal configuration rows of a cell count once; a cell with different ones stops the analysis with an error, as neither
    of them can be called the right one.
    """
    config = cell_config.groupBy(*CELL).agg(*[F.collect_set(F.struct(c)).alias(c) for c in OPTIMUM])

    def single(name: str) -> Column:
        cell = F.concat_ws("/", *CELL)
        several = F.raise_error(F.concat(F.lit(f"several values of {name} for cell "), cell)).cast("double")
        return F.when(F.size(name) > 1, several).otherwise(F.col(name)[0][name]).alias(name)

    return lookup_join(cases, config.select(*CELL, *[single(c) for c in OPTIMUM]), CELL, "left")


def rssi_out_of_range(rssi: Column, low: float = RSSI_RANGE[0], high: float = RSSI_RANGE[1]) -> Column:
    return ~rssi.between(low, high)


def config_deviation(
    cases: DataFrame, optimum: dict[str, float] | None = None, tolerance: float = TOLERANCE
) -> DataFrame:
    """Relative distance of each setting from its optimum, and whether it exceeds the tolerance."""
    for name, best in (optimum or OPTIMUM).items():
        distance = F.abs(F.col(name) - F.lit(best)) / F.abs(F.lit(best))
        cases = cases.withColumn(f"{name}_deviation", distance).withColumn(
            f"{name}_off", F.col(f"{name}_deviation") > tolerance
        )
    return cases
