"""The incident table and keyed document tables as pure functions over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwarden.scale import lookup_join
from cellwarden.schemas import INCIDENTS
from cellwarden.sources import versions


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows stay; incoming rows are added where their key is new.

    The existing keys are first cut to the incoming ones, so a large table is neither broadcast
    nor shuffled for a small delta.
    """
    known = lookup_join(existing.select(key), incoming.select(key).distinct(), [key], "left_semi")
    added = lookup_join(incoming, known.distinct(), [key], "left_anti")
    return existing.unionByName(added)


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace existing rows of the same key or are added."""
    kept = lookup_join(existing, incoming.select(key).distinct(), [key], "left_anti")
    return kept.unionByName(incoming)


def get_incidents(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per requested id with ``lookup_status``: success, not found or duplicate.

    Incident columns are filled only on success. Rows are counted per id with a combining
    aggregate, so an id with very many copies does not gather in one task.
    """
    ids = ids.select("incident_id").distinct()
    fields = [
        c
        for c in ("enodeb_id", "cell_id", "start_ts", "end_ts", "status", "description", "kpi_missed")
        if c in incidents.columns
    ]
    wanted = lookup_join(incidents.select("incident_id", *fields), ids, ["incident_id"], "left_semi")
    found = wanted.groupBy("incident_id").agg(
        F.count("*").alias("_rows"), F.any_value(F.struct(*fields)).alias("_row")
    )
    status = (
        F.when(F.col("_rows").isNull(), "not found")
        .when(F.col("_rows") > 1, "duplicate")
        .otherwise("success")
    )
    return ids.join(found, "incident_id", "left").select(
        "incident_id",
        status.alias("lookup_status"),
        *[F.when(F.col("_rows") == 1, F.col(f"_row.{c}")).alias(c) for c in fields],
    )


def create_incidents(
    candidates: DataFrame,
    approved: DataFrame,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Rows to append to the incident table for the approved candidates.

    With ``existing`` given, incidents already in the table are not created again.
    """
    chosen = lookup_join(candidates, approved.select("incident_id").distinct(), ["incident_id"], "left_semi")
    if existing is not None:
        known = lookup_join(
            existing.select("incident_id"), chosen.select("incident_id"), ["incident_id"], "left_semi"
        )
        chosen = lookup_join(chosen, known.distinct(), ["incident_id"], "left_anti")
    defaults = {
        "events_embeddings": F.array().cast("array<double>"),
        "created_ts": F.current_timestamp(),
    }
    given = set(chosen.columns)
    return chosen.select(
        [
            (F.col(f.name) if f.name in given else defaults.get(f.name, F.lit(None)))
            .cast(f.dataType.simpleString())
            .alias(f.name)
            for f in INCIDENTS
        ]
    )


def update_incidents(incidents: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store the results of analysed cases; returns (new snapshot, cases that failed).

    A case without an embedding fails and leaves its incident as it was. ``cases`` holds one
    row per incident: incident_id, report, severity, events, events_embeddings.
    """
    usable = F.coalesce(F.size("events_embeddings") > 0, F.lit(False))
    ready = cases.where(usable).select(
        "incident_id",
        F.struct(
            F.lit("ANALYZED").alias("status"),
            F.col("report").alias("preliminary_analysis"),
            "severity",
            "events",
            "events_embeddings",
        ).alias("_new"),
    )
    changed = ["status", "preliminary_analysis", "severity", "events", "events_embeddings"]
    joined = lookup_join(incidents, ready, ["incident_id"], "left")
    updated = joined.select(
        [
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in changed
            else F.col(c)
            for c in incidents.columns
        ]
    )
    return updated, failed_cases(cases)


def failed_cases(cases: DataFrame) -> DataFrame:
    """Cases without an embedding, with the message of their failure."""
    usable = F.coalesce(F.size("events_embeddings") > 0, F.lit(False))
    return cases.where(~usable).select(
        "incident_id",
        F.lit("error").alias("status"),
        F.lit("Failed to generate embeddings for the event.").alias("description"),
    )


def store_results(spark: SparkSession, root: str, cases: DataFrame) -> DataFrame:
    """Store the results of analysed cases in the versioned table below ``root``; returns the cases that failed.

    Only files that hold an incident of a usable case are rewritten.
    """
    usable = cases.where(F.size("events_embeddings") > 0)
    versions.rewrite(spark, root, usable, "incident_id", lambda old: update_incidents(old, usable)[0])
    return failed_cases(cases)


def upsert_stored(spark: SparkSession, root: str, incoming: DataFrame, key: str) -> int:
    """Replace or add rows of the versioned table below ``root``; files without a key of ``incoming`` in their range stay."""
    return versions.rewrite(spark, root, incoming, key, lambda old: upsert(old, incoming, key), adds=True)


def create_table(spark: SparkSession, name: str, path: str) -> None:
    """A catalog table of incidents whose ``created_ts`` defaults to the time of the insert and whose embedding to an empty one."""
    defaults = {"created_ts": " DEFAULT current_timestamp()", "events_embeddings": " DEFAULT array()"}
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{defaults.get(f.name, '')}" for f in INCIDENTS)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{path}'")


def append_to_table(rows: DataFrame, name: str) -> None:
    """Insert rows by the names of their columns; columns that are absent get the table's defaults, or null."""
    columns = ", ".join(f"`{c}`" for c in rows.columns)
    rows.sparkSession.sql(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {{rows}}", rows=rows)
