"""The KPI table kept in step with a growing performance table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.operators.detection import CELL, performance_kpi
from cellwarden.operators.incidents import upsert
from cellwarden.session import cut_lineage
from cellwarden.sources import versions


def maintain_kpi(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType
) -> None:
    """Add KPIs for performance files that arrived since the last call, each exactly once.

    The checkpoint remembers the files already read, so a repeated or restarted call does not
    scan the table again.
    """
    kpis = performance_kpi(spark.readStream.schema(schema).parquet(source))
    query = (
        kpis.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()


#: Key of the merged table: cell and time of a measurement as one text, so that files hold ranges of it.
MEASUREMENT = "measurement"


def merge_kpi(spark: SparkSession, source: str, root: str, checkpoint: str, schema: T.StructType) -> None:
    """Keep the KPI table below ``root`` equal to the newest measurement of each cell and time in ``source``.

    A later file corrects or repeats rows of earlier ones: of the rows of one cell and time that of the file written last
    counts (then by its name, then by the values). Every micro-batch replaces its measurements by key, so a batch that runs again changes
    nothing, and only the files that hold its measurements are rewritten.
    """

    rows = spark.readStream.schema(schema).parquet(source).select(
        "*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("arrived")
    )

    def latest(batch: DataFrame, number: int) -> None:
        counters = [c for c in batch.columns if c != "arrived"]
        key = [*CELL, "measurement_end"]
        newest = batch.groupBy(*key).agg(F.max(F.struct("arrived", *[c for c in counters if c not in key])).alias("row"))
        kpis = performance_kpi(newest.select(*key, "row.*"))
        time = F.date_format("measurement_end", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        made = cut_lineage(kpis.withColumn(MEASUREMENT, F.concat_ws("|", *CELL, time)), "batch")
        if versions.versions(spark, root):
            versions.rewrite(spark, root, made, MEASUREMENT, lambda old: upsert(old, made, MEASUREMENT), adds=True)
        else:
            versions.create_table(made, root, MEASUREMENT)

    query = rows.writeStream.foreachBatch(latest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
