import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cellwarden.operators.incidents import upsert_stored
from cellwarden.schemas import ERAB_ATTEMPTS, ERAB_RELEASES, ERAB_SUCCESSES
from cellwarden.session import scratch_path
from cellwarden.sources import versions
from cellwarden.streaming import kpi as kpi_stream
from tests.conftest import rows

TABLE = "id string, value long"


def table(spark, n=400, files=20):
    root = scratch_path(spark, "versioned")
    made = [(f"k{i:04d}", i) for i in range(0, 2 * n, 2)]
    random.Random(2).shuffle(made)
    versions.create_table(spark.createDataFrame(made, TABLE), root, "id", files)
    return root, dict(made)


def contents(spark, root, version=None):
    return {r["id"]: r["value"] for r in versions.read_table(spark, root, version).collect()}


def test_a_change_rewrites_only_files_that_hold_its_keys(spark):
    root, made = table(spark)
    before = versions.live_files(spark, root)
    assert len(before) > 10
    keys = spark.createDataFrame([("k0100",), ("k0102",), ("k0700",), ("k0101",), (None,)], "id string")
    double = lambda old: old.withColumn("value", F.when(F.col("id").isin("k0100", "k0102", "k0700"), -F.col("value")).otherwise(F.col("value")))
    assert versions.rewrite(spark, root, keys, "id", double) == 2
    after = versions.live_files(spark, root)
    touched = set(before["file"]) - set(after["file"])
    assert 1 <= len(touched) <= 3 and len(after) == len(before) and after["rows"].sum() == len(made)
    expected = {k: -v if k in ("k0100", "k0102", "k0700") else v for k, v in made.items()}
    assert contents(spark, root) == expected and contents(spark, root, 1) == made
    assert (after["low"].iloc[1:].to_numpy() > after["high"].iloc[:-1].to_numpy()).all()


def test_keys_that_are_not_there_change_nothing(spark):
    root, made = table(spark)
    missing = spark.createDataFrame([("k0101",), ("zzz",)], "id string")
    assert versions.rewrite(spark, root, missing, "id", lambda old: old.limit(0)) == 1
    assert versions.rewrite(spark, root, missing.limit(0), "id", lambda old: old.limit(0), adds=True) == 1
    assert contents(spark, root) == made and versions.versions(spark, root) == [1]


def test_added_keys_go_to_the_file_of_their_range(spark):
    root, made = table(spark)
    incoming = [("a", 1), ("k0101", 2), ("k0100", 3), ("zzz", 4)]
    assert upsert_stored(spark, root, spark.createDataFrame(incoming, TABLE), "id") == 2
    assert contents(spark, root) == {**made, **dict(incoming)}
    files = versions.live_files(spark, root)
    assert (files["low"].iloc[1:].to_numpy() > files["high"].iloc[:-1].to_numpy()).all()
    assert upsert_stored(spark, root, spark.createDataFrame([("zzzz", 9)], TABLE), "id") == 3
    assert contents(spark, root, 3)["zzzz"] == 9 and "zzzz" not in contents(spark, root, 2)


def test_two_writers_of_one_version_meet_in_an_error(spark):
    root, _ = table(spark, 20, 2)
    files = versions.live_files(spark, root)
    schema = versions.read_table(spark, root).schema
    folder = files["file"].iloc[0].rsplit("/", 1)[0]
    with pytest.raises(AnalysisException):
        versions._write_version(spark, root, 1, schema, files, folder, "id")
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, root, 7)
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, root + "-none")


def test_merged_kpis_follow_corrections_and_ignore_replays(spark):
    source, root = scratch_path(spark, "performance"), scratch_path(spark, "kpi")
    checkpoint = scratch_path(spark, "checkpoint")
    columns = [f"{n}" for n in (*ERAB_ATTEMPTS, *ERAB_SUCCESSES, *ERAB_RELEASES, "ERAB_SessionTimeUE")]
    right = spark.range(60).select(
        F.concat(F.lit("e"), F.col("id") % 3).alias("enodeb_id"), F.concat(F.lit("c"), F.col("id") % 6).alias("cell_id"),
        F.timestamp_seconds(F.lit(1_740_000_000) + 900 * F.floor(F.col("id") / 6)).alias("measurement_end"),
        *[(F.col("id") + i + 1).alias(c) for i, c in enumerate(columns)],
    )
    first = right.withColumn("ERAB_SessionTimeUE", F.lit(1).cast("long"))
    second = right.where("ERAB_SessionTimeUE % 2 = 0")
    first.write.parquet(source)
    kpi_stream.merge_kpi(spark, source, root, checkpoint, first.schema)
    second.write.mode("append").parquet(source)
    kpi_stream.merge_kpi(spark, source, root, checkpoint, first.schema)
    expected = rows(kpi_stream.performance_kpi(second))
    kept = versions.read_table(spark, root).drop(kpi_stream.MEASUREMENT)
    assert set(expected) <= set(rows(kept)) and kept.count() == first.count()
    number = versions.versions(spark, root)
    kpi_stream.merge_kpi(spark, source, root, checkpoint, first.schema)  # nothing new
    assert versions.versions(spark, root) == number
    kpi_stream.merge_kpi(spark, source, root, scratch_path(spark, "checkpoint"), first.schema)  # all again
    assert rows(versions.read_table(spark, root).drop(kpi_stream.MEASUREMENT)) == rows(kept)
