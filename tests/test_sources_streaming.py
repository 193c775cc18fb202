import json
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from cellwarden.operators import detection
from cellwarden.schemas import CELL_TRACES, PERFORMANCE
from cellwarden.session import scratch_path
from cellwarden.sources import csv, layout, rules
from cellwarden.streaming.kpi import maintain_kpi
from cellwarden.streaming.sessions import run_detection
from tests.conftest import rows, ts


def write(path, name, text):
    folder = path / name
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text(text)
    return str(folder)


def test_columns_match_by_name(spark, tmp_path):
    source = write(
        tmp_path, "perf",
        "extra,UL_RSSI,measurement_end,cell_id,enodeb_id,RRC_ConnMax\nx,-101,12/31/2025 23:45:00,c1,e1,\ny,,01/01/2026 00:00:00,c2,e1,5\n",
    )
    df = csv.load_csv_by_name(spark, source, PERFORMANCE)
    assert [f.name for f in df.schema] == [f.name for f in PERFORMANCE]
    assert rows(df, "enodeb_id", "cell_id", "measurement_end", "UL_RSSI", "RRC_ConnMax", "ERAB_SessionTimeUE") == [
        ("e1", "c1", ts("2025-12-31 23:45:00"), -101, None, None),
        ("e1", "c2", ts("2026-01-01 00:00:00"), None, 5, None),
    ]
    target = scratch_path(spark, "appended")
    for _ in range(2):
        csv.append_csv(spark, source, PERFORMANCE, target)
    assert spark.read.parquet(target).count() == 4


def test_bad_values_and_headers_fail(spark, tmp_path):
    bad = write(tmp_path, "bad", "enodeb_id,cell_id,measurement_end\ne,c,2025-01-01\n")
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        csv.load_csv_by_name(spark, bad, PERFORMANCE).collect()
    missing = write(tmp_path, "missing", "enodeb_id,measurement_end\ne,01/01/2025 00:00:00\n")
    with pytest.raises(ValueError, match="cell_id"):
        csv.load_csv_by_name(spark, missing, PERFORMANCE)
    mixed = write(tmp_path, "mixed", "imsi,imeisv\n1,2\n")
    (tmp_path / "mixed" / "b.csv").write_text("imeisv,imsi\n2,1\n")
    with pytest.raises(Exception, match="does not conform"):
        csv.load_csv_by_name(spark, mixed, CELL_TRACES).collect()


def test_csv_to_jsonl_keeps_quotes_breaks_and_blanks(spark, tmp_path):
    source = write(tmp_path, "in", 'id,text,note\n1,"say ""hi"", ok",\n2,"two\nlines",""\n')
    target = str(tmp_path / "out")
    csv.csv_to_jsonl(spark, source, target)
    lines = [json.loads(l) for f in os.listdir(target) if f.endswith(".json") for l in open(f"{target}/{f}")]
    assert sorted(lines, key=lambda r: r["id"]) == [
        {"id": "1", "text": 'say "hi", ok', "note": ""}, {"id": "2", "text": "two\nlines", "note": ""}
    ]
    with pytest.raises(FileNotFoundError, match="nowhere"):
        csv.csv_to_jsonl(spark, str(tmp_path / "nowhere.csv"), str(tmp_path / "x"))


def test_rule_files_take_their_id_from_the_file_name(spark, tmp_path):
    rule = {"description": "d", "kpi_missed": ["a"], "processing_rule_tools": [], "creation_date": "2025-12-26 08:30:00 UTC",
            "is_current": True, "unknown": 1}
    for name in ("drop-levels", "rate.v2"):
        (tmp_path / f"{name}.json").write_text(json.dumps(rule, indent=2))
    df = rules.load_rules(spark, str(tmp_path))
    assert rows(df, "rule_id", "kpi_missed", "creation_date", "is_current") == [
        ("drop-levels", ["a"], ts("2025-12-26 08:30:00"), True), ("rate.v2", ["a"], ts("2025-12-26 08:30:00"), True)
    ]


def test_written_rules_are_read_back_by_their_file_names(spark, tmp_path):
    schema = "rule_id string, description string, kpi_missed array<string>, creation_date timestamp, is_current boolean"
    data = [("drop-levels", "two\nlines", ["a", "b"], ts("2025-12-26 08:30:00"), True), ("rate.v2 x%", None, [], None, False)]
    path = str(tmp_path / "rules")
    rules.write_rules(spark.createDataFrame(data, schema), path)
    df = rules.load_rules(spark, path)
    assert rows(df, "rule_id", "kpi_missed", "is_current")[0] == ("drop-levels", ["a", "b"], True) and df.count() == 2
    assert sorted(f.name for f in (tmp_path / "rules").glob("*.json")) == ["drop-levels.json", "rate.v2 x%.json"]
    for wrong in ([data[0], data[0]], [("a/b", *data[0][1:])], [(None, *data[0][1:])]):
        with pytest.raises(ValueError, match="rule id"):
            rules.write_rules(spark.createDataFrame(wrong, schema), str(tmp_path / "wrong"))


def test_rule_files_are_written_by_many_tasks(spark, tmp_path):
    """Few bytes, but a file per rule: they must not be put together into one task."""
    ids = spark.range(0, 60, 1, 1).select(F.concat(F.lit("rule "), "id").alias("rule_id"), F.lit("d").alias("description"))
    context = spark.sparkContext
    context.setJobGroup("write-rules", "write-rules")
    try:
        rules.write_rules(ids, str(tmp_path / "rules"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("write-rules") for s in tracker.getJobInfo(j).stageIds]
    assert max(info.numTasks for info in map(tracker.getStageInfo, stages) if info) >= 8
    assert rules.load_rules(spark, str(tmp_path / "rules")).select("rule_id").distinct().count() == 60


def test_csv_is_split_unless_a_field_holds_a_line_break(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text('id,text\n1,"say ""hi"", ok"\n2,\n')
    broken.write_text('id,text\n1,"two\nlines"\n2,x\n')
    assert not csv.breaks_in_fields(spark, str(plain)) and csv.breaks_in_fields(spark, str(broken))
    for source, texts in ((plain, ['say "hi", ok', ""]), (broken, ["two\nlines", "x"])):
        target = str(tmp_path / f"{source.stem}-jsonl")
        csv.csv_to_jsonl(spark, str(source), target)
        assert [r[0] for r in spark.read.json(target).orderBy("id").select("text").collect()] == texts


def test_layout_prunes_days_and_spreads_a_hot_cell(spark):
    start = ts("2025-01-01 00:00:00")
    df = spark.range(4000).select(
        F.lit("e").alias("enodeb_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("cell_id"),
        (F.lit(start) + F.make_interval(mins=F.col("id").cast("int"))).cast("timestamp").alias("measurement_end"),
    )
    path = scratch_path(spark, "layout")
    # So little data would be put back into one file per day.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    layout.write_partitioned(df, "measurement_end", ["enodeb_id", "cell_id"], path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    day = layout.read_days(spark, path, "2025-01-02", "2025-01-02")
    assert day.count() == 1440 and layout.read_days(spark, path).count() == 4000
    assert "PartitionFilters: [isnotnull(date" in day._jdf.queryExecution().executedPlan().toString()
    hot_files = day.where("cell_id = 'hot'").select(F.col("_metadata.file_name")).distinct().count()
    assert hot_files > 1


def stream_source(spark, parts):
    path = scratch_path(spark, "stream")
    schema = "enodeb_id string, cell_id string, measurement_end timestamp, erab_success_rate double, retainability double"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        yield path, spark.createDataFrame([], schema).schema


def test_stream_emits_closed_sessions_once_and_drops_late_rows(spark):
    t0 = ts("2025-01-01 00:00:00")

    def row(cell, minutes, value=50.0):
        return ("e", cell, t0 + timedelta(minutes=minutes), value, None)

    parts = [
        [row("a", 0), row("a", 15), row("a", 30), row("b", 0, 99.0), row("a", 600)],
        [row("c", 900), row("a", 45)],  # a:45 is behind the watermark by now
        [row("d", 3000, 99.0)],
    ]
    target, checkpoint = scratch_path(spark, "found"), scratch_path(spark, "checkpoint")
    seen = []
    for path, schema in stream_source(spark, parts):
        stream = spark.readStream.schema(schema).parquet(path)
        run_detection(stream, target, checkpoint, "1 hour", "2 hours")
        seen.append(rows(spark.read.parquet(target), "cell_id", "started", "ended", "violations"))
    first = ("a", t0, t0 + timedelta(minutes=30), 3)
    assert seen[0] == [first] and first in seen[1] and seen[1].count(first) == 1
    assert seen[2] == [first, ("a", t0 + timedelta(minutes=600), t0 + timedelta(minutes=600), 1),
                       ("c", t0 + timedelta(minutes=900), t0 + timedelta(minutes=900), 1)]


def test_stream_equals_batch_sessions_on_closed_ones(spark):
    from random import Random

    rng = Random(5)
    t0 = ts("2025-01-01 00:00:00")
    part = [("e", f"c{rng.randrange(4)}", t0 + timedelta(minutes=15 * i), rng.choice([50.0, 96.0, 99.0]), rng.choice([1.0, 5.0]))
            for i in range(400)]
    target, checkpoint = scratch_path(spark, "found"), scratch_path(spark, "checkpoint")
    path, schema = next(stream_source(spark, [part]))
    run_detection(spark.readStream.schema(schema).parquet(path), target, checkpoint, "1 hour", "1 hour")
    columns = ["cell_id", "kpi", "started", "ended", "violations", F.round("kpi_value", 6)]
    batch = detection.detect_sessions(spark.read.parquet(path), "1 hour")
    last = max(p[2] for p in part)
    closed = batch.where(F.col("ended") + F.expr("interval 1 hour") <= F.lit(last - timedelta(hours=1)))
    assert rows(spark.read.parquet(target), *columns) == rows(closed, *columns)
    assert closed.count() < batch.count()


def test_kpi_table_follows_its_base(spark):
    base, target, checkpoint = (scratch_path(spark, n) for n in ("base", "kpi", "checkpoint"))
    empty = spark.createDataFrame([], PERFORMANCE)

    def add(cell):
        values = ["e", cell, ts("2025-01-01 00:15:00")] + [
            "text" if f.dataType.typeName() == "string" else 4 for f in PERFORMANCE.fields[3:]
        ]
        spark.createDataFrame([tuple(values)], PERFORMANCE).write.mode("append").parquet(base)

    for n, cell in enumerate(("a", "b"), start=1):
        add(cell)
        maintain_kpi(spark, base, target, checkpoint, empty.schema)
        assert spark.read.parquet(target).count() == n
    maintain_kpi(spark, base, target, checkpoint, empty.schema)
    assert rows(spark.read.parquet(target)) == rows(detection.performance_kpi(spark.read.parquet(base)))
