"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.functions.text import html_title
from cellwarden.operators import (
    actions,
    analysis,
    detection,
    documents,
    embedding,
    incidents,
    report,
    rules,
    search,
    similarity,
    text_index,
    traces,
    uplink,
)
from cellwarden.plans import detect, rca
from cellwarden.schemas import CELL_TRACES, PERFORMANCE
from cellwarden.session import configure, cut_lineage, scratch_path
from cellwarden.sources import csv, layout, versions
from cellwarden.sources import case_state as case_files
from cellwarden.sources import rules as rule_files
from cellwarden.streaming import kpi as kpi_stream
from cellwarden.streaming import session_state
from cellwarden.streaming import sessions as session_stream
from workload.views import derived, table

GAP = "2 days"
DELAY = "1 day"
# Levels that the test data reaches; the built-in ones are covered by the unit tests.
SEVERITY_RULES = (
    analysis.SeverityRule("erab_success_rate", None, "lt", 50.0, "HIGH"),
    analysis.SeverityRule("retainability", None, "gt", 40.0, "HIGH"),
    analysis.SeverityRule("retainability", "uplink_rssi", "lt", -116.0, "MEDIUM"),
    analysis.SeverityRule("retainability", "uplink_rssi", "gt", -112.0, "HIGH"),
)
CONDITIONS = tuple(
    c._replace(threshold=20.0) if c.metric == "security_failure_pct" else c
    for c in analysis.CONDITIONS
)
CUTOFF, LIKELY = 1.2, 1.1


def plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone and doubles to six digits, for comparison."""
    columns = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            col = col.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType):
            col = F.round(col, 6)
        columns.append(col.alias(f.name))
    return df.select(columns)


def rounded_kpis(df: DataFrame) -> DataFrame:
    """KPI values to six digits, so that texts made from them are the same everywhere."""
    value = F.transform(
        "kpi_missed",
        lambda m: F.struct(m["kpi"].alias("kpi"), F.round(m["value"], 6).alias("value")),
    )
    return df.withColumn("kpi_missed", value)


def kpi_text(col: str = "kpi_missed"):
    return report.missed_kpi_text(F.col(col)).alias(col)


# --- inputs ----------------------------------------------------------------------------------


def performance(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, "performance")


def kpis(spark: SparkSession, sf: str) -> DataFrame:
    return detection.performance_kpi(performance(spark, sf))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The incident table: detected once and written, as the analysis reads it from storage."""
    return cut_lineage(rounded_kpis(detect.potential_incidents(performance(spark, sf))))


def kpi_value():
    return F.col("kpi_missed")[0]["value"]


def kpi_name():
    return F.col("kpi_missed")[0]["kpi"]


def cell_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents with one and with two missed KPIs."""
    found = candidates(spark, sf)
    single = found.select("incident_id", "kpi_missed")
    both = found.groupBy(F.concat("enodeb_id", F.lit("/"), "cell_id").alias("incident_id")).agg(
        F.array_sort(F.flatten(F.collect_list("kpi_missed"))).alias("kpi_missed")
    )
    return single.unionByName(both)


def measured(spark: SparkSession, sf: str) -> DataFrame:
    found = candidates(spark, sf)
    cases = rca.measured_cases(
        found,
        derived(spark, sf, "rules"),
        derived(spark, sf, "cell_traces"),
        performance(spark, sf),
        derived(spark, sf, "cell_config"),
    )
    for name in ("uplink_rssi", "security_failure_pct", "pZeroNominalPucch_deviation", "pZeroNominalPusch_deviation"):
        cases = cases.withColumn(name, F.round(name, 6))
    return cases


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embedded incidents with the columns of the prior-incident report."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("incident_id"),
        F.col("embedding").alias("events_embeddings"),
        F.concat(F.lit("events of "), F.col("vec_id").cast("string")).alias("events"),
        F.when(F.col("label") % 3 == 0, F.concat(F.lit("analysis "), F.col("label").cast("string")))
        .when(F.col("label") % 3 == 1, "")
        .alias("final_analysis"),
        F.concat(F.lit("cause "), F.col("label").cast("string")).alias("cause"),
        F.lit(None).cast("string").alias("resolution"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def answer_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with a stored document, a web page and a chunk of neither kind, where present."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    pages = table(spark, sf, "pages").select("page_id", "url", html_title(F.col("html")).alias("title"))
    web = F.when(
        F.col("url").isNotNull(), F.struct(F.col("url").alias("uri"), F.col("title").alias("title"))
    )
    stored = F.when(
        F.col("source").isNotNull(),
        F.struct(F.col("doc_id").cast("string").alias("document_name"), F.col("source").alias("text")),
    )
    no_web = F.lit(None).cast("struct<uri:string,title:string>")
    no_context = F.lit(None).cast("struct<document_name:string,text:string>")
    return docs.join(pages, docs.doc_id == pages.page_id, "full").select(
        F.coalesce("doc_id", "page_id").alias("case_id"),
        F.array(
            F.struct(web.alias("web"), no_context.alias("retrieved_context")),
            F.struct(no_web.alias("web"), no_context.alias("retrieved_context")),
            F.struct(no_web.alias("web"), stored.alias("retrieved_context")),
        ).alias("chunks"),
    )


# --- sources and sinks -----------------------------------------------------------------------


def _csv_round_trip(spark: SparkSession, rows: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """Write as CSV with other column order and an unknown column, then load by name."""
    path = scratch_path(spark, name)
    texts = [
        F.date_format(f.name, csv.TIMESTAMP_PATTERN).alias(f.name)
        if isinstance(schema[f.name].dataType, T.TimestampType)
        else F.col(f.name)
        for f in reversed(rows.schema.fields)
    ]
    rows.select(F.lit("ignored").alias("unknown"), *texts).write.option("header", True).csv(path)
    return plain(csv.load_csv_by_name(spark, path, schema))


def load_performance(spark, sf):
    return _csv_round_trip(spark, performance(spark, sf), PERFORMANCE, "performance-csv")


def load_cell_traces(spark, sf):
    return _csv_round_trip(spark, derived(spark, sf, "cell_traces"), CELL_TRACES, "traces-csv")


def csv_to_jsonl(spark, sf):
    source, target = scratch_path(spark, "conversations-csv"), scratch_path(spark, "conversations-jsonl")
    rows = table(spark, sf, "conversations")
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(source)
    csv.csv_to_jsonl(spark, source, target)
    return spark.read.schema("conv_id string, turn string, role string, text string").json(target)


def load_rules(spark, sf):
    path = scratch_path(spark, "rule-files")
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("rule-"), F.col("s_suppkey").cast("string")).alias("rule_id"),
        F.col("s_name").alias("description"),
        F.when(F.col("s_acctbal") > 0, F.array(F.lit("retainability"), F.lit("erab_success_rate")))
        .otherwise(F.array(F.lit("erab_success_rate"))).alias("kpi_missed"),
        F.concat(F.lit('check "'), F.col("s_name"), F.lit('"')).alias("processing_rule"),
        F.array(F.lit("get_uplink_rssi_level")).alias("processing_rule_tools"),
        F.lit("2025-12-26 08:30:00").cast("timestamp").alias("creation_date"),
        (F.col("s_nationkey") > 10).alias("is_current"),
    )
    rule_files.write_rules(rows, path)
    loaded = rule_files.load_rules(spark, path)
    return plain(
        loaded.select(
            "rule_id", "description", F.array_join("kpi_missed", ",").alias("kpi_missed"), "processing_rule",
            F.array_join("processing_rule_tools", ",").alias("processing_rule_tools"),
            "severity_determination_rule", "creation_date", "is_current",
        )
    )


def _rule_tables(spark, sf):
    existing = table(spark, sf, "supplier").select(
        F.concat(F.lit("rule-"), F.col("s_suppkey").cast("string")).alias("rule_id"), F.col("s_name").alias("description")
    )
    incoming = table(spark, sf, "customer").select(
        F.concat(F.lit("rule-"), F.col("c_custkey").cast("string")).alias("rule_id"), F.col("c_name").alias("description")
    )
    return existing, incoming


def insert_rules(spark, sf):
    return incidents.insert_new(*_rule_tables(spark, sf), "rule_id")


def upsert_rules(spark, sf):
    return incidents.upsert(*_rule_tables(spark, sf), "rule_id")


def get_incident(spark, sf):
    found = candidates(spark, sf)
    twice = found.unionByName(found.where(kpi_value() > 60))
    unknown = table(spark, sf, "customer").select(F.col("c_name").alias("incident_id"))
    ids = found.select("incident_id").unionByName(unknown)
    return plain(incidents.get_incidents(twice, ids).withColumn("kpi_missed", kpi_text()))


def create_incidents(spark, sf):
    found = candidates(spark, sf)
    approved = found.where(detection.overshoot(F.col("kpi_missed")) > 0.4)
    existing = found.where(kpi_value() > 60)
    created = incidents.create_incidents(found, approved, existing)
    return plain(
        created.withColumn("kpi_missed", kpi_text())
        .withColumn("embedding_size", F.size("events_embeddings"))
        .drop("events_embeddings", "created_ts")
    )


def upsert_rules_files(spark, sf):
    """The same upsert on a versioned table, of which only touched files are rewritten."""
    existing, incoming = _rule_tables(spark, sf)
    root = scratch_path(spark, "rule-table")
    versions.create_table(existing, root, "rule_id")
    incidents.upsert_stored(spark, root, incoming, "rule_id")
    return versions.read_table(spark, root)


def update_incidents(spark, sf):
    found = candidates(spark, sf)
    current = incidents.create_incidents(found, found)
    return _stored_and_failed(*incidents.update_incidents(current, _results(found)))


def update_incidents_files(spark, sf):
    """The same update on a versioned incident table."""
    found = candidates(spark, sf)
    root = scratch_path(spark, "incident-table")
    versions.create_table(incidents.create_incidents(found, found), root, "incident_id")
    failed = incidents.store_results(spark, root, _results(found))
    return _stored_and_failed(versions.read_table(spark, root), failed)


def _results(found):
    empty = F.array().cast("array<double>")
    return found.select(
        "incident_id",
        F.concat(F.lit("report on "), "description").alias("report"),
        F.lit("HIGH").alias("severity"),
        report.missed_kpi_text(F.col("kpi_missed")).alias("events"),
        F.when(kpi_value() > 60, F.array(kpi_value(), F.lit(1.0)))
        .when(kpi_value() > 40, empty).alias("events_embeddings"),
    )


def _stored_and_failed(updated, failed):
    stored = updated.select(
        "incident_id", "status", "preliminary_analysis", "severity", "events",
        F.size("events_embeddings").alias("embedding_size"), F.lit(None).cast("string").alias("error"),
    )
    none = F.lit(None).cast("string")
    errors = failed.select(
        "incident_id", "status", none.alias("preliminary_analysis"), none.alias("severity"),
        none.alias("events"), F.lit(None).cast("int").alias("embedding_size"), F.col("description").alias("error"),
    )
    return stored.unionByName(errors)


def insert_incidents_default(spark, sf):
    """Incidents inserted by name without ``created_ts`` and the embedding, which get the table's defaults."""
    name = f"incidents_{uuid.uuid4().hex}"
    incidents.create_table(spark, name, scratch_path(spark, "incident-table"))
    found = candidates(spark, sf).select("incident_id", "start_ts", "end_ts", "status", "description", "enodeb_id", "cell_id")
    incidents.append_to_table(found, name)
    age = F.unix_seconds(F.current_timestamp()) - F.unix_seconds("created_ts")
    return plain(
        spark.table(name).select(
            *found.columns, F.size("events_embeddings").alias("embedding_size"), age.between(0, 3600).alias("created_now"),
            F.col("severity").isNull().alias("no_severity"),
        )
    )


def case_state(spark, sf):
    """Cases to JSON and back: texts of newer writers with one more field, and texts cut off where the value is above 60."""
    cases = candidates(spark, sf)
    texts = case_files.write_state(cases)
    more = F.concat(F.expr("substr(state, 1, length(state) - 1)"), F.lit(',"shift":{"name":"night","from":22}}'))
    value = F.get_json_object("state", "$.kpi_missed[0].value").cast("double")
    sent = texts.withColumn("state", F.when(value > 60, F.expr("substr(state, 1, length(state) - 3)")).when(value > 40, more).otherwise(F.col("state")))
    read = case_files.read_state(sent, cases.schema)
    again = case_files.read_state(case_files.write_state(read.where("damaged is null")), cases.schema)
    back = again.unionByName(read.where("damaged is not null"))
    return plain(
        back.withColumn("kpi_missed", kpi_text()).withColumn("unknown", F.to_json("unknown"))
        .withColumn("damaged", F.col("damaged").isNotNull())
    )


def cell_trace_levels(spark, sf):
    """Traces in buckets by cell meet the configuration of their cell without being shuffled."""
    rows = derived(spark, sf, "cell_traces")
    cells = ["start_enodeb_id", "start_cell_id"]
    name = f"traces_{uuid.uuid4().hex}"
    table_ = layout.write_bucketed(rows, name, cells, ["starttime"], scratch_path(spark, "buckets"))
    config = derived(spark, sf, "cell_config").select(
        F.col("enodeb_id").alias("start_enodeb_id"), F.col("cell_id").alias("start_cell_id"), "pZeroNominalPucch"
    )
    joined = table_.join(config.hint("merge"), cells)
    return joined.groupBy(*cells, "pZeroNominalPucch").agg(F.count("*").alias("traces"), F.max("starttime").cast("timestamp_ntz").alias("last_start"))


def layout_partitioned(spark, sf):
    path = scratch_path(spark, "traces")
    rows = derived(spark, sf, "cell_traces")
    layout.write_partitioned(rows, "starttime", ["start_enodeb_id", "start_cell_id"], path)
    return plain(layout.read_days(spark, path, "2024-01-05", "2024-01-25"))


def refresh_kpi_view(spark, sf):
    source, target, checkpoint = (scratch_path(spark, n) for n in ("performance", "kpi", "kpi-checkpoint"))
    rows = performance(spark, sf)
    rows.write.parquet(source)
    kpi_stream.maintain_kpi(spark, source, target, checkpoint, rows.schema)
    return plain(spark.read.parquet(target))


def merge_kpi_view(spark, sf):
    """Base files with wrong session times where the level is even, then files that correct and repeat them, and replays."""
    source, root = scratch_path(spark, "performance"), scratch_path(spark, "kpi-table")
    rows = performance(spark, sf)
    wrong = F.when(F.col("UL_RSSI") % 2 == 0, F.col("ERAB_SessionTimeUE") + 7).otherwise(F.col("ERAB_SessionTimeUE"))
    rows.withColumn("ERAB_SessionTimeUE", wrong).write.parquet(source)
    kpi_stream.merge_kpi(spark, source, root, scratch_path(spark, "merge-checkpoint"), rows.schema)
    rows.write.mode("append").parquet(source)
    for _ in range(2):  # a new checkpoint replays every file
        kpi_stream.merge_kpi(spark, source, root, scratch_path(spark, "merge-checkpoint"), rows.schema)
    return plain(versions.read_table(spark, root).drop(kpi_stream.MEASUREMENT))


# --- KPIs and detection ----------------------------------------------------------------------


def erab_success_rate(spark, sf):
    value = detection.erab_success_rate().alias("erab_success_rate")
    return plain(performance(spark, sf).select("enodeb_id", "cell_id", "measurement_end", value))


def retainability(spark, sf):
    value = detection.retainability().alias("retainability")
    return plain(performance(spark, sf).select("enodeb_id", "cell_id", "measurement_end", value))


def performance_kpi(spark, sf):
    return plain(kpis(spark, sf))


def missed_kpis(spark, sf):
    return plain(detection.missed_kpis(kpis(spark, sf)))


def detect_incidents(spark, sf):
    return plain(detection.detect_incidents(kpis(spark, sf)))


def incident_candidates(spark, sf):
    found = detection.incident_candidates(detection.detect_incidents(kpis(spark, sf)))
    return plain(
        found.select("*", kpi_name().alias("kpi"), kpi_value().alias("kpi_value")).drop("kpi_missed")
    )


def prioritize_incidents(spark, sf):
    found = candidates(spark, sf)
    cases = found.withColumn("uplink_rssi", F.lit(None).cast("double"))
    levels = analysis.classify_severity(cases, SEVERITY_RULES).select(
        "incident_id", F.col("severity_level").alias("severity")
    )
    ranked = detection.prioritize_incidents(found, levels)
    return plain(ranked.select("incident_id", "severity", "overshoot", "priority"))


def detect_incidents_sessions(spark, sf):
    return plain(detection.detect_sessions(kpis(spark, sf), GAP))


def detect_incidents_stream(spark, sf):
    source, target, checkpoint = (scratch_path(spark, n) for n in ("performance", "incidents", "incidents-checkpoint"))
    rows = performance(spark, sf)
    rows.write.parquet(source)
    stream = detection.performance_kpi(spark.readStream.schema(rows.schema).parquet(source))
    session_stream.run_detection(stream, target, checkpoint, GAP, DELAY)
    return plain(spark.read.parquet(target))


#: Earlier measurements arrive after the later ones have moved the watermark beyond them.
LATE_BEFORE = "2024-01-10"


def detect_incidents_state(spark, sf):
    """Closed and open sessions and late rows, in three runs from one checkpoint; the last one brings nothing new."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("performance", "sessions", "sessions-checkpoint"))
    rows = performance(spark, sf)
    late = F.col("measurement_end") < F.lit(LATE_BEFORE).cast("timestamp")
    for part in (rows.where(~late), rows.where(late), None):
        if part is not None:
            part.write.mode("append").parquet(source)
        stream = detection.performance_kpi(spark.readStream.schema(rows.schema).parquet(source))
        session_state.run_sessions(stream, target, checkpoint, GAP, DELAY)
    return plain(session_state.read_sessions(spark, target))


# --- rules, traces, uplink -------------------------------------------------------------------


def match_rules(spark, sf):
    return rules.match_rules(cell_incidents(spark, sf), derived(spark, sf, "rules")).select(
        "incident_id", "rule_id", "processing_rule"
    )


def collect_rule_tools(spark, sf):
    found = rules.collect_rules(cell_incidents(spark, sf), derived(spark, sf, "rules"))
    lists = [c for c in found.columns if c not in ("incident_id", "rules_status", "matched_rules")]
    return found.select("incident_id", "rules_status", *[F.array_join(c, ";").alias(c) for c in lists])


def gate_tools(spark, sf):
    found = rules.collect_rules(cell_incidents(spark, sf), derived(spark, sf, "rules"))
    return found.select(
        "incident_id",
        F.array_join(rules.gate_tools(F.col("processing_rule_tools")), ";").alias("analysis_tools"),
        F.array_join(rules.gate_tools(F.col("severity_determination_rule_tools")), ";").alias("severity_tools"),
    )


def cell_trace_stats(spark, sf):
    return _stats(candidates(spark, sf), spark, sf)


def _stats(found, spark, sf):
    return traces.cell_trace_stats(found, derived(spark, sf, "cell_traces"))


def cell_trace_stats_sweep(spark, sf):
    """The same statistics over the day-partitioned traces, with windows and traces met by the sweep."""
    path = scratch_path(spark, "traces")
    layout.write_partitioned(derived(spark, sf, "cell_traces"), "starttime", ["start_enodeb_id", "start_cell_id"], path)
    return traces.cell_trace_stats(candidates(spark, sf), spark.read.parquet(path), max_broadcast_rows=0)


def outcome_share(spark, sf):
    return plain(traces.outcome_share(cell_trace_stats(spark, sf)))


def security_failure_devices(spark, sf):
    return traces.failing_devices(candidates(spark, sf), derived(spark, sf, "cell_traces"))


def uplink_rssi(spark, sf):
    return plain(uplink.uplink_rssi(candidates(spark, sf), performance(spark, sf)))


def uplink_configuration(spark, sf):
    found = candidates(spark, sf).select("incident_id", "enodeb_id", "cell_id")
    return uplink.uplink_configuration(found, derived(spark, sf, "cell_config"))


def rssi_out_of_range(spark, sf):
    levels = uplink.uplink_rssi(candidates(spark, sf), performance(spark, sf))
    return plain(levels.withColumn("out_of_range", uplink.rssi_out_of_range(F.col("uplink_rssi"))))


def config_deviation(spark, sf):
    return plain(uplink.config_deviation(uplink_configuration(spark, sf)))


def analyze_incidents(spark, sf):
    cases = analysis.analyze_incidents(measured(spark, sf), CONDITIONS)
    causes = F.array_join(F.transform("findings", lambda f: f["cause"]), ";").alias("causes")
    asking = F.array_join(F.transform("findings", lambda f: F.array_join(f["rules"], ",")), ";").alias("asking_rules")
    return cases.select("incident_id", causes, asking, "analysis")


def classify_severity(spark, sf):
    cases = analysis.classify_severity(measured(spark, sf), SEVERITY_RULES)
    return cases.select("incident_id", "severity_level", "severity_level_explanation")


def _acting(spark, sf):
    """Cases with an executed action from before where the KPI value is above 35."""
    done = F.struct(
        F.lit("open_ticket").alias("tool_name"), F.lit("call drops").alias("reason_to_perform"),
        F.lit(None).cast("map<string,string>").alias("parameters"), F.lit("EXECUTED").alias("status"),
    )
    earlier = F.when(kpi_value() > 35, F.array(done))
    return actions.suggest_actions(measured(spark, sf).withColumn("actions", earlier))


def suggest_actions(spark, sf):
    named = F.transform("actions", lambda a: F.concat_ws(
        "/", a["tool_name"], a["status"], a["parameters"]["enodeb_id"], a["parameters"]["cell_id"]))
    return _acting(spark, sf).select("incident_id", F.array_join(named, ";").alias("actions"))


def split_actions(spark, sf):
    listed = actions.split_actions(_acting(spark, sf))
    cell = F.concat_ws("/", F.col("parameters")["enodeb_id"], F.col("parameters")["cell_id"])
    return listed.withColumn("parameters", cell)


def actions_toolset(spark, sf):
    found = actions.actions_toolset(_acting(spark, sf))
    return found.select("incident_id", F.array_join("action_tools", ";").alias("action_tools"))


def issue_adjustments(spark, sf):
    cases = _acting(spark, sf)
    cell = F.create_map(F.lit("cell_id"), "cell_id", F.lit("enodeb_id"), "enodeb_id")
    approved = cases.where(kpi_value() < 40).select("incident_id", F.lit(actions.ADJUST).alias("tool_name"), cell.alias("parameters"))
    other = F.create_map(F.lit("cell_id"), F.lit("another"), F.lit("enodeb_id"), "enodeb_id")  # no action has these parameters
    approved = approved.unionByName(cases.where(kpi_value() >= 40).select("incident_id", F.lit(actions.ADJUST).alias("tool_name"), other.alias("parameters")))
    return actions.issue_adjustments(cases, approved)


# --- similarity ------------------------------------------------------------------------------


def embed_events(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    embedded = embedding.embed_texts(docs, "text")
    exploded = embedded.select("doc_id", F.posexplode_outer("embedding").alias("dim", "weight"))
    return plain(exploded.where("weight is null or weight <> 0"))


def nonempty_embeddings(spark, sf):
    base = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(base, "doc_id", "left")
    filled = docs.withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))
    kept = similarity.nonempty_embeddings(filled, "embedding")
    return kept.select("doc_id", "lang", F.size("embedding").alias("dim"))


def _nearest(spark, sf, **options):
    known = vectors(spark, sf)
    return similarity.vector_topk(known, known, **options)


def vector_topk(spark, sf):
    near = similarity.with_incident_columns(_nearest(spark, sf), vectors(spark, sf), ["events", "cause"])
    return plain(near)


def distance_cutoff(spark, sf):
    return plain(similarity.distance_cutoff(_nearest(spark, sf, exclude_self=True), CUTOFF))


def match_label(spark, sf):
    return plain(similarity.match_label(_nearest(spark, sf, exclude_self=True), LIKELY))


def vector_topk_lsh(spark, sf):
    return plain(_nearest(spark, sf, exclude_self=True, method="lsh"))


def format_prior_incidents(spark, sf):
    near = similarity.distance_cutoff(_nearest(spark, sf, exclude_self=True), CUTOFF)
    matches = similarity.match_label(near.withColumn("distance", F.round("distance", 6)), LIKELY)
    full = similarity.with_incident_columns(
        matches, vectors(spark, sf), ["events", "final_analysis", "cause", "resolution"]
    )
    blocks = similarity.format_prior_incidents(full, vectors(spark, sf))
    return blocks.withColumn("prior_incidents", F.array_join("prior_incidents", "\n"))


def prior_incidents(spark, sf):
    """The whole similar-incident step: event log, embedding, nearest logs, text blocks."""
    cases = embedding.embed_texts(
        measured(spark, sf).select("incident_id", "events"), "events", out="events_embeddings"
    )
    unknown = F.lit(None).cast("string")
    known = cut_lineage(cases).withColumns({c: unknown for c in ("final_analysis", "cause", "resolution")})
    found = rca.prior_incidents(known, known, likely=0.4, exclude_self=True)
    return found.withColumn("prior_incidents", F.array_join("prior_incidents", "\n"))


# --- documents and report --------------------------------------------------------------------


def search_rules(spark, sf):
    """Documents play the rules; the rule text is returned by its length."""
    store = table(spark, sf, "documents").select(
        F.col("doc_id").alias("rule_id"),
        F.col("source").alias("description"),
        F.col("text").alias("processing_rule"),
        F.array(F.col("lang"), F.lit("get_uplink_rssi_level")).alias("processing_rule_tools"),
        F.concat(F.lit("grade "), F.col("lang")).alias("severity_determination_rule"),
    )
    found = search.search_rules(store, questions(spark, sf))
    return plain(found.withColumn("processing_rule", F.length("processing_rule")))


_indexes: dict[tuple[str, str], text_index.TextIndex] = {}


def document_index(spark: SparkSession, sf: str) -> text_index.TextIndex:
    """The index of the documents' texts, written by the first query of a session that needs it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = text_index.scratch_index(table(spark, sf, "documents"), "doc_id", "text")
    return _indexes[key]


def passages(spark, sf):
    docs, asked = table(spark, sf, "documents"), questions(spark, sf)
    found = search.text_search(docs, asked, 5, index=document_index(spark, sf))
    return search.passages(found, docs, search.query_terms(asked)).drop("score")


def snippets(spark, sf):
    docs, asked = table(spark, sf, "documents"), questions(spark, sf)
    found = search.text_search(docs, asked, 5, index=document_index(spark, sf))
    return search.snippets(found, docs, asked).select("query_id", "doc_id", "rank", "snippet")


def spell_correct(spark, sf):
    asked = search.vocabulary(table(spark, sf, "conversations"))
    return search.spell_correct(asked, search.vocabulary(table(spark, sf, "benchmark")))


def expand_query(spark, sf):
    parts = table(spark, sf, "part")
    terms = search.query_terms(parts.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query")))
    words = F.filter(F.split("p_name", " "), lambda w: w != "")
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("term"),
                         F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("related"))
    return search.expand_query(terms, parts.select(F.inline(pairs)))


def expand_query_mined(spark, sf):
    """Questions widened by terms that the documents' texts show near theirs."""
    related = search.mine_related(table(spark, sf, "documents"), cut=0.5)
    return search.expand_query(search.query_terms(questions(spark, sf)), related)


def mine_related(spark, sf):
    return plain(search.mine_related(table(spark, sf, "documents"), cut=0.5))


def _references_text(col: str = "references"):
    lines = F.transform(col, lambda r: F.concat(r["url"], F.lit(" "), r["title"]))
    return F.array_join(lines, "\n").alias(col)


def _retrieved(found: DataFrame) -> DataFrame:
    return found.select("incident_id", F.array_join("queries", ";").alias("queries"), _references_text(), "search_result")


def internal_docs(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("source", "title")
    return _retrieved(documents.retrieve_docs(candidates(spark, sf), docs, index=document_index(spark, sf)))


def external_docs(spark, sf):
    pages = table(spark, sf, "pages")
    allow = pages.where(F.col("url").contains(".example.com/")).select("url")
    return _retrieved(documents.retrieve_pages(candidates(spark, sf), pages, allow))


def extract_references(spark, sf):
    found = answer_chunks(spark, sf).select("case_id", documents.extract_references(F.col("chunks")).alias("r"))
    return found.select("case_id", F.posexplode_outer("r").alias("position", "reference")).select(
        "case_id", "position", "reference.url", "reference.title"
    )


def grounding_gate(spark, sf):
    """Part keys beyond the documents and pages are answers without any chunk."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"))
    chunks = answer_chunks(spark, sf).join(parts, "case_id", "full")
    cases = chunks.withColumn("references", documents.extract_references(F.col("chunks")))
    answer = F.concat(F.lit("answer "), F.col("case_id").cast("string"))
    gated = documents.grounding_gate(answer, F.col("references"), documents.NO_INTERNAL)
    return cases.select("case_id", gated.alias("answer"), F.size("references").alias("n_references"))


def append_section(spark, sf):
    log = table(spark, sf, "conversations").withColumn("events", F.when(F.col("turn") > 0, F.col("text")).otherwise(""))
    grown = report.append_section(log, "Role", F.col("role"))
    return grown.select("conv_id", "turn", "events")


def general_info_section(spark, sf):
    info = report.general_info(F.col("kpi_missed"), F.col("start_ts"), F.col("end_ts"))
    return candidates(spark, sf).select("incident_id", info.alias("general_info"))


def trace_section(spark, sf):
    found = candidates(spark, sf)
    return report.trace_section(found, _stats(found, spark, sf))


def build_report(spark, sf):
    cases = analysis.analyze_incidents(measured(spark, sf), CONDITIONS)
    cases = analysis.classify_severity(actions.suggest_actions(cases), SEVERITY_RULES)
    docs = table(spark, sf, "documents").withColumnRenamed("source", "title")
    internal = documents.retrieve_docs(cases, docs, index=document_index(spark, sf)).select(
        "incident_id", F.struct("search_result", "references").alias("internal_search_results")
    )
    return report.build_report(cases.join(internal, "incident_id", "left")).select("incident_id", "report")


def analyse_incidents(spark, sf):
    """The whole analysis: measured cases, findings, severity, similar incidents, both kinds of documents, actions and report."""
    docs = table(spark, sf, "documents").withColumnRenamed("source", "title")
    pages = table(spark, sf, "pages")
    cases = rca.analyse_incidents(
        candidates(spark, sf), derived(spark, sf, "rules"), derived(spark, sf, "cell_traces"), performance(spark, sf),
        derived(spark, sf, "cell_config"), None, docs, pages, pages.where(F.col("url").contains(".example.com/")).select("url"),
        likely=0.4, exclude_self=True, digits=6, conditions=CONDITIONS, severity_rules=SEVERITY_RULES, index=document_index(spark, sf),
    )
    return cases.select("incident_id", "severity", "events", F.size("events_embeddings").alias("embedding_size"), "report")


NAMES = """
load_performance load_cell_traces csv_to_jsonl load_rules insert_rules upsert_rules upsert_rules_files get_incident
create_incidents update_incidents update_incidents_files layout_partitioned refresh_kpi_view merge_kpi_view
erab_success_rate retainability performance_kpi missed_kpis detect_incidents incident_candidates
prioritize_incidents detect_incidents_sessions detect_incidents_stream detect_incidents_state
match_rules collect_rule_tools gate_tools cell_trace_stats cell_trace_stats_sweep outcome_share security_failure_devices
uplink_rssi uplink_configuration rssi_out_of_range config_deviation analyze_incidents
classify_severity suggest_actions split_actions actions_toolset issue_adjustments
embed_events nonempty_embeddings vector_topk distance_cutoff match_label vector_topk_lsh
format_prior_incidents prior_incidents
search_rules snippets passages spell_correct expand_query internal_docs external_docs extract_references
grounding_gate append_section general_info_section trace_section build_report
insert_incidents_default case_state cell_trace_levels mine_related expand_query_mined analyse_incidents
""".split()


def _prepared(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


QUERIES = {name: _prepared(globals()[name]) for name in NAMES}