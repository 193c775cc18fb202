import random
import time
from datetime import timedelta

from pyspark.sql import functions as F

from cellwarden.functions.text import bounded_distance, segment_probes, segments
from cellwarden.operators import incidents, search
from cellwarden.operators.detection import KPI_RULES, detect_sessions
from cellwarden.session import scratch_path
from cellwarden.sources import case_state, layout
from cellwarden.streaming import session_state
from tests.conftest import rows, ts

KPIS = "enodeb_id string, cell_id string, measurement_end timestamp, erab_success_rate double, retainability double"


def day(n, hour=0):
    return ts(f"2025-03-{n:02d} {hour:02d}:00:00")


def play(spark, batches, gap="2 days", delay="1 day"):
    """Each batch arrives as a file and is processed by a query of its own from the one checkpoint."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("kpis", "sessions", "checkpoint"))
    for batch in batches:
        if batch:
            spark.createDataFrame([("e", *r, None) for r in batch], KPIS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KPIS).parquet(source)
        session_state.run_sessions(stream, target, checkpoint, gap, delay)
    return target


def test_sessions_are_revised_merged_closed_and_late_rows_kept(spark):
    low = 50.0
    batches = [
        [("c1", day(1), low), ("c1", day(5), low), ("c2", day(6), 99.0)],  # two open sessions; the watermark comes to day 5
        [("c1", day(4), 10.0), ("c1", day(6), low), ("c1", day(7), 30.0)],  # day 4 is late, the others extend
        [("c2", day(20), low)],  # moves the watermark, so all of c1 closes
        [("c2", day(2), 1.0), ("c2", day(19), 10.0)],  # late, and before the open session of c2
        [],  # a restart without anything new
    ]
    target = play(spark, batches)
    found = session_state.read_sessions(spark, target)
    assert rows(found, "cell_id", "status", "started", "ended", "kpi_value", "violations") == sorted([
        ("c1", "closed", day(1), day(1), 50.0, 1), ("c1", "closed", day(5), day(7), 130 / 3, 3),
        ("c1", "late", day(4), day(4), 10.0, 1), ("c2", "late", day(2), day(2), 1.0, 1),
        ("c2", "open", day(19), day(20), 30.0, 2),
    ], key=str)
    changes = spark.read.parquet(target)
    assert changes.where("status = 'open'").count() > found.where("status <> 'late'").count()  # revisions were emitted on the way
    assert found.where(F.col("description") != KPI_RULES[0].description).count() == 0


def test_a_row_between_two_open_sessions_merges_them(spark):
    batches = [[("c1", day(1), 50.0), ("c1", day(4), 50.0)], [("c1", day(3), 50.0)], [("c1", day(2, 12), 50.0), ("c2", day(3), 99.0)]]
    target = play(spark, batches, delay="9 days")
    found = session_state.read_sessions(spark, target)
    assert rows(found, "status", "started", "ended", "violations") == [("open", day(1), day(4), 4)]
    assert spark.read.parquet(target).where("status = 'merged'").count() == 1


def test_a_cell_has_one_timer_and_one_state_value(spark):
    """State calls go through a socket, so their number may not grow with the open sessions."""
    source, target, checkpoint = (scratch_path(spark, n) for n in ("kpis", "sessions", "checkpoint"))
    data = [("e", f"c{c}", day(n), 50.0, 9.0) for c in range(3) for n in range(1, 29, 3)]
    spark.createDataFrame(data, KPIS).write.parquet(source)
    stream = spark.readStream.schema(KPIS).parquet(source)
    session_state.run_sessions(stream, target, checkpoint, "2 days", "60 days")
    found = session_state.read_sessions(spark, target)
    assert rows(found.groupBy("status").count()) == [("open", 60)]
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, session_state.PROVIDER)
    try:
        state = spark.read.format("statestore").option("path", checkpoint)
        timers = state.option("readRegisteredTimers", "true").load().collect()
        assert sorted((t["key"]["cell_id"], t["expiration_timestamp_ms"]) for t in timers) == [
            (f"c{c}", int(day(3).timestamp() * 1000)) for c in range(3)
        ]
        values = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "series").load().count()
    finally:
        spark.conf.set(provider, before)
    assert values == 3


def test_timers_follow_sessions_that_grow_merge_and_close(spark):
    """Rows of two KPIs in any order: the open sessions are those of the batch, and each closes when its time has come."""
    rng = random.Random(3)
    kpis = [(f"c{c}", day(n, rng.randrange(24)), rng.choice([50.0, 99.0]), rng.choice([1.0, 9.0])) for c in range(4) for n in range(1, 25)]
    rng.shuffle(kpis)
    parts = [kpis[i::4] for i in range(4)]
    columns = ["cell_id", "kpi", "started", "ended", "violations", F.round("kpi_value", 6)]
    source, target, checkpoint = (scratch_path(spark, n) for n in ("kpis", "sessions", "checkpoint"))

    def arrive(part):
        spark.createDataFrame([("e", *r) for r in part], KPIS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(KPIS).parquet(source)
        session_state.run_sessions(stream, target, checkpoint, "1 day", "40 days")
        return session_state.read_sessions(spark, target)

    for part in parts:
        found = arrive(part)
        assert rows(found, *columns) == rows(detect_sessions(spark.read.parquet(source), "1 day"), *columns)
        assert found.where("status <> 'open'").count() == 0
    middle = day(13)
    found = arrive([("later", middle + timedelta(days=40), 99.0, 1.0)])  # brings the watermark to ``middle``
    closed = F.col("ended") + F.expr("interval 1 day") <= F.lit(middle)
    assert {"open", "closed"} == {r.status for r in found.collect()}
    assert found.where((F.col("status") == "closed") != closed).count() == 0
    found = arrive([("later", middle + timedelta(days=80), 99.0, 1.0)])
    assert rows(found.select("status").distinct()) == [("closed",)]
    assert rows(found, *columns) == rows(detect_sessions(spark.read.parquet(source), "1 day"), *columns)


# --- JSON case state


CASE = "incident_id string, description string, start_ts timestamp, kpi_missed array<struct<kpi:string,value:double>>, parameters map<string,string>"


def test_case_state_round_trip_and_damage(spark):
    cases = spark.createDataFrame(
        [("a", 'quote " and \n line', day(1), [("k", 1.5)], {"x": "y"}), ("b", None, None, None, None), ("c", "", day(2), [], {})], CASE
    )
    texts = case_state.write_state(cases)
    back = case_state.read_state(texts, cases.schema)
    assert rows(back.drop("unknown", "damaged")) == rows(cases)
    assert back.where("damaged is not null or size(unknown) > 0").count() == 0
    odd = spark.createDataFrame(
        [("d", '{"incident_id":"d","description":'), ("e", None), ("f", "[1]"), ("g", '{"start_ts":"never"}'), ("h", '{"description":"x","new":{"a":[1,null]}}')],
        "incident_id string, state string",
    )
    read = {r.incident_id: r for r in case_state.read_state(odd, cases.schema).withColumn("unknown", F.to_json("unknown")).collect()}
    assert set(read) == {"d", "e", "f", "g", "h"}
    assert read["d"].damaged == '{"incident_id":"d","description":' and read["e"].damaged == "" and read["f"].damaged == "[1]"
    assert read["g"].damaged and read["h"].damaged is None and read["h"].unknown == '{"new":{"a":[1,null]}}'
    sound = case_state.read_state(odd, cases.schema).where("damaged is null")
    again = case_state.read_state(case_state.write_state(sound), cases.schema).withColumn("unknown", F.to_json("unknown"))
    assert again.first().unknown == read["h"].unknown and again.first().description == "x"


# --- tables


def test_bucketed_facts_join_without_an_exchange(spark):
    facts = spark.createDataFrame([("e", f"c{i % 7}", i) for i in range(500)], "enodeb_id string, cell_id string, value long")
    cells = facts.select("enodeb_id", "cell_id").distinct().withColumn("level", F.lit(3))
    name = "bucketed_facts"
    table = layout.write_bucketed(facts, name, ["enodeb_id", "cell_id"], ["value"], scratch_path(spark, "bucketed"))
    try:
        joined = table.join(cells.hint("merge"), ["enodeb_id", "cell_id"]).groupBy("enodeb_id", "cell_id").agg(F.sum("value").alias("s"))
        lines = joined._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, line in enumerate(lines) if name in line)
        join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
        assert "Bucketed: true" in lines[scan] and join < scan
        assert not [line for line in lines[join + 1 : scan] if "Exchange" in line]
        assert [line for line in lines[scan:] if "Exchange" in line]  # the other side is dealt to the buckets
        assert {r["s"] for r in joined.collect()} == {r["s"] for r in facts.groupBy("cell_id").agg(F.sum("value").alias("s")).collect()}
    finally:
        spark.sql(f"drop table {name}")


def test_inserted_incidents_get_the_defaults(spark):
    name = "incidents_with_defaults"
    incidents.create_table(spark, name, scratch_path(spark, "defaults"))
    try:
        some = spark.createDataFrame([("i1", "NEW", "text", day(1))], "incident_id string, status string, description string, start_ts timestamp")
        incidents.append_to_table(some, name)
        given = some.withColumn("incident_id", F.lit("i2")).withColumn("created_ts", F.lit(day(2)))
        incidents.append_to_table(given, name)
        found = {r.incident_id: r for r in spark.table(name).collect()}
        assert found["i1"].created_ts.year >= 2026 and found["i2"].created_ts == day(2)
        assert found["i1"].events_embeddings == [] and found["i1"].severity is None
    finally:
        spark.sql(f"drop table {name}")


# --- spelling and expansion


def test_parts_of_near_terms_meet(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randrange(0, 9)))
        edits = list(word)
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(edits) + 1)
            edits[at : at + rng.randrange(2)] = rng.choices("abcd", k=rng.randrange(2))
        pairs.append((word, "".join(edits)))
    near = spark.createDataFrame(pairs, "a string, b string").where(F.levenshtein("a", "b") <= 2)
    meet = F.arrays_overlap(segment_probes(F.col("a"), 2), segments(F.col("b"), 2))
    assert near.count() > 200 and near.where(~meet).count() == 0


def test_bounded_distance():
    for a, b, most, d in [("", "", 0, 0), ("abc", "abc", 1, 0), ("abc", "axc", 1, 1), ("abcd", "bcde", 1, None), ("abcd", "bcde", 2, 2),
                          ("ab", "", 2, 2), ("ab", "", 1, None), ("kitten", "sitting", 3, 3), ("aa", "aaa", 2, 1), ("abab", "baba", 2, 2)]:
        assert bounded_distance(a, b, most) == bounded_distance(b, a, most) == d


def test_a_very_long_term_is_corrected(spark):
    """The letters of its parts grow with the term's length, not with its square, and its comparison is quick."""
    long = "abcdefghij" * 10_000
    asked = spark.createDataFrame([(long + "x",), ("word",), ("nothing",)], "term string")
    vocab = spark.createDataFrame([(long, 1), ("word", 2), ("ward", 9)], "term string, df long")
    parts = asked.select(F.explode(segment_probes(F.col("term"), 1)).alias("p")).agg(F.sum(F.length("p.letters"))).first()[0]
    assert parts < 20 * len(long)
    start = time.perf_counter()
    assert bounded_distance(long + "x", long, 1) == 1 and bounded_distance("x" + long[1:], long + "y", 2) == 2
    assert time.perf_counter() - start < 1
    found = {r.term: (r.corrected, r.distance) for r in search.spell_correct(asked, vocab).collect()}
    assert found == {long + "x": (long, 1), "word": ("word", 0), "nothing": (None, None)}


def test_related_terms_are_mined(spark):
    text = "uplink rssi low. " * 6 + "the the the cell the rssi "
    docs = spark.createDataFrame([(text,), (None,), ("",), ("alone",)], "text string")
    found = search.mine_related(docs, reach=1, least=5, cut=0.1, k=2)
    assert {(r.term, r.related, r.n) for r in found.collect()} >= {("uplink", "rssi", 6), ("rssi", "low", 6)}
    assert search.mine_related(docs.limit(0)).count() == 0


def test_texts_are_cut_into_tokens_once_for_all_steps(spark, monkeypatch):
    plans, cut = [], search.cut_lineage

    def planned(df, name="step"):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return cut(df, name)

    monkeypatch.setattr(search, "cut_lineage", planned)
    docs = spark.createDataFrame([("a b c a",), ("a b",), ("one",), ("",), (None,)], "text string")
    path = scratch_path(spark, "texts")
    docs.write.parquet(path)
    found = search.mine_related(spark.read.parquet(path), reach=2, least=1, cut=-9.0, k=9)
    assert {(r.term, r.related, r.n) for r in found.collect()} == {
        ("a", "b", 3), ("b", "a", 3), ("a", "c", 2), ("c", "a", 2), ("b", "c", 1), ("c", "b", 1)
    }
    assert [plan.count("regexp_extract_all") for name, plan in plans if name == "pairs"] == [1]
