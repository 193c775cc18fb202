import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cellwarden.operators import detection as d
from cellwarden.schemas import ERAB_ATTEMPTS, ERAB_RELEASES, ERAB_SUCCESSES
from tests.conftest import rows, ts

DAY0 = ts("2025-01-01 00:15:00")


def counters(spark, cases):
    """Rows of (attempts, successes, releases, session time); the first counter holds the sum."""
    names = ERAB_ATTEMPTS + ERAB_SUCCESSES + ERAB_RELEASES + ["ERAB_SessionTimeUE"]
    schema = "enodeb_id string, cell_id string, measurement_end timestamp, " + ", ".join(f"{n} long" for n in names)
    data = []
    for i, (att, succ, rel, time) in enumerate(cases):
        spread = []
        for total in (att, succ, rel):
            spread += [total] + [0] * 8
        data.append(("e1", f"c{i}", DAY0, *spread, time))
    return spark.createDataFrame(data, schema)


def kpi_frame(spark, data):
    return spark.createDataFrame(
        data, "enodeb_id string, cell_id string, measurement_end timestamp, erab_success_rate double, retainability double"
    )


def test_kpi_values_and_missing_denominators(spark):
    frame = counters(spark, [(200, 190, 7, 1000), (0, 0, 1, 10), (10, 10, 1, 0), (None, 1, 1, 10), (10, 9, None, 10)])
    found = rows(d.performance_kpi(frame), "cell_id", "erab_success_rate", "retainability")
    assert found == sorted(
        [
            ("c0", 95.0, pytest.approx(25.2)),
            ("c1", None, 360.0),
            ("c2", 100.0, None),
            ("c3", None, 360.0),
            ("c4", 90.0, None),
        ],
        key=lambda r: r[0],
    )


def test_value_on_the_threshold_and_null_are_no_violations(spark):
    frame = kpi_frame(
        spark,
        [("e", "on", DAY0, 97.0, 3.0), ("e", "off", DAY0, 96.9, 3.1), ("e", "null", DAY0, None, None)],
    )
    found = rows(d.missed_kpis(frame), "cell_id", "kpi", "kpi_value")
    assert found == [("off", "erab_success_rate", 96.9), ("off", "retainability", 3.1)]


def test_detection_equals_cross_join_form(spark):
    rng = random.Random(3)
    frame = kpi_frame(
        spark,
        [
            (f"e{rng.randrange(3)}", f"c{rng.randrange(4)}", DAY0 + timedelta(minutes=15 * i),
             rng.choice([None, 50.0, 96.5, 97.0, 99.0]), rng.choice([None, 1.0, 3.0, 3.25, 8.0]))
            for i in range(300)
        ],
    )
    frame.createOrReplaceTempView("kpis")
    d.kpi_meta(spark).createOrReplaceTempView("meta")
    expected = spark.sql(
        """
        select enodeb_id, cell_id, kpi, description, min(measurement_end) started, max(measurement_end) ended,
               avg(case kpi when 'erab_success_rate' then erab_success_rate else retainability end) kpi_value
        from kpis cross join meta
        where case kpi when 'erab_success_rate' then erab_success_rate < 97 when 'retainability' then retainability > 3 end
        group by all"""
    )
    columns = ["enodeb_id", "cell_id", "kpi", "description", "started", "ended"]
    assert rows(d.detect_incidents(frame), *columns) == rows(expected, *columns)
    mean = F.round("kpi_value", 9)
    assert rows(d.detect_incidents(frame), "cell_id", "enodeb_id", "kpi", mean) == rows(expected, "cell_id", "enodeb_id", "kpi", mean)


def test_single_interval_incident_and_stable_ids(spark):
    frame = kpi_frame(spark, [("e", "c", DAY0, 10.0, 0.0)])
    first = d.incident_candidates(d.detect_incidents(frame)).first()
    again = d.incident_candidates(d.detect_incidents(frame)).first()
    assert first.start_ts == first.end_ts == DAY0
    assert first.incident_id == again.incident_id and len(first.incident_id) == 64
    assert first.status == "NEW" and first.kpi_missed[0].kpi == "erab_success_rate"


def brute_sessions(points, gap):
    sessions = []
    by_series = {}
    for cell, when, value in points:
        by_series.setdefault(cell, []).append((when, value))
    for cell, series in by_series.items():
        series.sort()
        run = [series[0]]
        for point in series[1:]:
            if point[0] - run[-1][0] > gap:
                sessions.append((cell, run))
                run = []
            run.append(point)
        sessions.append((cell, run))
    return sorted((c, r[0][0], r[-1][0], len(r), round(sum(v for _, v in r) / len(r), 6)) for c, r in sessions)


@pytest.mark.parametrize("chunk", ["day", "month"])
@pytest.mark.parametrize("gap", ["30 minutes", "1 day"])
def test_sessions_match_brute_force(spark, chunk, gap):
    """One cell holds most rows, runs cross chunk borders, times repeat, gaps equal the limit."""
    rng = random.Random(11)
    points = []
    for _ in range(1500):
        cell = "hot" if rng.random() < 0.6 else f"c{rng.randrange(5)}"
        when = datetime(2025, 1, 1) + timedelta(minutes=15 * rng.randrange(96 * 90))
        points.append((cell, when, float(rng.randrange(90))))
    start = datetime(2025, 1, 30, 23, 0)
    points += [("across", start + timedelta(minutes=30 * i), 5.0) for i in range(120)]
    frame = kpi_frame(spark, [("e", c, w, v, None) for c, w, v in points])
    limit = timedelta(minutes=30) if gap == "30 minutes" else timedelta(days=1)
    found = rows(
        d.detect_sessions(frame, gap, chunk=chunk).withColumn("kpi_value", F.round("kpi_value", 6)),
        "cell_id", "started", "ended", "violations", "kpi_value",
    )
    assert sorted(found) == brute_sessions(points, limit)


def test_prioritize_orders_by_severity_then_overshoot_then_id(spark):
    data = [(f"i{n:03d}", [("erab_success_rate", float(90 - n % 7))]) for n in range(200)]
    candidates = spark.createDataFrame(data, "incident_id string, kpi_missed array<struct<kpi:string,value:double>>")
    levels = spark.createDataFrame(
        [(f"i{n:03d}", ["HIGH", "MEDIUM", "LOW"][n % 3]) for n in range(150)], "incident_id string, severity string"
    )
    found = {r.incident_id: r.priority for r in d.prioritize_incidents(candidates, levels).collect()}

    def key(n):
        rank = n % 3 if n < 150 else 3
        return (rank, -(97 - (90 - n % 7)) / 97, f"i{n:03d}")

    expected = {f"i{n:03d}": p for p, n in enumerate(sorted(range(200), key=key), start=1)}
    assert found == expected


def test_rules_that_would_go_wrong_are_refused(spark):
    rule = d.KpiRule("erab_success_rate", "lt", 97.0, "low")
    for rules in ([rule, rule._replace(threshold=95.0)], [rule._replace(op="eq")]):
        with pytest.raises(ValueError):
            d.kpi_meta(spark, rules)
