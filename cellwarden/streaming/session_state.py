"""Incidents from a stream with explicit state: open ones are emitted and revised, closed by timers, late rows kept apart.

The state of a cell holds the open sessions of its KPIs, not their rows. Every change of a session is emitted with its number and the next
revision; a timer in event time closes it ``gap`` after its last violation. A row more than ``delay`` behind the newest of the stream
at the start of its micro-batch is late: it changes no session and is emitted as it is. Late rows would be dropped by the watermark's
filter; they reach the state because the time is passed on as a plain number beside the watermark.

Each micro-batch writes a folder of its own and replaces it when it runs again, so a restart from the checkpoint doubles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellwarden.operators.detection import CELL, KPI_RULES, SERIES, KpiRule, describe, missed_kpis

# Fixed value: the state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, CLOSED, MERGED, LATE = "open", "closed", "merged", "late"
_SESSION = "number: int, revision: long, started: long, ended: long, total: double, violations: long"
_SERIES = f"series array<struct<kpi: string, next: int, sessions: array<struct<{_SESSION}>>>>"
_CHANGES = "enodeb_id string, cell_id string, kpi string, number int, revision long, status string, started long, ended long, kpi_value double, violations long"
_CHANGE = Row(*[c.split()[0] for c in _CHANGES.split(", ")])


class SessionProcessor(StatefulProcessor):
    """Open sessions of one cell by KPI; times are microseconds.

    Each call to the state crosses from Python to the JVM, so a cell has one value, read and written once, and one timer, for the
    session that can close first.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", _SERIES)

    def close(self) -> None:
        pass

    def _load(self) -> dict[str, tuple[int, list[tuple]]]:
        """Next number and open sessions of each KPI."""
        stored = self.series.get()
        return {kpi: (following, [tuple(s) for s in sessions]) for kpi, following, sessions in stored[0]} if stored else {}

    def _store(self, series: dict[str, tuple[int, list[tuple]]]) -> None:
        self.series.update(([(kpi, *held) for kpi, held in series.items()],))

    def _due(self, series: dict[str, tuple[int, list[tuple]]]) -> int | None:
        """First millisecond at which a session has ended ``gap`` ago."""
        ends = [s[3] for _, sessions in series.values() for s in sessions]
        return -(-(min(ends) + self.gap) // 1000) if ends else None

    @staticmethod
    def _row(key: tuple, kpi: str, session: tuple, status: str) -> Row:
        number, revision, started, ended, total, n = session
        return _CHANGE(*key, kpi, number, revision, status, started, ended, total / n, n)

    def _extend(self, before: list[tuple], following: int, found: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """Open sessions after the violations ``found``, and those that became part of another one."""
        fresh = [(following + n, 0, at, at, value, 1) for n, (at, value) in enumerate(found)]
        merged: list[tuple] = []
        for s in sorted(before + fresh, key=lambda s: (s[2], s[0])):
            if merged and s[2] - merged[-1][3] <= self.gap:
                last = merged[-1]
                merged[-1] = (min(last[0], s[0]), max(last[1], s[1]), last[2], max(last[3], s[3]), last[4] + s[4], last[5] + s[5])
            else:
                merged.append(s)
        kept = {s[0] for s in merged}
        known = {s[0]: s for s in before}
        changed = [s if known.get(s[0]) == s else (s[0], s[1] + 1, *s[2:]) for s in merged]
        return changed, [s for s in before if s[0] not in kept]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        found: dict[str, list[tuple]] = {}
        for kpi, at, value in sorted((r["kpi"], int(r["at"]), float(r["kpi_value"])) for r in rows):
            if at < watermark:
                yield _CHANGE(*key, kpi, -1, 0, LATE, at, at, value, 1)
            else:
                found.setdefault(kpi, []).append((at, value))
        if not found:
            return
        series = self._load()
        due = self._due(series)
        for kpi, points in found.items():
            following, before = series.get(kpi, (0, []))
            changed, gone = self._extend(before, following, points)
            yield from (self._row(key, kpi, (s[0], s[1] + 1, *s[2:]), MERGED) for s in gone)
            known = set(before)
            yield from (self._row(key, kpi, s, OPEN) for s in changed if s not in known)
            series[kpi] = (following + len(points), changed)
        self._store(series)
        self._move_timer(due, self._due(series))

    def _move_timer(self, before: int | None, after: int | None) -> None:
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        series = self._load()
        for kpi, (following, before) in series.items():
            done = [s for s in before if s[3] + self.gap <= watermark]
            yield from (self._row(key, kpi, (s[0], s[1] + 1, *s[2:]), CLOSED) for s in done)
            series[kpi] = (following, [s for s in before if s[3] + self.gap > watermark])
        self._store(series)
        # The timer that fired is deleted after this call; what is still open is due later.
        self._move_timer(None, self._due(series))


def session_changes(kpis: DataFrame, gap: str, delay: str, rules: Sequence[KpiRule] = KPI_RULES) -> DataFrame:
    """Every change of a session, and late rows, of a stream of KPI values."""
    at = F.unix_micros("measurement_end").alias("at")  # a plain number, to which the watermark's filter does not apply
    found = missed_kpis(kpis.withWatermark("measurement_end", delay), rules).select(*SERIES, at, "kpi_value")
    width = int(kpis.sparkSession.sql(f"select unix_micros(timestamp_seconds(0) + interval {gap})").first()[0])
    return found.groupBy(*CELL).transformWithState(SessionProcessor(width), _CHANGES, "Update", "EventTime")


def run_sessions(
    kpis: DataFrame, target: str, checkpoint: str, gap: str, delay: str, rules: Sequence[KpiRule] = KPI_RULES
) -> None:
    """Process everything available and write the changes of each micro-batch to a folder below ``target``."""
    spark = kpis.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    try:
        query = (
            session_changes(kpis, gap, delay, rules)
            .writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)


def read_sessions(spark: SparkSession, target: str, rules: Sequence[KpiRule] = KPI_RULES) -> DataFrame:
    """The newest state of every session (open or closed) and all late rows, with their descriptions."""
    changes = spark.read.schema(f"{_CHANGES}, batch int").parquet(target)
    newest = Window.partitionBy(*SERIES, "number").orderBy(F.col("revision").desc())
    sessions = (
        changes.where(F.col("status") != LATE).withColumn("_place", F.row_number().over(newest))
        .where("_place = 1").drop("_place").where(F.col("status") != MERGED)
    )
    both = sessions.unionByName(changes.where(F.col("status") == LATE))
    times = {c: F.timestamp_micros(c) for c in ("started", "ended")}
    return describe(both.withColumns(times), rules).select(
        *CELL, "description", "kpi", "status", "kpi_value", "started", "ended", "violations"
    )
