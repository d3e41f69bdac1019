"""Live operators that keep state for each key (STR2, STR5): typed, bounded, and cleared by timers in event time.

State is held by RocksDB, on disk and in the checkpoint, so it may outgrow memory; a query that is started again on its checkpoint
goes on where it stopped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lockout import State, attempt

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000  # in microseconds

EVENTS = "kind string, event_id long, user_id long, at long, failures int, ignored boolean"
SUMMARY = "metric string, n long, min double, max double, avg double, latest double, first_at long, latest_at long"


def use_rocks(spark: SparkSession) -> None:
    """Have the session's streams keep their state in RocksDB, which state with timers needs; streams that run already keep theirs."""
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)


class Lockouts(StatefulProcessor):
    """A user's failed logins and lock, and the logins that wait until nothing earlier can come."""

    def __init__(self, most: int, minutes: int, forget: int | None) -> None:
        self.most, self.minutes, self.forget = most, minutes, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", "failures int, until long, seen long")
        self.pending = handle.getMapState("pending", "ms long", "logins array<struct<at: long, event_id: long, ok: boolean>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            ms = r.at // 1000
            held = self.pending.getValue((ms,)) if self.pending.containsKey((ms,)) else None
            self.pending.updateValue((ms,), ([*(tuple(x) for x in held[0]), (r.at, r.event_id, r.ok)] if held else [(r.at, r.event_id, r.ok)],))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms, user = expiredTimerInfo.getExpiryTimeInMs(), key[0]
        state = State(*self.account.get()) if self.account.exists() else State()
        before = state
        if self.pending.containsKey((ms,)):
            logins = sorted(tuple(x) for x in self.pending.getValue((ms,))[0])
            self.pending.removeKey((ms,))
            for at, event, ok in logins:
                if state.until is not None and state.until <= at:
                    yield Row(kind="unlocked", event_id=None, user_id=user, at=state.until, failures=state.failures, ignored=None)
                    state = state._replace(until=None)
                state, ignored = attempt(state, at, bool(ok), self.most, self.minutes, self.forget)
                yield Row(kind="login", event_id=event, user_id=user, at=at, failures=state.failures, ignored=ignored)
        if state.until is not None and state.until // 1000 <= ms:
            yield Row(kind="unlocked", event_id=None, user_id=user, at=state.until, failures=state.failures, ignored=None)
            state = state._replace(until=None)
        if self.forget and state.seen is not None and state.until is None and (state.seen + self.forget) // 1000 <= ms:
            self.account.clear()
        elif state != before:
            self.account.update(tuple(state))
            if state.until is not None and state.until != before.until:
                self.handle.registerTimer(state.until // 1000)
            if self.forget and state.seen != before.seen:
                if before.seen is not None:
                    old = (before.seen + self.forget) // 1000
                    if not self.pending.containsKey((old,)) and (state.until is None or state.until // 1000 != old):
                        self.handle.deleteTimer(old)
                self.handle.registerTimer((state.seen + self.forget) // 1000)

    def close(self) -> None:
        pass


def lockouts(logins: DataFrame, most: int = 5, minutes: int = 30, late: str = "10 minutes", forget_days: int | None = None) -> DataFrame:
    """STR5: of (event_id, user_id, ts, ok) logins a row for each, and one when a lock ends: (kind, event_id, user_id, at, failures, ignored).

    Logins are taken in the order of their time: each waits in the state until the watermark, ``late`` behind the newest login,
    has passed it, so the outcome is that of ``lockout_replay`` in whatever order they arrive; what comes later than that is dropped by
    the watermark. A user's state is three numbers and the waiting logins; ``forget_days`` after the last login it is cleared
    (the counter with it). ``at`` is in microseconds. Append mode. Rows without a user or time are left out.
    """
    use_rocks(logins.sparkSession)
    rows = logins.where("user_id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select(F.col("user_id").cast("long").alias("user_id"), "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("user_id").transformWithState(Lockouts(most, minutes, forget_days and forget_days * DAY), EVENTS, "Append", "EventTime")


def newest(points: Iterator[tuple[int, float]], keep: int, retention: int) -> list[tuple[int, float]]:
    """The newest ``keep`` of (at, value) points, of those not older than ``retention`` before the newest; oldest first."""
    found = sorted(heapq.nlargest(keep, points))
    return [p for p in found if p[0] > found[-1][0] - retention]


class History(StatefulProcessor):
    """A metric's newest points."""

    def __init__(self, keep: int, retention: int) -> None:
        self.keep, self.retention = keep, retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "at long, value double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = [tuple(p) for p in self.points.get()] if self.points.exists() else []

        def every() -> Iterator[tuple[int, float]]:
            yield from old
            for r in rows:
                yield r.at, r.value

        kept = newest(every(), self.keep, self.retention)
        self.points.put(kept)
        if not old or kept[-1][0] != old[-1][0]:
            if old:
                self.handle.deleteTimer((old[-1][0] + self.retention) // 1000)
            self.handle.registerTimer((kept[-1][0] + self.retention) // 1000)
        values = [v for _, v in kept]
        yield Row(metric=key[0], n=len(kept), min=min(values), max=max(values), avg=sum(values) / len(values), latest=values[-1], first_at=kept[0][0], latest_at=kept[-1][0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.points.clear()
        yield Row(metric=key[0], n=0, min=None, max=None, avg=None, latest=None, first_at=None, latest_at=None)

    def close(self) -> None:
        pass


def live_history(points: DataFrame, keep: int = 1_000, retention_days: float = 7, late: str = "10 minutes") -> DataFrame:
    """STR2: of (metric, value, ts) points a summary of each metric's newest ``keep`` whenever some come: (metric, n, min, max, avg, latest, first_at, latest_at).

    Points older than ``retention_days`` before the metric's newest are gone, and when the watermark passes the newest by as much
    so is the metric: a row of n = 0 says so, and its state is cleared. A task holds ``keep`` points of one metric, however
    many come. Update mode. Rows without a metric, value or time are left out. ``newest_points`` gives the same over a table.
    """
    use_rocks(points.sparkSession)
    rows = points.where("metric is not null and value is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("metric", F.col("value").cast("double").alias("value"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("metric").transformWithState(History(keep, int(retention_days * DAY)), SUMMARY, "Update", "EventTime")
