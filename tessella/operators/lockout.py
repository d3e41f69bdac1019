"""Account lockout as a state machine over logins (ANA24), shared with its streaming twin (STR5)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "event_id long, user_id long, failures int, ignored boolean, locked_until timestamp_ntz"


class State(NamedTuple):
    """Failed logins since the last success, until when (microseconds) the account is locked, and when the last login was."""

    failures: int = 0
    until: int | None = None
    seen: int | None = None


def attempt(state: State, at: int, ok: bool, most: int, minutes: int, forget: int | None = None) -> tuple[State, bool]:
    """The state after a login, and whether it was ignored because the account is locked; the count outlives the lock.

    After ``forget`` microseconds without a login, and outside a lock, nothing is known of a user.
    """
    if state.until is not None and state.until > at:
        return state._replace(seen=at), True
    if forget and state.seen is not None and at >= state.seen + forget:
        state = State()
    if ok:
        return State(seen=at), False
    failures = state.failures + 1
    return State(failures, at + minutes * 60_000_000 if failures >= most else state.until, at), False


def lockout_replay(logins: DataFrame, most: int = 5, minutes: int = 30, forget_days: int | None = None) -> DataFrame:
    """ANA24: (event_id, user_id, failures, ignored, locked_until) after each (event_id, user_id, ts, ok) login.

    Logins come by user and time and are read in a stream: a task holds one user's state, not the user's logins. A null ok counts
    as failed. ``forget_days`` after a user's last login its count starts anew.
    """
    forget = forget_days and forget_days * 86_400_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, state = None, State()
        for batch in batches:
            out = []
            for event, who, at, ok in zip(*(c.to_pylist() for c in batch.columns)):
                if who != user:
                    user, state = who, State()
                state, ignored = attempt(state, at, bool(ok), most, minutes, forget)
                out.append((event, who, state.failures, ignored, state.until))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.timestamp("us"))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in RESULT.split(", ")])

    rows = logins.select("event_id", F.col("user_id").cast("long").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "ok")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInArrow(run, RESULT)
