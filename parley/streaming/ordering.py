"""Rows of a session in the order of their event time, whatever the order in which they arrive."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Buckets that the sessions of a stream are dealt to.
BUCKETS = 1_024


def _plain(x):
    """A value as state holds it: no numpy type, and None for what is missing."""
    if isinstance(x, np.ndarray | np.generic):
        x = x.tolist()
    return None if x is None or x is pd.NA or x is pd.NaT else x


class State:
    """A named state of one session while its rows are taken: a row, or the rows of a list."""

    now = None

    def exists(self) -> bool:
        return self.now is not None

    def get(self):
        return self.now

    def update(self, row) -> None:
        self.now = tuple(map(_plain, row))

    def put(self, rows) -> None:
        self.now = [tuple(map(_plain, r)) for r in rows]

    def clear(self) -> None:
        self.now = None


class States:
    """The named states of a session, by the calls of a StatefulProcessorHandle."""

    def __init__(self):
        self.held: list[State] = []

    def getValueState(self, name: str, schema: str) -> State:
        self.held.append(State())
        return self.held[-1]

    getListState = getValueState

    def load(self, row: tuple | None) -> None:
        for s, x in zip(self.held, row or [None] * len(self.held), strict=True):
            s.now = x

    def row(self) -> tuple | None:
        """None if nothing is held."""
        out = tuple(s.now for s in self.held)
        return None if all(x is None for x in out) else out


class InOrder:
    """Gives take() the rows of a session sorted by (at, tie).

    With waits, a row is kept in the session's state until the watermark has passed its event time, when no earlier one can come any
    more; one event-time timer for each bucket, at its earliest row, wakes it. What is kept is bounded by how far rows may be out of
    order. A row that comes when the watermark has passed it is left out, as its place is gone, and counted by late(). Without, batches
    arrive in order and the rows of a batch are sorted.

    The state store holds the open sessions of a bucket as one value, which comes and goes with the rows of a batch: a session costs no
    call of its own, of which there were ten and more in each batch.
    """

    #: Columns that take() gets, as DDL of types without a comma.
    fields = ""
    #: Columns of what take() gives.
    schema = ""
    waits = False

    def start(self, states: States) -> None:
        """Opens the state of take()."""

    def take(self, key, rows: list[tuple]) -> Iterator[list[tuple]]:
        raise NotImplementedError

    def late(self, key, n: int) -> Iterator[list[tuple]]:
        """What is told of n rows that came too late."""
        yield from ()

    def batch(self, key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The rows of a bucket of sessions in a batch, or none when its timer has come."""
        if pd.isna(key[0]):
            # a clock row: it moves the watermark and belongs to no session
            return
        # session -> (rows that wait, sorted; the states of take)
        sessions = pickle.loads(state.get[0]) if state.exists else {}
        names = ["session_id", "at", "tie", *(f.split()[0] for f in self.fields.split(", "))]
        got, out = {}, []
        if not state.hasTimedOut:
            for part in parts:
                for session, *row in zip(*(map(_plain, part[c]) for c in names), strict=True):
                    got.setdefault(session, []).append(tuple(row))
        mark_ms = state.getCurrentWatermarkMs() if self.waits else 0
        due = [s for s, (held, _) in sessions.items() if s not in got and held and held[0][0] < mark_ms * 1000]
        states = States()
        self.start(states)
        for session in [*got, *due]:
            rows, (held, row) = got.get(session, []), sessions.pop(session, ([], None))
            if self.waits:
                on_time = [r for r in rows if r[0] >= mark_ms * 1000]
                if len(on_time) < len(rows):
                    out += chain.from_iterable(self.late((session,), len(rows) - len(on_time)))
                rows = held + on_time
            rows.sort(key=lambda r: r[:2])
            n = bisect_left(rows, mark_ms * 1000, key=lambda r: r[0]) if self.waits else len(rows)
            if n:
                states.load(row)
                out += chain.from_iterable(self.take((session,), [r[2:] for r in rows[:n]]))
                row = states.row()
            if row is not None or rows[n:]:
                sessions[session] = rows[n:], row
        if sessions:
            state.update((pickle.dumps(sessions),))
        elif state.exists:
            state.remove()
        first = min((held[0][0] for held, _ in sessions.values() if held), default=None)
        if first is not None:
            # it goes off when the watermark is above it, and has to be above the watermark
            state.setTimeoutTimestamp(max(first // 1000, mark_ms + 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.schema.split(", ")], dtype=object)


def in_order(rows: DataFrame, processor: InOrder, ts: str | None = None, late: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The stream of what processor makes of the rows of each session_id, in order.

    ts and late: the event time, and how far a row may be behind the latest one of the stream; rows farther behind are left out. Without ts the rows have seq, and batches of a session arrive in order. tie, if there is such a
    column, orders rows of one time. A row of null session_id moves the watermark only. Sessions are dealt to buckets by a hash; as the number of
    open sessions grows, so should that of buckets, since a bucket that gets a row is read and written as a whole.
    """
    own = rows if "tie" in rows.columns else rows.withColumn("tie", F.lit(0).cast("long"))
    names = [f.split()[0] for f in processor.fields.split(", ")]
    processor.waits = ts is not None
    at = F.col("seq").cast("long")
    if ts is not None:
        own = own.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
        at = F.unix_micros("_ts")
    bucket = F.when(F.col("session_id").isNotNull(), F.pmod(F.xxhash64("session_id"), F.lit(buckets)))
    own = own.select(*["_ts"][: ts is not None], "session_id", at.alias("at"), F.col("tie").cast("long").alias("tie"), *names, bucket.alias("_bucket"))
    return own.groupBy("_bucket").applyInPandasWithState(processor.batch, processor.schema, "sessions binary", "append", "NoTimeout" if ts is None else "EventTimeTimeout")


def event_time(session_start, at_ms):
    """The event time of a position: where the session began, and how much of it had been received. Never the wall clock."""
    return F.timestamp_micros((F.unix_micros(session_start.cast("timestamp")) + at_ms * 1000).cast("long"))
