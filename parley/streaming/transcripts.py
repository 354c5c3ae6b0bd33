"""Structured Streaming over messages: the keyed transcript with its corrections, and the bounded backlog."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from parley.config import DEFAULTS

_ROW = "seq long, first long, said_by string, speaker_id string, lang_code string, transcript string, translation string, reason string, raw string, answered boolean"
CHANGES = "session_id long, sentence_id long, version long, seq long, speaker_id string, lang_code string, transcript string, translation string, reason string, raw string, answered boolean, relabelled boolean"
OUTCOMES = "session_id long, sentence_id long, reason string"
EVICTED, ENDED = "evicted: too many waiting", "the session ended first"


_CHANGE = Row(*(c.split()[0] for c in CHANGES.split(", ")))


class TranscriptFold(StatefulProcessor):
    """The state of one session: a map of its newest sentences, read and written by the ones that a batch names, and their ids in order of
    appearance. Without a time to live the ids tell what the map holds, so that it is not asked for others: each question is a call to the
    state store's process, and a session has few rows in a batch, as plain rows that need no frame of their own."""

    def __init__(self, keep: int, ttl_ms: int | None):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("sentences", "sentence_id long", _ROW, self.ttl_ms)
        self.line = handle.getListState("line", "sentence_id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        part = sorted(rows, key=lambda m: (m.seq is None, m.seq or 0))
        # what the batch has read or changed; None stands for an id that is not known, or no more
        now, changed, gone = {}, {}, set()
        line, ended = [s for (s,) in self.line.get()], False
        before, held = list(line), set(line)

        def holds(sid):
            return sid in held if self.ttl_ms is None else self.known.containsKey((sid,))

        def row(sid):
            if sid not in now:
                now[sid] = list(self.known.getValue((sid,))) if not ended and holds(sid) else None
            return now[sid]

        def told(sid, version):
            r = now[sid]
            # as in the batch form: a relabelling from or to a null speaker is none
            moved = r[2] is not None and r[3] is not None and r[2] != r[3]
            return _CHANGE(key[0], sid, version, r[0], *r[3:], moved)

        out = []
        for m in part:
            if m.kind == "bye":
                out += [told(sid, version) for sid, version in changed.items()]
                now, changed, gone, line, ended = {}, {}, set(), [], True
                continue
            if m.kind == "speakers":
                for sid, label in dict(m.labels or {}).items():
                    if sid.isascii() and sid.isdigit() and row(int(sid)) is not None:
                        one = now[int(sid)]
                        one[3], changed[int(sid)] = one[2] if label is None else label, m.seq
                continue
            if m.kind not in ("final", "translation") or m.sentence_id is None:
                continue
            sid = m.sentence_id
            old = row(sid)
            if m.kind == "final":
                rest = old[6:] if old else [None, None, None, False]
                now[sid] = [m.seq, old[1] if old else m.seq, m.speaker_id, m.speaker_id, m.lang_code, m.transcript, *rest]
                if old is None:
                    line.append(sid)
            elif old is not None:
                old[6:] = [m.translation, m.reason, m.raw, True]
            else:
                continue
            changed[sid] = m.seq
            gone.discard(sid)
            for old_id in line[: -self.keep]:
                if old_id in changed:
                    out.append(told(old_id, changed.pop(old_id)))
                now[old_id] = None
                gone.add(old_id)
            line = line[-self.keep :]
        if ended:
            self.known.clear()
            self.line.clear()
        for sid, version in changed.items():
            self.known.updateValue((sid,), tuple(now[sid]))
            out.append(told(sid, version))
        for sid in gone if not ended else ():
            if holds(sid):
                self.known.removeKey((sid,))
        if line and (ended or line != before):
            self.line.put([(s,) for s in line])
        yield from out

    def close(self) -> None:
        pass


def fold_stream(messages: DataFrame, keep: int = DEFAULTS.rows_kept, ttl_ms: int | None = None) -> DataFrame:
    """fold_messages for a stream of messages: every batch gives the new state of each sentence that it changed.

    version is the seq of the last message behind a row, so a sink that keeps the row of the largest version per
    (session_id, sentence_id), as sinks.upsert_transcript does, holds the transcript; rows with relabelled are the
    corrections of speakers. Batches of a session arrive in order, and seq orders the rows of one. Messages for
    unknown sentences, of null ids and of other kinds change nothing. The state of a session is bounded: the keep sentences that appeared last
    are known, an older one is told a last time if the batch changed it, and what comes for it later is for an unknown one; so the newest keep
    rows of the sink are those of the batch form. A bye ends the session and clears its state, and so does ttl_ms of processing time without
    a change to a sentence, for that sentence (None: never). Needs the RocksDB state store.
    """
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    own = messages.select("session_id", "seq", "kind", "sentence_id", "speaker_id", "lang_code", "transcript", "translation", "reason", "raw", "labels")
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return own.groupBy("session_id").transformWithState(TranscriptFold(keep, ttl_ms), StructType.fromDDL(CHANGES), "Append", mode)


class Backlog(StatefulProcessor):
    """The state of one session: the newest sentences that wait, depth at most, oldest first."""

    def __init__(self, depth: int, idle_ms: int | None):
        self.depth, self.idle_ms = depth, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "sentence_id long")

    def _told(self, key, out):
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["session_id", "sentence_id", "reason"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("seq", kind="stable")
        queue, out = [s for (s,) in self.waiting.get()] if self.waiting.exists() else [], []
        for kind, sid in zip(part["kind"], part["sentence_id"], strict=True):
            if kind == "bye":
                out += [(s, ENDED) for s in queue]
                queue = []
            elif kind == "answer":
                queue = [s for s in queue if s != sid]
            elif kind == "job":
                queue.append(int(sid))
                out += [(s, EVICTED) for s in queue[: -self.depth]]
                queue = queue[-self.depth :]
        if queue:
            self.waiting.put([(s,) for s in queue])
        else:
            self.waiting.clear()
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if queue:
                self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(s, ENDED) for (s,) in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        yield from self._told(key, out)

    def close(self) -> None:
        pass


def backlog_stream(events: DataFrame, depth: int = DEFAULTS.backlog, idle_ms: int | None = None) -> DataFrame:
    """(session_id, sentence_id, reason) of sentences that nobody will answer, of a stream of (session_id, seq, kind, sentence_id).

    kind job puts a sentence on the session's backlog, of which the oldest is evicted beyond depth; answer takes it off; bye
    ends the session, and so does idle_ms without a message (None: never): what waits then is told, once. Other kinds
    do nothing. Batches of a session arrive in order, and seq orders the rows of one. Needs the RocksDB state store.
    """
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    own = events.select("session_id", "seq", "kind", "sentence_id")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return own.groupBy("session_id").transformWithStateInPandas(Backlog(depth, idle_ms), StructType.fromDDL(OUTCOMES), "Append", mode)
