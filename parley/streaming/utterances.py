"""Live frames, utterances and running text: what reframe, build_utterances and partial_ticks give in batch, from keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.config import DEFAULTS
from parley.operators.utterances import tail_window
from parley.streaming.ordering import InOrder, States, in_order

FRAMES = "session_id long, frame_idx long, pcm binary"
SPOKEN = "session_id long, kind string, idx long, tick int, start_ms double, end_ms double, reason string, continues_previous boolean"


class FrameCutter(InOrder):
    """The state of one session: the bytes of its unfinished frame, fewer than a frame, and the number of the next one."""

    fields = "pcm binary, ended boolean"

    def __init__(self, frame_bytes: int, pad_tail: bool, key_type: str):
        self.frame_bytes, self.pad_tail, self.schema = frame_bytes, pad_tail, FRAMES.replace("session_id long", f"session_id {key_type}")

    def start(self, states: States) -> None:
        self.rest = states.getValueState("rest", "pcm binary, next long")

    def take(self, key, rows: list[tuple]) -> Iterator[list[tuple]]:
        rest, nxt = self.rest.get() if self.rest.exists() else (b"", 0)
        held, out, ended = bytearray(rest), [], False
        for pcm, end in rows:
            held += pcm or b""
            full = len(held) // self.frame_bytes * self.frame_bytes
            for at in range(0, full, self.frame_bytes):
                out.append((key[0], nxt, bytes(held[at : at + self.frame_bytes])))
                nxt += 1
            del held[:full]
            ended = bool(end)
            if ended:
                if held and self.pad_tail:
                    out.append((key[0], nxt, bytes(held).ljust(self.frame_bytes, b"\0")))
                held, nxt = bytearray(), 0
        if ended:
            self.rest.clear()
        else:
            self.rest.update((bytes(held), nxt))
        yield out


def frame_stream(chunks: DataFrame, frame_bytes: int = 1024, pad_tail: bool = False, ts: str | None = None, late: str | None = None) -> DataFrame:
    """reframe for a stream of chunks (session_id, seq, pcm, and ended, if there is such a column): (session_id, frame_idx, pcm).

    A frame comes out with the chunk that completes it; what is left of a chunk is carried to the next batch. ended forgets the session, with a
    last frame filled with zero bytes if pad_tail. Null chunks are empty. ts and late as in in_order. Needs the RocksDB state store.
    """
    own = chunks if "ended" in chunks.columns else chunks.withColumn("ended", F.lit(False))
    cutter = FrameCutter(frame_bytes, pad_tail, dict(chunks.dtypes)["session_id"])
    return in_order(own, cutter, ts, late)


class Speech(InOrder):
    """The state of one session: run lengths of the hysteresis, the powers of the last frames before a segment, and those of the open
    utterance, which is cut at the length limit, so that neither grows with the session."""

    fields, schema = "prob double, power double, ended boolean", SPOKEN

    def __init__(self, threshold: float, neg: float, n_open: int, n_close: int, pad: int, limit: int, search: int, frame_ms: float, step_ms: float):
        self.threshold, self.neg, self.n_open, self.n_close, self.pad = threshold, neg, n_open, n_close, pad
        self.limit, self.search, self.frame_ms, self.step_ms = limit, search, frame_ms, step_ms

    def start(self, states: States) -> None:
        self.run = states.getValueState("run", "high long, low long, open boolean, closed long, next long, before array<double>, start long, idx long, continues boolean, ticks long")
        self.power = states.getListState("power", "power double")

    def late(self, key, n: int) -> Iterator[list[tuple]]:
        yield [(key[0], "late", None, n, None, None, None, None)]

    def take(self, key, rows: list[tuple]) -> Iterator[list[tuple]]:
        high, low, is_open, closed, nxt, before, start, idx, continues, ticks = self.run.get() if self.run.exists() else (0, 0, False, 0, 0, [], 0, 0, False, 0)
        before = list(before)
        power = [p for (p,) in self.power.get()] if is_open and self.power.exists() else []
        out = []

        def tell(kind: str, frames: int, reason: str | None = None, tick: int | None = None) -> None:
            out.append((key[0], kind, idx, tick, start * self.frame_ms, (start + frames) * self.frame_ms, reason, continues if reason else None))

        def commit(frames: int, reason: str) -> None:
            nonlocal start, idx, power, ticks
            if frames:
                tell("utterance", frames, reason)
                idx += 1
            start, power, ticks = start + frames, power[frames:], 0

        def grow(p: float) -> None:
            nonlocal continues, ticks
            power.append(p)
            while len(power) >= self.limit:
                quiet = max(0, self.limit - self.search)
                commit(quiet + int(np.argmin(power[quiet : self.limit])) + 1, "max_duration")
                continues = True
            while (ticks + 1) * self.step_ms <= len(power) * self.frame_ms:
                ticks += 1
                out.append((key[0], "partial", idx, ticks, start * self.frame_ms, start * self.frame_ms + ticks * self.step_ms, None, None))

        for prob, level, ended in rows:
            if ended:
                if is_open:
                    commit(len(power), "end_of_stream")
                high, low, is_open, closed, nxt, before, start, idx, continues, ticks = 0, 0, False, 0, 0, [], 0, 0, False, 0
                continue
            high, low = (high + 1 if prob >= self.threshold else 0), (low + 1 if prob < self.neg else 0)
            if not is_open and high >= self.n_open:
                back = min(self.pad, nxt - closed)
                is_open, start, continues, ticks, power = True, nxt - back, False, 0, []
                for p in before[len(before) - back :]:
                    grow(p)
                grow(level)
            elif is_open and low >= self.n_close:
                commit(len(power), "pause")
                is_open, closed, power = False, nxt, []
            elif is_open:
                grow(level)
            before = [*before, level][-self.pad :] if self.pad else []
            nxt += 1
        if rows and rows[-1][2]:
            self.run.clear()
            self.power.clear()
        else:
            self.run.update((high, low, is_open, closed, nxt, before, start, idx, continues, ticks))
            if power:
                self.power.put([(p,) for p in power])
            else:
                self.power.clear()
        yield out


def speech_stream(frames: DataFrame, threshold: float = DEFAULTS.threshold, neg: float = DEFAULTS.neg_threshold, n_open: int = DEFAULTS.open_frames, n_close: int = DEFAULTS.close_frames, pad: int = DEFAULTS.pad_frames, limit: int = 218, search: int = 15, frame_ms: float = DEFAULTS.frame_ms, every_ms: int = DEFAULTS.partial_every_ms, chunk_ms: int = DEFAULTS.chunk_ms, ts: str | None = None, late: str | None = None) -> DataFrame:
    """Utterances and running text of a stream of frames (session_id, seq, prob, power, ended), as they become known.

    Rows of kind utterance are those of build_utterances; they come out with the frame that closes them, or that fills them up to limit frames, when
    they are cut after the quietest of the last search ones. Rows of kind partial say how far the open utterance has grown, every
    every_ms on the grid of chunks: (idx, tick, start_ms, end_ms), before it is known where the utterance ends. A row
    with ended closes what is open and forgets the session, as nothing else of it is kept. Rows that came too late are told as kind late, with
    their number as tick. ts and late as in in_order.
    Needs the RocksDB state store.
    """
    if neg > threshold:
        raise ValueError("neg must not be above threshold")
    own = frames if "ended" in frames.columns else frames.withColumn("ended", F.lit(False))
    step = -(-every_ms // chunk_ms) * chunk_ms
    return in_order(own, Speech(threshold, neg, n_open, n_close, pad, limit, search, float(frame_ms), float(step)), ts, late)


def spoken(events: DataFrame) -> DataFrame:
    """The utterances of speech_stream, with the columns of build_utterances."""
    return events.where("kind = 'utterance'").select("session_id", "idx", "start_ms", "end_ms", "reason", "continues_previous")


def running_text(events: DataFrame, seconds: float = DEFAULTS.partial_window_ms / 1000) -> DataFrame:
    """(session_id, idx, tick, at_ms, tail_ms): when the running text of the open utterance is due, and where its window of the last seconds begins."""
    return events.where("kind = 'partial'").select("session_id", "idx", "tick", F.col("end_ms").alias("at_ms"), tail_window(F.col("start_ms"), F.col("end_ms"), seconds).alias("tail_ms"))
