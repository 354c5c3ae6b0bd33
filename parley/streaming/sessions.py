"""Structured Streaming over sessions: hysteresis with keyed state, backlog, windows and running text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from parley.config import DEFAULTS
from parley.operators.voices import Matcher, assignment_reason
from parley.streaming.ordering import InOrder, States, in_order

EVENTS = "session_id long, kind string, frame long"


class Hysteresis(InOrder):
    """The state of one session: run lengths, whether a segment is open, the last closing frame, and the next frame."""

    fields, schema = "prob double, ended boolean", EVENTS

    def __init__(self, threshold: float, neg: float, n_open: int, n_close: int, pad: int):
        self.threshold, self.neg, self.n_open, self.n_close, self.pad = threshold, neg, n_open, n_close, pad

    def start(self, states: States) -> None:
        self.state = states.getValueState("run", "high long, low long, open boolean, closed long, next long")

    def late(self, key, n: int) -> Iterator[list[tuple]]:
        yield [(key[0], "late", n)]

    def take(self, key, rows: list[tuple]) -> Iterator[list[tuple]]:
        high, low, is_open, closed, nxt = self.state.get() if self.state.exists() else (0, 0, False, 0, 0)
        out = []
        for prob, ended in rows:
            if ended:
                if is_open:
                    out.append(("speech_end", nxt))
                high, low, is_open, closed, nxt = 0, 0, False, 0, 0
                continue
            high, low = (high + 1 if prob >= self.threshold else 0), (low + 1 if prob < self.neg else 0)
            if not is_open and high >= self.n_open:
                is_open = True
                out.append(("speech_start", nxt - min(self.pad, nxt - closed)))
            elif is_open and low >= self.n_close:
                is_open, closed = False, nxt
                out.append(("speech_end", nxt))
            nxt += 1
        if rows and rows[-1][1]:
            self.state.clear()
        else:
            self.state.update((high, low, is_open, closed, nxt))
        yield [(key[0], *told) for told in out]


def segment_stream(frames: DataFrame, threshold: float = DEFAULTS.threshold, neg: float = DEFAULTS.neg_threshold, n_open: int = DEFAULTS.open_frames, n_close: int = DEFAULTS.close_frames, pad: int = DEFAULTS.pad_frames, ts: str | None = None, late: str | None = None) -> DataFrame:
    """Segment events of a stream of frames (session_id, seq or ts, prob, ended), as segment_hysteresis gives them in batch.

    With ts and late, rows may arrive out of order by that much and are put in order by event time (in_order); without, batches of a
    session arrive in order, and seq, then tie (if there is such a column), order the rows of one. Frames are
    counted from 0. Rows that came too late are told as kind late, with their number as frame. A row with ended closes what is open and
    forgets the session. Needs the RocksDB state store.
    """
    if neg > threshold:
        raise ValueError("neg must not be above threshold")
    return in_order(frames, Hysteresis(threshold, neg, n_open, n_close, pad), ts, late)


class VoiceMatcher(StatefulProcessor):
    """The state of one session: the centroids of its speakers, DEFAULTS.max_speakers at most."""

    def __init__(self, options: dict):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("centroids", "centroids array<array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = self.state.get()[0] if self.state.exists() else []
        matcher = Matcher(**self.options, centroids=known)
        part = pd.concat(list(rows)).sort_values("sentence_id")
        got = [matcher.assign(v) for v in part["embedding"]]
        self.state.update(([c.tolist() for c in matcher.centroids],))
        yield pd.DataFrame({"session_id": key[0], "sentence_id": part["sentence_id"].to_numpy(), "label": [g[0] for g in got], "similarity": [g[1] for g in got], "is_new": [g[2] for g in got]})

    def close(self) -> None:
        pass


def assign_voice_stream(voices: DataFrame, **options) -> DataFrame:
    """assign_voices for a stream of (session_id, sentence_id, embedding)."""
    own = voices.select("session_id", "sentence_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = own.groupBy("session_id").transformWithStateInPandas(VoiceMatcher(options), StructType.fromDDL("session_id long, sentence_id long, label string, similarity double, is_new boolean"), "Append", "None")
    return out.withColumn("reason", assignment_reason(options.get("threshold", DEFAULTS.same_voice)))


def quiet_sessions(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """(session_id, start, end, n): windows that close after a quiet gap, where no hysteresis is wanted."""
    own = events.withWatermark(ts, late).groupBy("session_id", F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return own.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hop_windows(frames: DataFrame, size: int, step: int, order: str = "frame_idx", value: str = "power", keys: tuple = ("session_id",)) -> DataFrame:
    """(keys, window_idx, n, level): sliding windows of size frames every step frames, by position in the series.

    Each frame lists the windows that hold it, so the same aggregation serves tables and streams (update mode).
    """
    last, first = F.floor(F.col(order) / step), F.floor((F.col(order) - size) / step) + 1
    own = frames.withColumn("window_idx", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return own.groupBy(*keys, "window_idx").agg(F.count("*").alias("n"), F.avg(value).alias("level"))


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers and several columns needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all its input so far into a table in the folder, and reads the table. A run that was cut short
    goes on from the checkpoint beside it."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def answered_stream(finals: DataFrame, answers: DataFrame, within: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Sentences with the answers that arrive within the time; none gives nulls. Both are streams with arrived_at."""
    f = finals.withWatermark("arrived_at", late).alias("f")
    a = answers.select("session_id", "sentence_id", F.col("arrived_at").alias("answered_at"), "translation").withWatermark("answered_at", late).alias("a")
    on = F.expr(f"f.session_id = a.session_id AND f.sentence_id = a.sentence_id AND a.answered_at BETWEEN f.arrived_at AND f.arrived_at + INTERVAL {within}")
    return f.join(a, on, "left_outer").select("f.*", "a.answered_at", "a.translation")
