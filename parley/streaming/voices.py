"""Voices clustered again while a session goes on."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.voices import VoiceHistory
from parley.streaming.ordering import InOrder, States, in_order

CHANGES = "session_id long, run long, sentence_id long, old string, new string"


class Recluster(InOrder):
    """The state of one session: its newest voices with their labels, how many came since the last clustering, and its number."""

    fields, schema = "sentence_id long, embedding array<double>, label string", CHANGES

    def __init__(self, options: dict):
        self.options = options

    def start(self, states: States) -> None:
        self.known = states.getListState("voices", "sentence_id long, embedding array<double>, label string")
        self.count = states.getValueState("count", "since long, run long")

    def take(self, key, rows: list[tuple]) -> Iterator[list[tuple]]:
        since, run = self.count.get() if self.count.exists() else (0, 0)
        history = VoiceHistory(**self.options, voices=self.known.get() if self.known.exists() else (), since=since, run=run)
        out = [(key[0], *change) for row in rows for change in history.add(*row)]
        if history.voices:
            self.known.put([tuple(v) for v in history.voices])
        self.count.update((history.since, history.run))
        yield out


def recluster_stream(voices: DataFrame, ts: str | None = None, late: str | None = None, **options) -> DataFrame:
    """recluster_runs for a stream of (session_id, sentence_id, embedding, label): (session_id, run, sentence_id, old, new) of the labels that change.

    The state of a session is bounded by the voices kept. Voices are in order of sentence_id; without ts, batches of a session arrive in order.
    A sink that keeps the row of the largest run per sentence holds the labels as they stand. Needs the RocksDB state store.
    """
    own = voices.withColumns({"embedding": F.col("embedding").cast("array<double>"), "seq": F.col("sentence_id"), "tie": F.col("sentence_id")})
    return in_order(own, Recluster(options), ts, late)
