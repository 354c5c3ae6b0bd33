"""Sessions of a stream share the rows of the state store: a batch asks it once for a bucket, not ten times and more for each session."""

import pandas as pd
from pyspark.sql import functions as F

from parley.streaming import sessions as ss


class Store:
    """The state of one bucket, which counts its calls."""

    def __init__(self):
        self.value, self.mark, self.hasTimedOut, self.timer, self.calls = None, 0, False, None, []

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def remove(self):
        self.calls.append("remove")
        self.value = None

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        assert at > self.mark
        self.timer = at


def run(processor, store, rows, mark=0):
    store.mark, store.timer, store.calls, store.hasTimedOut = mark, None, [], not rows
    parts = [pd.DataFrame(rows, columns=["session_id", "at", "tie", "prob", "ended"])] if rows else []
    return sorted(tuple(r) for out in processor.batch((0,), iter(parts), store) for r in out.itertuples(index=False))


def test_a_bucket_is_read_and_written_once():
    processor, store, n = ss.Hysteresis(0.5, 0.35, 1, 1, 0), Store(), 50
    processor.waits = True
    # rows of all sessions, the later one first; nothing is ready
    assert run(processor, store, [(s, at * 1000 + s, 0, p, False) for at, p in ((20, 0.1), (10, 0.9)) for s in range(n)]) == []
    assert store.calls == ["update"] and store.timer == 10
    # one session gets a row; what waits of the others is ready all the same, and one row is too late
    got = run(processor, store, [(0, 30_000, 0, 0.9, False), (1, 3_000, 0, 0.9, False)], 15)
    assert got == sorted([(s, "speech_start", 0) for s in range(n)] + [(1, "late", 1)])
    assert store.calls == ["get", "update"] and store.timer == 20
    # the timer of the earliest row wakes the bucket
    assert run(processor, store, [], 21) == [(s, "speech_end", 1) for s in range(n)]
    assert store.calls == ["get", "update"] and store.timer == 30
    # a session that ends is forgotten, and an empty bucket is removed
    assert run(processor, store, [(s, 40_000, 0, 0.0, True) for s in range(n)], 31) == [(0, "speech_start", 2)]
    assert run(processor, store, [], 41) == [(0, "speech_end", 3)]
    assert store.calls == ["get", "remove"] and store.timer is None


def test_many_sessions_are_few_rows_of_state(spark, tmp_path):
    ss.use_rocksdb(spark)
    rows = spark.range(6_000).select((F.col("id") % 3_000).alias("session_id"), F.floor(F.col("id") / 3_000).alias("seq"), F.when(F.col("id") < 3_000, 0.9).otherwise(0.1).alias("prob"), F.lit(False).alias("ended"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = ss.segment_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), n_open=1, n_close=1, pad=0)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 1_024
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("kind", "frame").agg(F.count("*"), F.countDistinct("session_id")).collect()
    assert sorted(tuple(r) for r in got) == [("speech_end", 1, 3_000, 3_000), ("speech_start", 0, 3_000, 3_000)]
