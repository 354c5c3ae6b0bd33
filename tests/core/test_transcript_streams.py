"""The transcript, its corrections and the backlog as streams give what the batch forms give."""

import random
import tempfile
import time

from pyspark.sql import functions as F

from parley.operators import transcript as tr
from parley.sources import sinks
from parley.streaming import sessions as ss
from parley.streaming import transcripts as ts

MESSAGES = "session_id long, seq long, kind string, sentence_id long, speaker_id string, lang_code string, transcript string, translation string, reason string, raw string, labels map<string,string>"


def _files(spark, rows, schema, sizes):
    path, at = tempfile.mkdtemp(prefix="spark-"), 0
    for i, n in enumerate([*sizes, len(rows)]):
        spark.createDataFrame(rows[at : at + n], schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
        at += n
        time.sleep(0.02)
    return path


def _messages(rng):
    rows = []
    for seq in range(160):
        for s in (1, 2, 3):
            sid, kind = rng.randrange(12), rng.choice(["final", "translation", "speakers", "partial", "zzz"])
            who, text = rng.choice(["A", "B", None]), rng.choice(["x", "y", "", None])
            labels = {str(rng.randrange(14)): rng.choice("ABC"), "no": "D"} if kind == "speakers" else None
            rows.append((s, seq, kind, None if kind == "speakers" else sid, who, "vi", text, text, "r", text, labels))
    return rows


def test_fold_stream_equals_batch(spark, tmp_path):
    ss.use_rocksdb(spark)
    rows = _messages(random.Random(3))
    path = _files(spark, rows, MESSAGES, [90, 150, 60])
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    changes = ts.fold_stream(stream)
    write = sinks.upsert_transcript(spark, f"{tmp_path}/t", order="version", buckets=4)
    q = changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    cols = ["session_id", "sentence_id", "seq", "speaker_id", "lang_code", "transcript", "translation", "reason", "raw", "answered", "relabelled"]
    got = sinks.read_transcript(spark, f"{tmp_path}/t").select(cols).collect()
    want = tr.fold_messages(spark.createDataFrame(rows, MESSAGES)).select(cols).collect()
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))


def test_backlog_stream(spark, tmp_path):
    ss.use_rocksdb(spark)
    kinds = "session_id long, seq long, kind string, sentence_id long"
    rows = [(1, i, "job", i) for i in range(5)] + [(2, 0, "job", 0)] + [(1, 5, "answer", 3), (1, 6, "job", 6), (2, 1, "zzz", None)] + [(1, 7, "bye", None), (1, 8, "job", 0), (1, 9, "bye", None), (1, 10, "bye", None)]
    path = _files(spark, rows, kinds, [3, 3, 3])
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    got = ss.drain(ts.backlog_stream(stream, depth=3), f"{tmp_path}/b").collect()
    want = [(1, 0, ts.EVICTED), (1, 1, ts.EVICTED), (1, 2, ts.ENDED), (1, 4, ts.ENDED), (1, 6, ts.ENDED), (1, 0, ts.ENDED)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_backlog_ends_by_timer(spark, tmp_path):
    ss.use_rocksdb(spark)
    kinds = "session_id long, seq long, kind string, sentence_id long"
    path = _files(spark, [(1, 0, "job", 7), (2, 0, "job", 8), (2, 1, "bye", None)], kinds, [])
    stream = ts.backlog_stream(spark.readStream.schema(kinds).parquet(f"{path}/*"), idle_ms=500)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/r").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            try:
                got = spark.read.schema(ts.OUTCOMES).parquet(f"{tmp_path}/r").collect()
            except Exception as e:
                assert "PATH_NOT_FOUND" in str(e)
                got = []
            if len(got) == 2:
                break
    finally:
        q.stop()
    assert sorted(map(tuple, got)) == [(1, 7, ts.ENDED), (2, 8, ts.ENDED)]
