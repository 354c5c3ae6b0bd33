"""Files, sinks and streams: the stream gives what the batch gives."""

import random
import tempfile
import wave

from pyspark.sql import functions as F

from parley.operators import segments as sg
from parley.operators import voices as vc
from parley.sources import contract as ct
from parley.sources import lists, sinks
from parley.streaming import sessions as ss


def test_word_lists_and_patterns(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\n  one \n\nb(ad\ntwo # stays\n", encoding="utf-8")
    assert [r.line for r in lists.read_wordlist(spark, str(tmp_path / "w.txt")).collect()] == ["one", "b(ad", "two # stays"]
    assert lists.read_wordlist(spark, str(tmp_path / "none.txt")).count() == 0
    good, bad = lists.read_patterns(spark, str(tmp_path / "w.txt"))
    assert good == ["one", "two # stays"] and [b[0] for b in bad] == ["b(ad"]


def test_recordings(spark, tmp_path):
    for name, rate in (("good.wav", 16_000), ("bad.wav", 8_000)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes(bytes(6400 * 2 + 100))
    (tmp_path / "no.wav").write_bytes(b"nope")
    rows = lists.scan_recordings(spark, f"{tmp_path}/*.wav").collect()
    ok = [r for r in rows if not r.problem]
    assert [len(r.pcm) for r in sorted(ok, key=lambda r: r.seq)] == [6400, 6400, 100]
    assert {r.path.rpartition("/")[2]: r.problem.split(" ")[0] for r in rows if r.problem} == {"bad.wav": "rate", "no.wav": "not"}
    good, bad = ct.split_valid(spark.createDataFrame([(r.path, r.seq, r.pcm) for r in ok], "p string, seq long, pcm binary"), [ct.chunk_rule()])
    assert (good.count(), bad.first().problem) == (2, "a chunk must have 6400 bytes, not 100")


def test_messages_round_trip(spark):
    row = spark.createDataFrame([(3, 1.26, 99.94, 98.0, "pause", False, True, None, 0.12345, "A", "vi")], ct.FIELDS["utterance"])
    raw = row.select(ct.to_messages(row, "utterance").alias("raw"))
    back = ct.typed(ct.parse_messages(raw), "utterance").first()
    assert (back["index"], back.start_ms, back.end_ms, back.speech_score, back.label) == (3, 1.3, 99.9, 0.123, None)
    odd = spark.createDataFrame([("nope",), ("[1]",), ('{"type":"zzz"}',), ('{"type":"bye","x":1}',), (None,)], "raw string")
    assert [r.problem for r in ct.parse_messages(odd).collect()] == ["not valid JSON", "not an object", "unknown type", "", "not valid JSON"]


def _batches(spark, rows, schema, cuts):
    """A folder of one file per batch, in order, to be read as a stream."""
    path = tempfile.mkdtemp(prefix="spark-")
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return path


def test_segment_stream_equals_batch(spark):
    ss.use_rocksdb(spark)
    rng = random.Random(4)
    rows = [(s, i, rng.choice([0.1, 0.3, 0.4, 0.6, 0.9]), False) for i in range(60) for s in range(5)] + [(s, 60, None, True) for s in range(5)]
    schema = "session_id long, seq long, prob double, ended boolean"
    path = _batches(spark, rows, schema, [70, 160, 200])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    q = ss.segment_stream(stream, n_open=2, n_close=3, pad=2).writeStream.format("memory").queryName("seg").outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.session_id, r.frame, r.kind) for r in spark.table("seg").collect())
    frames = spark.createDataFrame([r[:3] for r in rows if not r[3]], "session_id long, frame_idx long, prob double")
    want = sg.segment_events(sg.segment_hysteresis(frames, n_open=2, n_close=3, pad=2), frame_ms=1.0).collect()
    assert got == sorted((r.session_id, int(r.at_ms), r.kind) for r in want)


def test_upsert_survives_replay(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    write = sinks.upsert_transcript(spark, path, buckets=4)
    one = spark.createDataFrame([(1, i, i, f"a{i}") for i in range(9)], "session_id long, sentence_id long, seq long, transcript string")
    two = spark.createDataFrame([(1, 3, 50, "new"), (1, 4, 2, "old")], one.schema)
    for batch, n in ((one, 0), (two, 1), (two, 1)):
        write(batch, n)
    got = {r.sentence_id: r.transcript for r in sinks.read_transcript(spark, path).collect()}
    assert got == {**{i: f"a{i}" for i in range(9)}, 3: "new"}


def test_hop_and_session_windows_stream(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "session_id long, frame_idx long, power double")
    assert {r.window_idx: r.n for r in ss.hop_windows(df, 4, 2).collect()} == {0: 4, 1: 4, 2: 4, 3: 2}
    rows = [(1, 0), (1, 300), (1, 2000), (2, 100), (9, 60_000)]
    path = _batches(spark, rows, "session_id long, ms long", [])
    stream = spark.readStream.schema("session_id long, ms long").option("recursiveFileLookup", "true").parquet(path).select("session_id", F.timestamp_millis("ms").alias("ts"))
    q = ss.quiet_sessions(stream).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.session_id, r.n) for r in spark.table("quiet").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_answers_stream_joins_in_time(spark):
    f = spark.createDataFrame([(1, 1, 1000), (1, 2, 2000), (1, 3, 90_000)], "session_id long, sentence_id long, ms long")
    a = spark.createDataFrame([(1, 1, 4000, "x"), (1, 2, 60_000, "late"), (1, 9, 90_000, "n")], "session_id long, sentence_id long, ms long, translation string")
    paths = []
    for df in (f, a):
        paths.append(tempfile.mkdtemp(prefix="spark-"))
        df.write.mode("append").parquet(paths[-1])
    s = [spark.readStream.schema(df.schema).parquet(p).withColumn("arrived_at", F.timestamp_millis("ms")).drop("ms") for df, p in zip((f, a), paths, strict=True)]
    q = ss.answered_stream(*s).writeStream.format("memory").queryName("joined").outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("x", 1) in {(r.translation, r.sentence_id) for r in spark.table("joined").collect()}


def test_voice_stream_equals_batch(spark):
    ss.use_rocksdb(spark)
    rng = random.Random(8)
    rows = [(s, i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(40) for s in range(3)]
    schema = "session_id long, sentence_id long, embedding array<double>"
    path = _batches(spark, rows, schema, [30, 31, 90])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    got = ss.drain(ss.assign_voice_stream(stream, threshold=0.4, most=6), tempfile.mkdtemp(prefix="spark-"))
    want = vc.assign_voices(spark.createDataFrame(rows, schema), threshold=0.4, most=6)
    key = lambda r: (r.session_id, r.sentence_id, r.label, round(r.similarity, 9), r.is_new)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
