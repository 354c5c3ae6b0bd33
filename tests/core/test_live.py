"""Live streams against the batch operators, with files that arrive out of order, and rows that come too late."""

import datetime as dt
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import segments as sg
from parley.operators import utterances as ut
from parley.operators import voices as vc
from parley.plans import live_queries as lq
from parley.streaming import ordering
from parley.streaming import sessions as ss
from parley.streaming import utterances as live
from parley.streaming import voices as live_voices

START = dt.datetime(2024, 1, 1)


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def series(seed, sessions=5, frames=160):
    """Scores in runs of speech and quiet; session 0 speaks without a pause, session 1 never does."""
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        loud, left = True, 0
        for i in range(frames):
            if not left:
                loud, left = not loud, rng.choice([1, 2, 4, 9, 30])
            left -= 1
            prob = 0.9 if s == 0 else 0.1 if s == 1 else rng.uniform(0.55, 1) if loud else rng.uniform(0, 0.4)
            rows.append((s, i, prob, float(rng.randrange(5)), START + dt.timedelta(milliseconds=32 * i)))
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {"n_open": 3, "n_close": 4, "pad": 5, "limit": 12, "search": 4}), (2, {"n_open": 1, "n_close": 1, "pad": 0, "limit": 5, "search": 9})])
def test_speech_stream_out_of_order_equals_batch(spark, seed, options):
    ss.use_rocksdb(spark)
    frames = spark.createDataFrame(series(seed), "session_id long, frame_idx long, prob double, power double, ts timestamp")
    own = folder()
    stream, late = lq.feed(spark, frames.withColumn("tie", F.col("frame_idx")), own)
    got = ss.drain(live.speech_stream(stream, **options, every_ms=96, chunk_ms=32, ts="ts", late=late), own)
    hysteresis = {k: options[k] for k in ("n_open", "n_close", "pad")}
    batch = ut.build_utterances(sg.segment_hysteresis(frames, **hysteresis), frames, limit=options["limit"], search=options["search"])
    want = sorted(tuple(r) for r in batch.collect())
    assert len(want) > 20 and sorted(tuple(r) for r in live.spoken(got).collect()) == want
    ticks = ut.running_text(batch, every_ms=96, chunk_ms=32, limit_ms=32.0 * options["limit"])
    text = [(r.session_id, r.idx, r.tick, r.at_ms, max(r.start_ms, r.at_ms - 200)) for r in ticks.collect()]
    assert len(text) > 10 and sorted(tuple(r) for r in live.running_text(got, 0.2).collect()) == sorted(text)


def test_state_of_speech_does_not_grow_with_the_session():
    class Handle:
        def __init__(self):
            self.held = {}

        def getValueState(self, name, _):
            return State(self.held, name)

        getListState = getValueState

    class State:
        def __init__(self, held, name):
            self.held, self.name = held, name

        def exists(self):
            return self.name in self.held

        def get(self):
            return self.held[self.name]

        def update(self, x):
            self.held[self.name] = x

        put = update

        def clear(self):
            self.held.pop(self.name, None)

    speech, handle = live.Speech(0.5, 0.35, 3, 16, 8, 218, 15, 32.0, 600.0), Handle()
    speech.start(handle)
    told = 0
    for _ in range(200):
        told += sum(map(len, speech.take((1,), [(0.9, 1.0, False)] * 50)))
        assert len(handle.held["power"]) < 218 and len(handle.held["run"][5]) <= 8
    assert told > 40
    list(speech.take((1,), [(0.9, 1.0, True)]))
    assert not handle.held


def write(spark, rows, schema, at):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)


def test_rows_later_than_the_stream_waits_are_counted(spark):
    ss.use_rocksdb(spark)
    own, schema = folder(), "session_id long, ts timestamp, tie long, prob double, ended boolean"
    at = lambda s: START + dt.timedelta(seconds=s)
    write(spark, [(1, at(100 + i), i, 0.9, False) for i in range(3)], schema, f"{own}/in")
    write(spark, [(1, at(101), 9, 0.9, False), (1, at(200), 0, 0.0, False)], schema, f"{own}/in")
    # 30 s behind what came before is too late, 5 s is not
    write(spark, [(1, at(170), 0, 0.9, False), (1, at(195), 0, 0.9, False)], schema, f"{own}/in")
    write(spark, [(1, at(400), 0, 0.0, True), (None, at(900), 0, 0.0, False)], schema, f"{own}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{own}/in")
    out = ss.segment_stream(stream, n_open=1, n_close=1, pad=0, ts="ts", late="10 seconds")
    got = sorted((r.kind, r.frame) for r in ss.drain(out, own).collect())
    # 100, 101, 101 (tie 9), 102 and 195 are speech, 200 is not
    assert got == [("late", 1), ("speech_end", 5), ("speech_start", 0)]


def test_event_time_is_the_start_and_the_position(spark):
    df = spark.createDataFrame([(START, 1500.5), (START, None)], "s timestamp, at_ms double")
    got = [r.t for r in df.select(ordering.event_time(F.col("s"), F.col("at_ms")).alias("t")).collect()]
    assert got == [START + dt.timedelta(milliseconds=1500.5), None]


def test_frames_across_batches_and_ends(spark):
    ss.use_rocksdb(spark)
    own, schema = folder(), "session_id string, seq long, pcm binary, ended boolean"
    raw = bytes(range(200)) * 3
    write(spark, [("a", 1, raw[:7], False), ("a", 0, None, False), ("b", 0, raw[:20], False), ("b", 1, b"", True)], schema, f"{own}/in")
    write(spark, [("a", 2, raw[7:300], False), ("b", 0, raw[:9], False)], schema, f"{own}/in")
    write(spark, [("a", 3, raw[300:], True)], schema, f"{own}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{own}/in")
    got = sorted((r.session_id, r.frame_idx, bytes(r.pcm)) for r in ss.drain(live.frame_stream(stream, 16, pad_tail=True), own).collect())
    frames = lambda s, b: [(s, i // 16, b[i : i + 16].ljust(16, b"\0")) for i in range(0, len(b), 16)]
    # the second life of b has not ended: its nine bytes wait
    assert got == frames("a", raw) + frames("b", raw[:20])


def talk(seed, sessions=3, n=70):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(4, 6))
    return [(s, i, (middle[rng.integers(4)] + 0.3 * rng.normal(size=6)).tolist() if i % 11 else [], f"Speaker_{rng.integers(1, 4):02d}" if i % 13 else vc.UNKNOWN) for s in range(sessions) for i in range(n)]


def test_reclustering_live_in_batch_and_by_windows(spark):
    ss.use_rocksdb(spark)
    rows, schema = talk(4), "session_id long, sentence_id long, embedding array<double>, label string"
    df = spark.createDataFrame(rows, schema)
    batch = sorted(tuple(r) for r in vc.recluster_runs(df, every=10, keep=25, threshold=0.5).collect())
    # the windows of voice_window, one after the other, with the labels as they stand
    want = []
    windows = vc.voice_window(df, every=10, keep=25).collect()
    for s in range(3):
        label = {r[1]: r[3] for r in rows if r[0] == s}
        voice = {r[1]: r[2] for r in rows if r[0] == s}
        for run in sorted({w.run for w in windows if w.session_id == s}):
            own = sorted(w.sentence_id for w in windows if w.session_id == s and w.run == run)
            names = vc.name_clusters(vc.cluster(np.array([voice[i] for i in own]), 0.5), [label[i] for i in own])
            for i, name in zip(own, names, strict=True):
                if label[i] != name:
                    want.append((s, run, i, label[i], name))
                    label[i] = name
    assert batch == sorted(want) and len({w[1] for w in want}) > 2
    own = folder()
    for part in range(4):
        write(spark, [r for r in rows if r[1] * 4 // 70 == part], schema, f"{own}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{own}/in")
    got = ss.drain(live_voices.recluster_stream(stream, every=10, keep=25, threshold=0.5), own)
    assert sorted(tuple(r) for r in got.collect()) == batch


def test_voice_changes_of_overlapping_windows(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    # windows of 1,000 ms every 500 ms: the one at 500 overlaps the anchor, so the change is told at 1,000
    rows = [(1, i, i * 500.0, v) for i, v in enumerate([a, b, b, b, a, a, a])]
    # the anchor is unusable: no verdict; an unusable window in between: none for it
    rows += [(2, i, i * 1000.0, v) for i, v in enumerate([[float("nan"), 0.0], a, b])] + [(3, i, i * 1000.0, v) for i, v in enumerate([a, [], None, b, b])]
    df = spark.createDataFrame(rows, "utt long, window_idx long, at_ms double, embedding array<double>").repartition(3)
    got = sorted((r.utt, r.window_idx, round(r.similarity, 9)) for r in vc.voice_changes(df, ["utt"], at="at_ms", size=1000.0).collect())
    # after the change at 1,000 the window at 1,500 overlaps the newcomer's
    assert got == [(1, 2, 0.0), (1, 4, 0.0), (3, 3, 0.0)]


def test_voices_of_a_long_session_in_order_and_pairs_by_tiles(spark):
    rng = np.random.default_rng(6)
    rows = [(s, int(i), rng.normal(size=5).round(3).tolist()) for s, n in ((1, 300), (2, 7), (None, 3)) for i in rng.permutation(n)] + [(3, 0, [0.0] * 5), (3, 1, [1.0] * 5)]
    df = spark.createDataFrame(rows, "session_id long, sentence_id long, embedding array<double>").repartition(5)
    got = {(r.session_id, r.sentence_id): r.label for r in vc.assign_voices(df, threshold=0.4, most=6).collect()}
    for s in (1, 2, None):
        m = vc.Matcher(0.4, 6)
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            assert got[r[0], r[1]] == m.assign(r[2])[0]
    near = lambda x, y: float(np.dot(x, y) / max(1e-300, np.linalg.norm(x) * np.linalg.norm(y)))
    want = {(s, x[1], y[1]): near(x[2], y[2]) for s in (1, 2, 3) for x in rows for y in rows if x[0] == y[0] == s and x[1] < y[1]}
    for least in (None, 0.8):
        pairs = {(r.session_id, r.a, r.b): r.similarity for r in vc.pairwise(df, tile=64, least=least).collect()}
        assert pairs == pytest.approx({k: v for k, v in want.items() if least is None or v >= least})
    assert vc.newest_voices(df, keep=10).groupBy("session_id").count().where("count > 10").count() == 0


def test_parts_of_a_feed_are_files_for_all_cores(spark):
    """A large part is as many files as there are cores, which are one batch; small ones are one file each."""
    n = spark.sparkContext.defaultParallelism
    for rows, want in ((3 * lq.ROWS, n), (30, 1)):
        own = folder()
        made = spark.range(rows).select("id", (F.col("id") % 3).alias("_file"))
        assert lq.write_parts(spark, made, 3, f"{own}/feed") == want
        files = spark.read.parquet(f"{own}/feed").groupBy(F.input_file_name().alias("f")).agg(F.countDistinct(F.col("id") % 3).alias("k")).collect()
        assert len(files) == 3 * want and all(r.k == 1 for r in files)
