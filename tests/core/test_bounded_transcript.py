"""The streamed transcript forgets what it need not know, and its table reads one version of each bucket."""

import time

from pyspark.sql import functions as F

from parley.operators import transcript as tr
from parley.sources import sinks
from parley.streaming import sessions as ss
from parley.streaming import transcripts as ts

MESSAGES = "session_id long, seq long, kind string, sentence_id long, speaker_id string, lang_code string, transcript string, translation string, reason string, raw string, labels map<string,string>"


def message(seq, kind, sid=None, labels=None):
    return (1, seq, kind, sid, "A", "vi", f"t{seq}", f"x{seq}", "", None, labels)


def run(spark, rows, sizes, tmp_path, **options):
    path, at = f"{tmp_path}/in", 0
    for n in [*sizes, len(rows)]:
        spark.createDataFrame(rows[at : at + n], MESSAGES).coalesce(1).write.mode("append").parquet(path)
        at += n
        time.sleep(0.02)
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(path)
    return ss.drain(ts.fold_stream(stream, **options), f"{tmp_path}/out")


def newest(changes):
    return {r.sentence_id: r for r in changes.orderBy("version").collect()}


def test_newest_sentences_are_those_of_the_batch(spark, tmp_path):
    ss.use_rocksdb(spark)
    rows = []
    for i in range(40):
        rows.append(message(10 * i, "final", i))
        if i >= 2:
            rows.append(message(10 * i + 1, "translation", i - 2))
        if i >= 9:
            # too late: nine others have come since
            rows.append(message(10 * i + 2, "translation", i - 9))
        if i % 6 == 5:
            rows.append(message(10 * i + 3, "speakers", None, {str(i - 1): "B", str(i - 8): "C"}))
    got = newest(run(spark, rows, [30, 41], tmp_path, keep=5))
    want = {r.sentence_id: r for r in tr.fold_messages(spark.createDataFrame(rows, MESSAGES)).collect()}
    assert set(got) == set(want) == set(range(40))
    for i in range(35, 40):
        assert all(got[i][c] == want[i][c] for c in ("speaker_id", "transcript", "translation", "answered", "relabelled"))
    # an older one keeps the translation that came while it was known
    assert all(got[i].translation == f"x{10 * (i + 2) + 1}" for i in range(31)) and want[3].translation != got[3].translation


def test_bye_clears_the_state(spark, tmp_path):
    ss.use_rocksdb(spark)
    rows = [message(0, "final", 1), message(1, "translation", 1), message(2, "bye"), message(3, "translation", 1), message(4, "final", 2), message(5, "bye")]
    rows += [message(6, "final", 1), message(7, "speakers", None, {"1": "B", "2": "C"})]
    got = [(r.sentence_id, r.version, r.speaker_id, r.answered) for r in run(spark, rows, [6], tmp_path).orderBy("version").collect()]
    assert got == [(1, 1, "A", True), (2, 4, "A", False), (1, 7, "B", False)]


def test_sentences_have_a_time_to_live(spark, tmp_path):
    """With processing time a stream goes on until it is stopped: what comes after the time finds no sentence."""
    ss.use_rocksdb(spark)
    put = lambda *rows: spark.createDataFrame(list(rows), MESSAGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(message(0, "final", 1))
    out = ts.fold_stream(spark.readStream.schema(MESSAGES).parquet(f"{tmp_path}/in"), ttl_ms=1000)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/r").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()

    def seen():
        try:
            return sorted(r.version for r in spark.read.schema(ts.CHANGES).parquet(f"{tmp_path}/r").collect())
        except Exception as e:
            assert "PATH_NOT_FOUND" in str(e)
            return []

    try:
        for versions, wait, later in (([0], 3, (message(1, "translation", 1), message(2, "final", 2))), ([0, 2], 0, ())):
            for _ in range(60):
                if seen() == versions:
                    break
                time.sleep(0.5)
            time.sleep(wait)
            if later:
                put(*later)
    finally:
        q.stop()
    assert seen() == [0, 2]


def test_a_batch_reads_one_version_of_the_buckets_it_touches(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "session_id long, sentence_id long, seq long, transcript string"
    write = sinks.upsert_transcript(spark, path, buckets=4)
    rows = {}
    for batch in range(6):
        new = [(1, (batch * 3 + i) % 11, batch * 10 + i, f"b{batch}") for i in range(3)] if batch != 3 else []
        for r in new:
            rows[r[1]] = r[3]
        write(spark.createDataFrame(new, schema), batch)
        if new or batch > 3:
            assert {r.sentence_id: r.transcript for r in sinks.read_transcript(spark, path).collect()} == rows
    held = sinks._manifest(spark, path)
    assert len(held) <= 4 and len({f.split("/data/")[1].rsplit("/", 1)[0] for f in sinks.read_transcript(spark, path).inputFiles()}) == len(held)
    before = sinks.read_transcript(spark, path).orderBy("sentence_id").collect()
    gone = sinks.expire_versions(spark, path)
    assert gone and sinks.expire_versions(spark, path) == []
    assert sinks.read_transcript(spark, path).orderBy("sentence_id").collect() == before
    # the last batch again, from what stood before it; then one with another column
    write(spark.createDataFrame([(1, (15 + i) % 11, 50 + i, "b5") for i in range(3)], schema), 5)
    assert sinks.read_transcript(spark, path).orderBy("sentence_id").collect() == before
    write(spark.createDataFrame([(1, 0, 99, "wide")], schema).withColumn("raw", F.lit("r")), 6)
    assert {r.sentence_id: r.raw for r in sinks.read_transcript(spark, path).collect()}[0] == "r"
    assert sinks.read_transcript(spark, f"{tmp_path}/none") is None and sinks.expire_versions(spark, f"{tmp_path}/none") == []
