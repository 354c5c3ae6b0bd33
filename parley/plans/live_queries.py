"""Queries of live frames, utterances, running text and voices: streams over the tables, cut into files that arrive out of order."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import language as lg
from parley.operators import utterances as ut
from parley.plans import score_queries as sc
from parley.plans import stream_queries as sq
from parley.plans.bind import SEGMENT, SEGMENTS, frames, table
from parley.plans.session_queries import _folder
from parley.streaming import sessions as ss
from parley.streaming import utterances as live
from parley.streaming import voices as live_voices

#: Files that a feed is cut into, and slots of time; a fifth of the rows arrive one slot late.
FILES, SLOTS = 3, 12
SPEECH = SEGMENT | {"limit": 8, "search": 3, "every_ms": 60, "chunk_ms": 32}


#: Rows of a part of a feed from which it is written as a file for each core; bytes of a part of the chunks of texts, about.
ROWS, PART_BYTES = 10_000, 512_000_000


def write_parts(spark, rows, parts, folder):
    """How many files each part is: rows with _file, one part after the other, under folder, so that as many files a trigger are one part."""
    held = {r[0]: r[1] for r in rows.groupBy("_file").count().collect()}
    n = spark.sparkContext.defaultParallelism if min(held.get(i, 0) for i in range(parts)) >= ROWS else 1
    for i in range(parts):
        part = rows.where(F.col("_file") == i).drop("_file")
        (part.repartition(n) if n > 1 else part.coalesce(1)).write.mode("append").parquet(folder)
    if n > 1 and len(spark.read.parquet(folder).inputFiles()) != n * parts:
        raise RuntimeError("a part of the feed has other than its number of files")
    return n


def feed(spark, rows, folder):
    """(stream, late) of rows with ts: written as files in order of arrival, where rows of a slot may come with the next one.

    Rows of the end of each session, and then one of no session that moves the clock on, follow the last slot.
    """
    span = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    wide = (span[1] - span[0]) // SLOTS + 1
    slot = F.floor((F.unix_micros("ts") - span[0]) / wide)
    behind = F.when(F.pmod(F.xxhash64("ts", "tie"), F.lit(5)) == 0, 1).otherwise(0)
    own = rows.withColumn("_file", F.least(F.floor((slot + behind) * FILES / SLOTS), F.lit(FILES - 1)))
    last = F.timestamp_micros(F.lit(span[1] + 1))
    ends = rows.select("session_id").distinct().select("session_id", last.alias("ts"), F.lit(True).alias("ended"), F.lit(FILES - 1).alias("_file"))
    clock = spark.range(1).select(F.timestamp_micros(F.lit(span[1] + 2 * wide)).alias("ts"), F.lit(True).alias("ended"), F.lit(FILES).alias("_file"))
    both = own.withColumn("ended", F.lit(False)).unionByName(ends, allowMissingColumns=True).unionByName(clock, allowMissingColumns=True)
    n = write_parts(spark, both.where(F.col("_file") < FILES), FILES, f"{folder}/feed")
    both.where(F.col("_file") == FILES).drop("_file").coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    stream = spark.readStream.schema(both.drop("_file").schema).option("maxFilesPerTrigger", n).parquet(f"{folder}/feed")
    return stream, f"{wide // 1000 + 1} milliseconds"


def _event_rows(spark, d):
    f = frames(spark, d)
    return f.select("session_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), "prob", "power")


def speech(spark, d):
    """The events of a feed as live speech, drained into a table."""
    ss.use_rocksdb(spark)
    folder = _folder(spark)
    stream, late = feed(spark, _event_rows(spark, d), folder)
    return ss.drain(live.speech_stream(stream, **SPEECH, ts="ts", late=late), folder)


def utterance_stream(spark, d):
    return live.spoken(speech(spark, d))


def running_text_stream(spark, d):
    return live.running_text(speech(spark, d), seconds=0.1)


def running_text(spark, d):
    """The same from the finished utterances."""
    ticks = ut.running_text(sq.utterances(spark, d), every_ms=60, chunk_ms=32, limit_ms=8 * 32.0)
    return ticks.withColumn("tail_ms", F.greatest(F.col("start_ms"), F.col("at_ms") - 100)).drop("start_ms")


def frame_stream(spark, d):
    """Texts of documents as chunks, in three parts or more, by their bytes; what a chunk leaves of a frame is carried on."""
    ss.use_rocksdb(spark)
    folder = _folder(spark)
    chunks = sq.byte_chunks(spark, d)
    top, size = chunks.agg(F.max("seq"), F.sum(F.octet_length("pcm"))).first()
    parts = max(FILES, -(-(size or 0) // PART_BYTES))
    own = chunks.withColumn("_file", F.least(F.floor(F.col("seq") * parts / ((top or 0) + 1)), F.lit(parts - 1)))
    n = write_parts(spark, own, parts, f"{folder}/feed")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", n).parquet(f"{folder}/feed")
    return ss.drain(live.frame_stream(stream), folder).select("session_id", "frame_idx", F.md5("pcm").alias("pcm_md5"))


def segment_stream(spark, d):
    """Segments of the same feed, put in order by event time."""
    ss.use_rocksdb(spark)
    folder = _folder(spark)
    stream, late = feed(spark, _event_rows(spark, d), folder)
    return ss.drain(ss.segment_stream(stream, **SEGMENT, ts="ts", late=late), folder)


def recluster_stream(spark, d):
    """Voices in order of their sentences, in three files; each session's labels are put right as it goes on."""
    ss.use_rocksdb(spark)
    folder = _folder(spark)
    v = sc.voices(spark, d).select("session_id", "sentence_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").withColumn("session_id", F.col("session_id").cast("long"))
    top = v.agg(F.max("sentence_id")).first()[0] or 0
    for i in range(FILES):
        part = F.least(F.floor(F.col("sentence_id") * FILES / (top + 1)), F.lit(FILES - 1)) == i
        v.where(part).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed")
    return ss.drain(live_voices.recluster_stream(stream), folder)


def snap_to_quiet(spark, d):
    """The middles of all utterances as cuts between two languages, snapped back to the quiet."""
    u = sq.plain_utterances(spark, d).select("session_id", "idx", "start_ms", ((F.col("start_ms") + F.col("end_ms")) / 2).alias("at_ms"))
    return lg.snap_to_quiet(u, frames(spark, d), ["session_id", "idx"], search=3)


def quiet_sessions(spark, d):
    """Stretches of events of a user without a pause of a day, from the feed."""
    folder = _folder(spark)
    stream, late = feed(spark, _event_rows(spark, d), folder)
    rows = stream.where(~F.col("ended") | F.col("session_id").isNull())
    out = ss.drain(ss.quiet_sessions(rows, "86400 seconds", late), folder)
    return out.where("session_id is not null").select("session_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


QUERIES = {"snap_to_quiet": snap_to_quiet, "quiet_sessions": quiet_sessions, "recluster_stream": recluster_stream, "utterance_stream": utterance_stream, "running_text_stream": running_text_stream, "running_text": running_text, "frame_stream": frame_stream, "segment_stream": segment_stream}

#: Utterances with the length limit: where a stretch that begins at a frame is cut, then from cut to cut.
SPLIT = f"""WITH RECURSIVE {SEGMENTS},
ahead AS (SELECT session_id, frame_idx, arg_min(frame_idx, (power, frame_idx)) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN 5 FOLLOWING AND 7 FOLLOWING) + 1 AS cut FROM frames),
parts AS (
  SELECT session_id, segment_idx, open_at_end, end_frame, start_frame AS a, 0 AS part FROM segments
  UNION ALL
  SELECT p.session_id, segment_idx, open_at_end, end_frame, cut, part + 1 FROM parts p JOIN ahead h ON h.session_id = p.session_id AND h.frame_idx = p.a WHERE end_frame - a >= 8),
bounded AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY session_id, segment_idx ORDER BY part), end_frame) AS b, lead(a) OVER (PARTITION BY session_id, segment_idx ORDER BY part) IS NOT NULL AS filled FROM parts),
split AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY segment_idx, part) - 1 AS idx, a * 32.0::DOUBLE AS start_ms, b * 32.0::DOUBLE AS end_ms,
  CASE WHEN filled THEN 'max_duration' WHEN open_at_end THEN 'end_of_stream' ELSE 'pause' END AS reason, part > 0 AS continues_previous FROM bounded WHERE b > a)"""
_RUNNING = f"""{SPLIT} SELECT session_id, idx, CAST(tick AS INTEGER) AS tick, start_ms + tick * 64.0 AS at_ms, greatest(start_ms, start_ms + tick * 64.0 - 100) AS tail_ms
FROM (SELECT *, unnest(range(1, CAST(floor(CASE WHEN reason = 'max_duration' THEN 7 * 32.0 ELSE end_ms - start_ms END / 64) AS BIGINT) + 1)) AS tick FROM split)"""

SQL = {
    "snap_to_quiet": f"""WITH {sq._UTT}, c AS (SELECT session_id, idx, start_ms, (start_ms + end_ms) / 2 AS at_ms FROM utt),
q AS (SELECT c.session_id, idx, arg_min(frame_idx, (power, frame_idx)) + 1 AS f FROM c JOIN frames f ON f.session_id = c.session_id AND frame_idx >= greatest(floor(at_ms / 32) - 3, ceil(start_ms / 32)) AND frame_idx < floor(at_ms / 32) GROUP BY 1, 2)
SELECT session_id, idx, start_ms, at_ms, coalesce(f * 32.0::DOUBLE, at_ms) AS cut_ms FROM c LEFT JOIN q USING (session_id, idx)""",
    "quiet_sessions": """WITH e AS (SELECT user_id AS session_id, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 86400000000, true) AS fresh FROM events),
g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY session_id ORDER BY t) AS g FROM e)
SELECT session_id, min(t) AS start_us, max(t) + 86400000000 AS end_us, count(*) AS n FROM g GROUP BY session_id, g""",
    "utterances_split": f"{SPLIT} SELECT * FROM split",
    "utterance_stream": f"{SPLIT} SELECT * FROM split",
    "running_text": _RUNNING,
    "running_text_stream": _RUNNING,
    "frame_stream": sq.SQL["reframe"],
    "segment_stream": f"WITH {SEGMENTS} SELECT session_id, 'speech_start' AS kind, start_frame AS frame FROM segments UNION ALL SELECT session_id, 'speech_end', end_frame FROM segments",
}
