"""Queries of frames, segments and utterances."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import frames as fr
from parley.operators import segments as sg
from parley.operators import utterances as ut
from parley.plans.bind import FRAMES, SEGMENT, SEGMENTS, frames, table
from parley.sources import contract as ct


def segments(spark, d):
    return sg.segment_hysteresis(frames(spark, d), **SEGMENT)


def segment_events(spark, d):
    return sg.segment_events(segments(spark, d))


def segment_stats(spark, d):
    return sg.segment_stats(frames(spark, d), segments(spark, d))


def paired(spark, d):
    return sg.pair_events(segment_events(spark, d))


def chunk_list(spark, d):
    return frames(spark, d).select("session_id", F.floor(F.col("frame_idx") / 6).cast("long").alias("chunk_idx")).distinct()


def segment_spans(spark, d):
    return sg.spans(segments(spark, d), chunk_list(spark, d))


def utterances(spark, d):
    return ut.build_utterances(segments(spark, d), frames(spark, d), limit=8, search=3)


def plain_utterances(spark, d):
    events = segment_events(spark, d)
    seq = F.row_number().over(W.partitionBy("session_id").orderBy("at_ms", "kind"))
    return ut.utterances_from_events(events.withColumn("seq", seq))


def utterance_stats(spark, d):
    return ut.utterance_stats(plain_utterances(spark, d))


def ticks(spark, d):
    return ut.partial_ticks(plain_utterances(spark, d), every_ms=60, chunk_ms=32)


def quietest(spark, d):
    return ut.quietest_split(frames(spark, d), ["session_id"], limit=40, search=15)


def quietest_late(spark, d):
    return ut.quietest_split(frames(spark, d).withColumn("power", F.floor("power")), ["session_id"], limit=40, search=15, prefer_late=True)


def tails(spark, d):
    u = plain_utterances(spark, d)
    return u.select("session_id", "idx", ut.tail_window(F.col("start_ms"), F.col("end_ms"), 0.2).alias("tail_ms"), fr.ms_to_bytes(F.col("start_ms")).alias("from_byte"), fr.bytes_to_ms(fr.ms_to_bytes(F.col("end_ms"))).alias("to_ms"))


def language_cuts(spark, d):
    u = plain_utterances(spark, d).withColumn("continues_previous", F.lit(False))
    at = u.select("session_id", "idx", (F.col("start_ms") + 100).alias("at_ms"))
    return ut.cut_at(u, at)


def byte_chunks(spark, d):
    """Texts of documents as chunks of a session per source."""
    return table(spark, d, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.encode("text", "UTF-8").alias("pcm"))


def reframed(spark, d):
    return fr.reframe(byte_chunks(spark, d)).select("session_id", "frame_idx", F.md5("pcm").alias("pcm_md5"))


def reframed_padded(spark, d):
    return fr.reframe(byte_chunks(spark, d), 4096, pad_tail=True).groupBy("session_id").agg(F.count("*").alias("frames"), F.sum(F.octet_length("pcm")).alias("bytes"))


def chunk_counts(spark, d):
    return ct.count_chunks(byte_chunks(spark, d))


def window_arrays(spark, d):
    values = frames(spark, d).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "power"))), lambda x: x.power).alias("v"))
    cut = F.transform(fr.fixed_windows(F.col("v"), 10), lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x))
    return values.select("session_id", F.size(cut).alias("windows"), F.round(F.element_at(cut, -1), 6).alias("last_sum"), F.size(fr.fill_window(F.col("v"), 128)).alias("filled"), F.round(F.element_at(fr.fill_window(F.col("v"), 128), 128), 6).alias("last_filled"), F.round(F.aggregate(fr.tail(F.col("v"), 5), F.lit(0.0), lambda a, x: a + x), 6).alias("tail_sum"))


def gaps(spark, d):
    return fr.arrival_gaps(frames(spark, d), 86_400.0, ts="ts", tie="event_id")


def delivery(spark, d):
    return fr.delivery_report(frames(spark, d), 3600.0, F.col("power") > 1, ts="ts", tie="event_id")


QUERIES = {
    "segments": segments, "segment_events": segment_events, "segment_stats": segment_stats, "segment_pairs": paired, "segment_spans": segment_spans,
    "utterances_split": utterances, "utterances": plain_utterances, "utterance_stats": utterance_stats, "partial_ticks": ticks,
    "quietest_split": quietest, "quietest_split_late": quietest_late, "tail_windows": tails, "utterance_cuts": language_cuts,
    "reframe": reframed, "reframe_padded": reframed_padded, "chunk_counts": chunk_counts, "fixed_windows": window_arrays,
    "arrival_gaps": gaps, "delivery_report": delivery,
}

_EVENTS = f"""{SEGMENTS},
seg_events AS (SELECT session_id, 'speech_start' AS kind, start_frame * 32.0::DOUBLE AS at_ms FROM segments UNION ALL SELECT session_id, 'speech_end', end_frame * 32.0::DOUBLE FROM segments)"""
_UTT = f"""{_EVENTS},
ahead AS (SELECT *, lead(kind) OVER w AS nxt, lead(at_ms) OVER w AS nxt_ms, max(at_ms) OVER (PARTITION BY session_id) AS last_ms FROM seg_events WINDOW w AS (PARTITION BY session_id ORDER BY at_ms, kind)),
utt AS (SELECT * FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, kind) - 1 AS idx, at_ms AS start_ms, coalesce(nxt_ms, last_ms) AS end_ms,
  CASE WHEN nxt IS NULL THEN 'end_of_stream' ELSE 'pause' END AS reason FROM ahead WHERE kind = 'speech_start') WHERE end_ms > start_ms)"""
_CHUNKS = """c AS (SELECT source AS session_id, doc_id AS seq, hex(encode(text)) AS h FROM documents),
w AS (SELECT session_id, string_agg(h, '' ORDER BY seq) AS h FROM c GROUP BY 1)"""

SQL = {
    "segments": f"WITH {SEGMENTS} SELECT * FROM segments",
    "segment_events": f"WITH {_EVENTS} SELECT * FROM seg_events",
    "segment_stats": f"""WITH {SEGMENTS}, a AS (SELECT session_id, count(*) AS frames FROM frames GROUP BY 1),
b AS (SELECT session_id, count(*) AS segments, sum(end_frame - start_frame) AS speech_frames FROM segments GROUP BY 1)
SELECT session_id, frames, coalesce(segments, 0) AS segments, CAST(coalesce(speech_frames, 0) AS BIGINT) AS speech_frames, frames * 1024 AS bytes_in, CAST(coalesce(speech_frames, 0) * 1024 AS BIGINT) AS bytes_out,
coalesce(speech_frames, 0) / frames AS speech_ratio, 1 - coalesce(speech_frames, 0) / frames AS dropped_ratio FROM a LEFT JOIN b USING (session_id)""",
    "segment_pairs": f"WITH {SEGMENTS} SELECT session_id, start_frame * 32.0::DOUBLE AS start_ms, end_frame * 32.0::DOUBLE AS end_ms FROM segments WHERE end_frame > start_frame",
    "segment_spans": f"""WITH {SEGMENTS}, k AS (SELECT DISTINCT session_id, frame_idx // 6 AS chunk_idx FROM frames)
SELECT session_id, segment_idx, chunk_idx, greatest(start_frame, chunk_idx * 6) AS from_frame, least(end_frame, (chunk_idx + 1) * 6) AS to_frame,
start_frame >= chunk_idx * 6 AS opens, NOT open_at_end AND end_frame // 6 = chunk_idx AS closes
FROM segments JOIN k USING (session_id) WHERE chunk_idx BETWEEN start_frame // 6 AND CASE WHEN open_at_end THEN end_frame - 1 ELSE end_frame END // 6""",
    "utterances": f"WITH {_UTT} SELECT * FROM utt",
    "utterance_stats": f"""WITH {_UTT} SELECT session_id, count(*) AS utterances, count(*) FILTER (reason = 'pause') AS pause, count(*) FILTER (reason = 'max_duration') AS max_duration,
count(*) FILTER (reason = 'end_of_stream') AS end_of_stream, sum(end_ms - start_ms) AS audio_ms, max(end_ms - start_ms) AS longest_ms FROM utt GROUP BY 1""",
    "partial_ticks": f"WITH {_UTT} SELECT session_id, idx, CAST(tick AS INTEGER) AS tick, start_ms + tick * 64.0 AS at_ms FROM (SELECT *, unnest(range(1, CAST(floor((end_ms - start_ms) / 64) AS BIGINT) + 1)) AS tick FROM utt)",
    "quietest_split": f"WITH {FRAMES} SELECT session_id, coalesce(arg_min(frame_idx, (power, frame_idx)) FILTER (frame_idx >= 25 AND frame_idx < 40) + 1, 40) AS cut FROM frames GROUP BY 1",
    "quietest_split_late": f"WITH {FRAMES} SELECT session_id, coalesce(arg_min(frame_idx, (floor(power), -frame_idx)) FILTER (frame_idx >= 25 AND frame_idx < 40) + 1, 40) AS cut FROM frames GROUP BY 1",
    "tail_windows": f"WITH {_UTT} SELECT session_id, idx, greatest(start_ms, end_ms - 200) AS tail_ms, CAST(floor(start_ms * 16) * 2 AS BIGINT) AS from_byte, floor(end_ms * 16) * 2 / 32.0::DOUBLE AS to_ms FROM utt",
    "utterance_cuts": f"""WITH {_UTT} SELECT session_id, idx, part, CASE part WHEN 0 THEN start_ms ELSE start_ms + 100 END AS start_ms, CASE WHEN part = 0 AND start_ms + 100 < end_ms THEN start_ms + 100 ELSE end_ms END AS end_ms, reason, false AS continues_previous
FROM utt, (VALUES (0), (1)) p(part) WHERE part = 0 OR start_ms + 100 < end_ms""",
    "reframe": f"WITH {_CHUNKS}, f AS (SELECT session_id, unnest(range(0, length(h) // 2048)) AS frame_idx, h FROM w) SELECT session_id, frame_idx, md5(unhex(substr(h, frame_idx * 2048 + 1, 2048))) AS pcm_md5 FROM f",
    "reframe_padded": f"WITH {_CHUNKS} SELECT session_id, CAST(ceil(length(h) / 8192) AS BIGINT) AS frames, CAST(ceil(length(h) / 8192) * 4096 AS BIGINT) AS bytes FROM w WHERE length(h) > 0",
    "chunk_counts": "SELECT source AS session_id, count(*) AS chunks, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1",
    "fixed_windows": f"""WITH {FRAMES}, v AS (SELECT session_id, list(power ORDER BY frame_idx) AS v FROM frames GROUP BY 1)
SELECT session_id, CAST(ceil(len(v) / 10) AS INTEGER) AS windows, round(list_sum(v[CAST((ceil(len(v) / 10) - 1) * 10 + 1 AS BIGINT):]), 6) AS last_sum, 128 AS filled, round(v[(127 % len(v)) + 1], 6) AS last_filled, round(list_sum(v[-5:]), 6) AS tail_sum FROM v""",
    "arrival_gaps": f"""WITH {FRAMES}, g AS (SELECT session_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) / 1000000.0::DOUBLE AS p, min(epoch_us(ts)) OVER (PARTITION BY session_id) / 1000000.0::DOUBLE AS f FROM frames)
SELECT session_id, p - f AS at_s, s - p AS waited_s FROM g WHERE s - p > 86400""",
    "delivery_report": f"""WITH {FRAMES}, g AS (SELECT session_id, power, epoch_us(ts) / 1000000.0::DOUBLE AS s, epoch_us(ts) / 1000000.0::DOUBLE - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) / 1000000.0::DOUBLE AS gap FROM frames)
SELECT session_id, count(*) AS chunks, count(*) FILTER (NOT power > 1) AS malformed, max(gap) AS largest_gap_s, count(*) * 3600.0 - (max(s) - min(s)) AS drift_s FROM g GROUP BY 1""",
}
