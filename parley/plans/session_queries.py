"""Queries of session quality and drift."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import BLANKS, MARKS
from parley.operators import drift as dr
from parley.operators import quality as ql
from parley.plans import stream_queries as sq
from parley.plans import text_queries as tq
from parley.plans.bind import FRAMES, TURNS, frames, spread, table, turns
from parley.sources import sinks
from parley.streaming import sessions as ss
from parley.streaming import transcripts as st


def timings(spark, d):
    f = frames(spark, d)
    return f.select("session_id", F.col("frame_idx").alias("seq"), F.floor(F.col("frame_idx") / 4).cast("long").alias("item_id"), F.col("label").alias("stage"), (F.col("power") / 100).alias("seconds"), F.lit(0.2).alias("audio_seconds"))


TIMINGS = f"{FRAMES}, tm AS (SELECT session_id, frame_idx // 4 AS item_id, label AS stage, power / 100 AS seconds, 0.2::DOUBLE AS audio_seconds FROM frames)"


def stage_cost(spark, d):
    return ql.stage_cost(timings(spark, d), order="seq")


def slow_items(spark, d):
    out = ql.slow_items(timings(spark, d), ["session_id", "item_id"], order="seq")
    return out.select("session_id", "item_id", "total", "worst", F.array_join(F.map_keys("breakdown"), ",").alias("stages"))


def circuit_breaker(spark, d):
    f = frames(spark, d)
    runs = f.select("session_id", F.col("label").alias("stage"), F.col("frame_idx").alias("seq"), (F.col("power") > 60).alias("failed"), F.when(F.col("power") > 300, "CUDA error").otherwise("other").alias("message"))
    return ql.circuit_breaker(runs, ["session_id", "stage"])


def lag_events(spark, d):
    f = frames(spark, d)
    first = F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(W.partitionBy("session_id"))
    return f.select("session_id", "frame_idx", (F.col("frame_idx") * 3_600_000.0).alias("at_ms"), ((F.unix_micros(F.col("ts").cast("timestamp")) - first) / 1_000_000).alias("arrived_s"))


def event_lag(spark, d):
    return ql.event_lag(lag_events(spark, d))


def corrected_lag(spark, d):
    gaps = sq.gaps(spark, d).select("session_id", F.col("at_s").alias("gap_at_s"), "waited_s")
    return ql.corrected_lag(ql.event_lag(lag_events(spark, d)), gaps).select("session_id", "frame_idx", F.round("corrected_ms", 3).alias("corrected_ms"))


LAG = f"""{FRAMES}, le AS (SELECT session_id, frame_idx, frame_idx * 3600000.0::DOUBLE AS at_ms, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY session_id)) / 1000000.0::DOUBLE AS arrived_s FROM frames),
lg AS (SELECT *, arrived_s * 1000 - at_ms AS lag_ms FROM le),
gp AS (SELECT session_id, p AS gap_at_s, s - p AS waited_s FROM (SELECT session_id, arrived_s AS s, lag(arrived_s) OVER (PARTITION BY session_id ORDER BY frame_idx) AS p FROM le) WHERE s - p > 86400),
gm AS (SELECT session_id, (gap_at_s - coalesce(sum(waited_s) OVER (PARTITION BY session_id ORDER BY gap_at_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * 1000 AS at_ms, waited_s FROM gp)"""


def judgeable(spark, d):
    r = sq.delivery(spark, d)
    g = sq.gaps(spark, d).groupBy("session_id").agg(F.sum("waited_s").alias("gaps_s"))
    own = r.join(g, "session_id", "left")
    wall = F.col("chunks") * 3600.0 - F.col("drift_s")
    return own.select("session_id", ql.judgeable(wall, F.col("chunks") * 3600.0, F.coalesce("gaps_s", F.lit(0.0))).alias("ok"))


def latency(spark, d):
    return ql.latency_report(timings(spark, d), ["session_id"])


def cadence(spark, d):
    return ql.partial_cadence(sq.ticks(spark, d), ["session_id"], 500.0)


def sentence_gaps(spark, d):
    return ql.sentence_gaps(frames(spark, d), "session_id", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0), ["ts", "event_id"])


def check_session(spark, d):
    short = F.col("end_ms") - F.col("start_ms") <= 100
    u = sq.plain_utterances(spark, d).withColumns({"continues_previous": F.col("reason") == "pause", "kept": ~short, "label": F.when(F.col("idx") % 2 == 0, F.col("reason")).otherwise("")})
    t = tq.judged(spark, d)
    return ql.check_session(u, t.select("session_id", "sentence_id", "speaker_id", "transcript", "lang_code"), t.where("sentence_id % 4 <> 2"), longest_ms=400.0)


def check_events(spark, d):
    t = frames(spark, d)
    return ql.check_events(sq.segment_events(spark, d), sq.plain_utterances(spark, d), t.select("session_id", (F.col("frame_idx") + F.col("session_id") % 3).alias("seq")), t.where("prob > 0.5").select("session_id", F.col("frame_idx").alias("seq")))


def check_partition(spark, d):
    return ql.check_partition(sq.plain_utterances(spark, d), sq.segments(spark, d), 32.0)


def session_summary(spark, d):
    t = tq.judged(spark, d).where("sentence_id % 4 <> 2")
    return ql.session_summary(
        turns(spark, d), t, sq.plain_utterances(spark, d), chunks=frames(spark, d).withColumn("bytes", F.lit(1024)), segments=sq.segments(spark, d), partials=sq.ticks(spark, d),
        flips=dr.language_flips(texts(spark, d)), runs=circuit_breaker(spark, d), timings=timings(spark, d),
    )


def texts(spark, d):
    """Turns as running and committed texts: each turn's beginning, then all of it."""
    t = spread(turns(spark, d), "session_id").withColumn("is_final", F.explode(F.array(F.lit(False), F.lit(True))))
    n, final = F.col("sentence_id"), F.col("is_final")
    begun = F.expr("left(transcript, cast(length(transcript) * (sentence_id % 4 + 1) / 4 as int))")
    lang = F.when(final & (n % 3 == 0), "ja").when(F.col("speaker_id") == "user", "vi").otherwise("ja")
    own = t.select("session_id", (n * 2 + F.when(final, 1).otherwise(0)).alias("seq"), "is_final", F.when(final, F.col("transcript")).otherwise(begun).alias("transcript"), lang.alias("lang_code"))
    return own.where("not is_final or seq % 10 <> 9")


TEXTS = f"""{TURNS}, tx AS (SELECT session_id, sentence_id * 2 AS seq, false AS is_final, left(transcript, length(transcript) * (sentence_id % 4 + 1) // 4) AS transcript, CASE speaker_id WHEN 'user' THEN 'vi' ELSE 'ja' END AS lang_code FROM turns
UNION ALL SELECT session_id, sentence_id * 2 + 1, true, transcript, CASE WHEN sentence_id % 3 = 0 THEN 'ja' WHEN speaker_id = 'user' THEN 'vi' ELSE 'ja' END FROM turns WHERE (sentence_id * 2 + 1) % 10 <> 9),
gx AS (SELECT *, coalesce(sum(CAST(is_final AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM tx),
lp AS (SELECT * FROM (SELECT *, last_value(CASE WHEN NOT is_final THEN transcript END IGNORE NULLS) OVER (PARTITION BY session_id, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS partial FROM gx) WHERE is_final)"""


def far_from_partial(spark, d):
    return dr.far_from_partial(texts(spark, d)).select("session_id", "seq", "rewritten")


def update_survival(spark, d):
    return dr.update_survival(texts(spark, d))


def lost_turns(spark, d):
    return dr.lost_turns(texts(spark, d))


def near_blocks(spark, d):
    """Lines of all documents against those of toxic ones of low quality."""
    docs = table(spark, d, "documents")
    toxic = docs.join(table(spark, d, "labels").where("toxic = 1 and quality = 0").select("doc_id"), "doc_id", "left_semi")
    lines = toxic.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    finals = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("transcript"))
    return dr.near_block_list(finals, lines, ["doc_id"]).select("doc_id", F.md5("line").alias("line_md5"), "distance")


def mixed_language(spark, d):
    jp = F.when(F.col("sentence_id") % 3 == 0, F.concat(F.expr("repeat('プ', cast(length(transcript) div 4 as int))"), F.col("transcript"))).otherwise(F.col("transcript"))
    return dr.mixed_language(turns(spark, d).withColumn("transcript", jp)).select("session_id", "sentence_id", "ratio")


def artifacts(spark, d):
    return dr.text_artifacts(table(spark, d, "documents").withColumn("transcript", F.col("text")), ["doc_id"])


def refused_translations(spark, d):
    return dr.refused_translations(tq.judged(spark, d))


def language_disagrees(spark, d):
    return dr.language_disagrees(texts(spark, d))


def compare_runs(spark, d):
    """The drift metrics of all sessions, in three runs of sessions."""
    parts = {"far_from_partial": far_from_partial, "lost_turns": lost_turns, "refused_translations": refused_translations, "language_disagrees": language_disagrees}
    own = None
    for name, query in parts.items():
        rows = query(spark, d)
        value = next((F.col(c) for c in ("refused", "disagrees") if c in rows.columns), F.lit(1))
        m = rows.select(F.lit(name).alias("metric"), F.concat(F.lit("r"), F.col("session_id") % 3).alias("run"), value.cast("long").alias("value"))
        own = m if own is None else own.unionByName(m)
    return dr.compare_runs(own, ["r0", "r1", "r2"])


def agreed(spark, d):
    return dr.agreed_prefix(texts(spark, d)).select("session_id", "seq", "agreed")


def joined(spark, d):
    t = turns(spark, d)
    # the next piece begins with the last three words of this one
    words = F.split(F.trim("transcript"), r"\s+")
    a, b = F.col("transcript"), F.concat_ws(" ", F.slice(words, -F.least(F.size(words), F.lit(3)), 3), F.lit("and"), F.col("transcript"))
    return t.select("session_id", "sentence_id", F.md5(dr.join_without_repeats(a, b)).alias("joined_md5"))


def confirmed(spark, d):
    f = frames(spark, d)
    runs = f.select("session_id", (F.col("frame_idx") % 7).alias("sentence_id"), F.floor(F.col("frame_idx") / 7).cast("long").alias("run"), "label")
    return dr.confirmed_corrections(runs, ["session_id", "sentence_id"])


def confirm_language(spark, d):
    from parley.plans import score_queries as sc

    return dr.confirm_language(sc.decided(spark, d), least=0.5).select("session_id", "seq", "confirmed")


def hops(spark, d):
    return ss.hop_windows(frames(spark, d), 10, 4)


def _folder(spark):
    """A folder that driver and executors share, from the session; a temporary one only on a local session without it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-")
    return f"{at}/stream-{uuid.uuid4().hex}"


def voice_stream(spark, d):
    ss.use_rocksdb(spark)
    e = spark.readStream.schema(table(spark, d, "embeddings").schema).parquet(f"{d}/embeddings.parque[t]")
    own = e.select(F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("sentence_id"), "embedding")
    return ss.drain(ss.assign_voice_stream(own), _folder(spark)).withColumn("similarity", F.round("similarity", 6))


def _messages(spark, d, folder):
    """The message log as a stream of files."""
    log = tq.message_log(spark, d)
    log.write.parquet(f"{folder}/log")
    return spark.readStream.schema(log.schema).parquet(f"{folder}/log")


def fold_stream(spark, d):
    """The log folded by keyed state into the replay-safe transcript table."""
    ss.use_rocksdb(spark)
    folder = _folder(spark)
    write = sinks.upsert_transcript(spark, f"{folder}/transcript", order="version", buckets=8)
    run = st.fold_stream(_messages(spark, d, folder)).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return sinks.read_transcript(spark, f"{folder}/transcript").select("session_id", "sentence_id", "speaker_id", "relabelled", "answered", "reason", F.md5("translation").alias("translation_md5"))


def corrections_stream(spark, d):
    """The sentences whose speaker was put right, as a stream of the folded log gives them."""
    ss.use_rocksdb(spark)
    folder = _folder(spark)
    return ss.drain(st.fold_stream(_messages(spark, d, folder)).where("relabelled").select("session_id", "sentence_id", "speaker_id"), folder)


def backlog_stream(spark, d):
    """Jobs of all sessions that nobody answers, until each session's end."""
    ss.use_rocksdb(spark)
    folder = _folder(spark)
    f = frames(spark, d)
    jobs = f.select("session_id", F.col("frame_idx").alias("seq"), F.when(F.col("frame_idx") % 3 != 0, "job").otherwise("partial").alias("kind"), F.col("frame_idx").alias("sentence_id"))
    ends = f.groupBy("session_id").agg(F.count("*").alias("seq")).select("session_id", "seq", F.lit("bye").alias("kind"), F.lit(None).cast("long").alias("sentence_id"))
    own = jobs.unionByName(ends)
    own.write.parquet(f"{folder}/log")
    return ss.drain(st.backlog_stream(spark.readStream.schema(own.schema).parquet(f"{folder}/log")), folder)


QUERIES = {
    "fold_stream": fold_stream, "corrections_stream": corrections_stream, "backlog_stream": backlog_stream, "refused_translations": refused_translations, "language_disagrees": language_disagrees,
    "voice_stream": voice_stream,
    "stage_cost": stage_cost, "slow_items": slow_items, "circuit_breaker": circuit_breaker, "event_lag": event_lag, "corrected_lag": corrected_lag, "judgeable": judgeable,
    "latency_report": latency, "partial_cadence": cadence, "sentence_gaps": sentence_gaps, "check_session": check_session, "check_events": check_events, "check_partition": check_partition, "session_summary": session_summary,
    "far_from_partial": far_from_partial, "update_survival": update_survival, "lost_turns": lost_turns, "near_block_list": near_blocks, "mixed_language": mixed_language,
    "text_artifacts": artifacts, "compare_runs": compare_runs, "agreed_prefix": agreed, "join_without_repeats": joined, "confirmed_corrections": confirmed,
    "confirm_language": confirm_language, "hop_windows": hops,
}

#: SQL counts edits of bytes: every letter of the tables that is not ASCII gets a control character of its own, so that bytes are characters.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = "translate({0}, '" + _LETTERS + "', " + " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 32)][: len(_LETTERS)]) + ")"
_CHECK = "SELECT session_id, unnest(['{0}']) AS name, unnest([{1}]) AS failures FROM {2}"
SQL = {
    "stage_cost": f"""WITH {TIMINGS}, e AS (SELECT session_id, stage, sum(seconds) AS seconds, sum(audio_seconds) AS a FROM tm GROUP BY 1, 2)
SELECT session_id, stage, seconds, seconds / max(a) OVER (PARTITION BY session_id) AS share, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seconds DESC, stage) AS INTEGER) AS rank FROM e""",
    "slow_items": f"""WITH {TIMINGS}, e AS (SELECT session_id, item_id, stage, sum(seconds) AS s FROM tm GROUP BY 1, 2, 3)
SELECT session_id, item_id, sum(s) AS total, arg_max(stage, (s, stage)) AS worst, string_agg(stage, ',' ORDER BY stage) AS stages FROM e GROUP BY 1, 2 HAVING sum(s) >= 1""",
    "circuit_breaker": f"""WITH {FRAMES}, r AS (SELECT session_id, label AS stage, frame_idx AS seq, power > 60 AS failed, CASE WHEN power > 300 THEN 'CUDA error' ELSE 'other' END AS message FROM frames),
t AS (SELECT *, sum(CAST(failed AS INTEGER)) OVER (PARTITION BY session_id, stage ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 OR (failed AND message = 'CUDA error') AS trip FROM r),
a AS (SELECT *, min(seq) FILTER (trip) OVER (PARTITION BY session_id, stage) AS a FROM t) SELECT session_id, stage, seq, failed, message, coalesce(seq > a, false) AS skipped, coalesce(seq = a, false) AS notice FROM a""",
    "event_lag": f"WITH {LAG} SELECT * FROM lg",
    "corrected_lag": f"""WITH {LAG} SELECT session_id, frame_idx, round(lag_ms - coalesce((SELECT sum(waited_s) FROM gm WHERE gm.session_id = lg.session_id AND gm.at_ms <= lg.at_ms), 0) * 1000, 3) AS corrected_ms FROM lg""",
    "judgeable": f"""WITH {LAG}, w AS (SELECT session_id, max(arrived_s) AS wall, count(*) * 3600.0 AS audio FROM le GROUP BY 1), s AS (SELECT session_id, sum(waited_s) AS g FROM gp GROUP BY 1)
SELECT session_id, wall - audio - coalesce(g, 0) <= 1 AS ok FROM w LEFT JOIN s USING (session_id)""",
    "latency_report": f"""WITH {TIMINGS}, r AS (SELECT session_id, seconds AS v, row_number() OVER (PARTITION BY session_id ORDER BY seconds) AS r, count(*) OVER (PARTITION BY session_id) AS n FROM tm)
SELECT session_id, count(*) AS n, avg(v) AS mean, max(v) AS worst, {", ".join(f"max(v) FILTER (r = greatest(1, least(n, CAST(round_even(n * {s}, 0) AS BIGINT)))) AS p{round(s * 100)}" for s in (0.5, 0.9, 0.99))} FROM r GROUP BY 1""",
    "partial_cadence": f"""WITH {sq._UTT}, tk AS (SELECT session_id, start_ms + tick * 64.0 AS at_ms FROM (SELECT *, unnest(range(1, CAST(floor((end_ms - start_ms) / 64) AS BIGINT) + 1)) AS tick FROM utt)),
g AS (SELECT session_id, at_ms - lag(at_ms) OVER (PARTITION BY session_id ORDER BY at_ms) AS g FROM tk) SELECT session_id, coalesce(max(g), 0) AS largest_gap_ms, coalesce(max(g), 0) <= 1000 AS ok FROM g GROUP BY 1""",
    "sentence_gaps": f"""WITH {FRAMES}, g AS (SELECT session_id, epoch_us(ts) / 1000000.0::DOUBLE - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, event_id) / 1000000.0::DOUBLE AS g FROM frames)
SELECT session_id, count(g) AS n, quantile_cont(g, 0.5) AS median_gap_s, min(g) AS shortest_gap_s, CASE WHEN min(g) > 0 THEN 1 / min(g) END AS busiest_per_s FROM g GROUP BY 1""",
    "check_session": f"""WITH {sq._UTT}, {tq.ASKED}, u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS i, lag(end_ms) OVER (PARTITION BY session_id ORDER BY idx) AS e FROM utt),
a AS (SELECT session_id, count(*) FILTER (idx <> i) AS c1, count(*) FILTER (end_ms - start_ms > 400) AS c2, count(*) FILTER (start_ms < e) AS c3, count(*) FILTER (end_ms <= start_ms) AS c4,
  count(*) FILTER (reason = 'pause' AND abs(start_ms - e) >= 1) AS c5, count(*) FILTER (end_ms - start_ms <= 100 AND idx % 2 = 1) AS c6 FROM u GROUP BY 1),
b AS (SELECT session_id, count(*) FILTER (trim(transcript) = '') AS c1, count(*) FILTER (speaker_id IS NULL) AS c2, count(*) FILTER (sentence_id % 4 = 2) AS c3, count(*) FILTER (sentence_id % 4 = 2) AS c4,
  count(*) FILTER (sentence_id % 4 <> 2 AND reason = '' AND t = transcript) AS c5,
  count(*) FILTER (lang_code = '') AS c6, count(*) FILTER (sentence_id % 4 <> 2 AND starts_with(reason, 'the answer') AND coalesce(cleaned, '') = '') AS c7 FROM ans GROUP BY 1),
x AS (SELECT session_id, unnest(['indexes are consecutive', 'no utterance is too long', 'utterances do not overlap', 'utterances have length', 'a continuation has no gap', 'what is dropped has a label']) AS name, unnest([c1, c2, c3, c4, c5, c6]) AS failures FROM a
UNION ALL SELECT session_id, unnest(['finals have text', 'finals have a speaker', 'finals are answered', 'no silent refusal', 'no answer is its source', 'finals have a language', 'a refused answer shows its text']), unnest([c1, c2, c3, c4, c5, c6, c7]) FROM b)
SELECT session_id, name, failures = 0 AS passed, failures FROM x""",
    "check_events": f"""WITH {sq._UTT}, e AS (SELECT *, lag(kind) OVER (PARTITION BY session_id ORDER BY at_ms, kind) AS b FROM seg_events),
t AS (SELECT session_id, count(*) FILTER (b = kind) AS c1, abs(count(*) FILTER (kind = 'speech_start') - count(*) FILTER (kind = 'speech_end')) AS c2, count(*) FILTER (kind = 'speech_end') AS ends FROM e GROUP BY 1),
n AS (SELECT session_id, count(*) AS n FROM utt GROUP BY 1), f AS (SELECT session_id, min(frame_idx + session_id % 3) AS p, min(frame_idx) FILTER (prob > 0.5) AS f FROM frames GROUP BY 1),
x AS (SELECT session_id, unnest(['starts and ends alternate', 'as many starts as ends', 'no end without an utterance', 'running text comes first']) AS name,
  unnest([c1, c2, greatest(0, ends - coalesce(n, 0)), CASE WHEN p >= f THEN 1 ELSE 0 END]) AS failures FROM t LEFT JOIN n USING (session_id) LEFT JOIN f USING (session_id))
SELECT session_id, name, failures = 0 AS passed, failures FROM x""",
    "check_partition": f"""WITH {sq._UTT}, s AS (SELECT session_id, sum((end_frame - start_frame) * 32.0::DOUBLE) AS forwarded_ms FROM segments GROUP BY 1),
b AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM utt),
u AS (SELECT session_id, sum(end_ms - start_ms) AS audio_ms, count(*) FILTER (start_ms < b) AS twice FROM b GROUP BY 1)
SELECT session_id, audio_ms, twice, forwarded_ms, coalesce(audio_ms = forwarded_ms AND twice = 0, false) AS covered FROM u FULL JOIN s USING (session_id)""",
    "session_summary": f"""WITH {sq._UTT}, {tq.ASKED}, f AS (SELECT session_id, count(*) AS sentences, sum(length(transcript)) AS chars, count(DISTINCT speaker_id) AS speakers FROM turns GROUP BY 1),
a AS (SELECT session_id, count(*) AS answers, count(*) FILTER (reason = '' AND length(t) > 0) AS translated, count(*) FILTER (reason <> '') AS refused, count(*) FILTER (reason <> '' AND starts_with(reason, 'too late')) AS dropped,
  count(DISTINCT lang_code) FILTER (lang_code <> '') AS languages, count(*) FILTER (lang_code <> '') AS with_language FROM ans WHERE sentence_id % 4 <> 2 GROUP BY 1),
u AS (SELECT session_id, count(*) AS utterances, sum(end_ms - start_ms) AS audio_ms, max(end_ms - start_ms) AS longest_ms, sum(greatest(0, floor((end_ms - start_ms) / 64))) AS partials FROM utt GROUP BY 1),
ch AS (SELECT session_id, count(*) AS chunks, count(*) * 1024 AS bytes FROM frames GROUP BY 1), sg AS (SELECT session_id, count(*) AS segments FROM segments GROUP BY 1),
it AS (SELECT session_id, frame_idx // 4 AS item_id, sum(power / 100) AS s FROM frames GROUP BY 1, 2), ti AS (SELECT session_id, sum(s) AS stage_seconds, max(s) AS slowest_item_s FROM it GROUP BY 1)
SELECT session_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("sentences", "chars", "speakers", "answers", "translated", "refused", "dropped", "languages", "with_language", "utterances", "chunks", "bytes", "segments", "partials", "language_flips", "stage_failures", "stages_disabled"))},
{", ".join(f"coalesce({c}, 0) AS {c}" for c in ("audio_ms", "longest_ms", "stage_seconds", "slowest_item_s"))}
FROM f FULL JOIN a USING (session_id) FULL JOIN u USING (session_id) FULL JOIN ch USING (session_id) FULL JOIN sg USING (session_id) FULL JOIN ti USING (session_id)
FULL JOIN (SELECT session_id, count(*) AS language_flips FROM (@flips) GROUP BY 1) fp USING (session_id)
FULL JOIN (SELECT session_id, count(*) FILTER (failed AND NOT skipped) AS stage_failures, count(*) FILTER (notice) AS stages_disabled FROM (@runs) GROUP BY 1) rn USING (session_id)""",
    "far_from_partial": f"WITH {TEXTS}, r AS (SELECT session_id, seq, levenshtein({_BYTES.format("partial")}, {_BYTES.format("transcript")}) / greatest(length(partial), length(transcript), 1) AS rewritten FROM lp WHERE partial IS NOT NULL) SELECT * FROM r WHERE rewritten > 0.6",
    "update_survival": f"""WITH {TEXTS}, b AS (SELECT *, lag(transcript) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM tx),
n AS (SELECT session_id, length(b) AS l, coalesce(list_position(list_transform(range(1, least(length(b), length(transcript)) + 1), lambda i: b[i] = transcript[i]), false) - 1, least(length(b), length(transcript))) AS k FROM b WHERE length(b) > 0)
SELECT session_id, count(*) AS updates, avg(k / l) AS survival FROM n GROUP BY 1""",
    "lost_turns": f"""WITH {TEXTS}, p AS (SELECT *, lag(lang_code) OVER (PARTITION BY session_id ORDER BY seq) AS p FROM tx), r AS (SELECT *, sum(CASE WHEN p = lang_code THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM p)
SELECT session_id, CAST(run AS BIGINT) AS run, any_value(lang_code) AS lang, count(*) FILTER (NOT is_final) AS partials FROM r GROUP BY 1, 2 HAVING count(*) FILTER (is_final) = 0 AND count(*) FILTER (NOT is_final) > 0 AND run > 1""",
    "mixed_language": f"""WITH {TURNS}, j AS (SELECT session_id, sentence_id, CASE WHEN sentence_id % 3 = 0 THEN length(transcript) // 4 ELSE 0 END AS k, length(regexp_replace(transcript, '\\P{{L}}', '', 'g')) AS n FROM turns),
r AS (SELECT session_id, sentence_id, CASE WHEN k + n > 0 THEN k / (k + n) END AS ratio FROM j) SELECT * FROM r WHERE ratio > 0.1 AND ratio < 0.9""",
    "text_artifacts": """WITH w AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') IF x <> ''] AS w FROM documents)
SELECT doc_id, regexp_matches(text, '(?:^|\\s)(?:\\p{L}\\s+){3,}\\p{L}(?:\\s|$)') AS letters_apart, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS INTEGER) AS repeats FROM w""",
    "confirmed_corrections": f"""WITH {FRAMES}, r AS (SELECT session_id, frame_idx % 7 AS sentence_id, frame_idx // 7 AS run, label FROM frames), l AS (SELECT *, lag(label) OVER w AS l, lag(run) OVER w AS p FROM r WINDOW w AS (PARTITION BY session_id, sentence_id ORDER BY run))
SELECT session_id, sentence_id, run, label FROM l WHERE l = label AND p = run - 1""",
    "hop_windows": f"WITH {FRAMES} SELECT session_id, w AS window_idx, count(*) AS n, avg(power) AS level FROM (SELECT *, unnest(range(greatest(CAST(floor((frame_idx - 10) / 4.0) AS BIGINT) + 1, 0), frame_idx // 4 + 1)) AS w FROM frames) GROUP BY 1, 2",
}
_EXACT = "lower(regexp_replace({0}, '[" + (BLANKS + MARKS).replace("'", "''").replace("{", "{{").replace("}", "}}") + "]', '', 'g'))"
SQL["near_block_list"] = f"""WITH plain AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
b AS (SELECT DISTINCT line, {_EXACT.format('line')} AS l FROM plain JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0), f AS (SELECT doc_id, {_EXACT.format('line')} AS t FROM plain),
p AS (SELECT DISTINCT t, l FROM (SELECT DISTINCT t FROM f WHERE t <> '') JOIN (SELECT DISTINCT l FROM b WHERE l <> '') ON length(l) BETWEEN 0.75 * length(t) AND length(t) / 0.75),
m AS (SELECT t, l, levenshtein({_BYTES.format("t")}, {_BYTES.format("l")}) / greatest(length(t), length(l), 1) AS distance FROM p)
SELECT DISTINCT doc_id, md5(line) AS line_md5, distance FROM m JOIN f USING (t) JOIN b USING (l) WHERE distance > 0 AND distance <= 0.25"""
SQL["agreed_prefix"] = f"""WITH {TEXTS}, w AS (SELECT session_id, seq, string_split(trim(regexp_replace(transcript, '\\s+', ' ', 'g')), ' ') AS w FROM tx), b AS (SELECT *, lag(w) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM w),
n AS (SELECT session_id, seq, CASE WHEN b IS NULL THEN 0 ELSE coalesce(list_position(list_transform(range(1, greatest(len(w), len(b)) + 1), lambda i: coalesce(w[i] = b[i], false)), false) - 1, len(w)) END AS n FROM b)
SELECT session_id, seq, CAST(max(n) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS agreed FROM n"""
from parley.plans.score_queries import ASSIGNED_ALL, LANG_SCORES  # noqa: E402

SQL["voice_stream"] = ASSIGNED_ALL

SQL["confirm_language"] = f"""WITH {LANG_SCORES}, l AS (SELECT session_id, seq, CASE WHEN margin >= 0.5 AND lang_code <> '' THEN lang_code END AS l FROM decided),
t AS (SELECT *, CASE WHEN l = lag(l) OVER (PARTITION BY session_id ORDER BY seq) THEN l END AS t FROM l)
SELECT session_id, seq, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '') AS confirmed FROM t"""

_PARTS = "transcript AS a, array_to_string(regexp_split_to_array(trim(transcript), '\\s+')[-3:], ' ') || ' and ' || transcript AS b"
SQL["join_without_repeats"] = f"""WITH {TURNS}, p AS (SELECT session_id, sentence_id, {_PARTS} FROM turns),
w AS (SELECT session_id, sentence_id, regexp_split_to_array(trim(a), '\\s+') AS x, regexp_split_to_array(trim(b), '\\s+') AS y FROM p),
n AS (SELECT *, coalesce(list_max([k FOR k IN range(1, 6) IF len(x) >= k AND len(y) >= k AND x[len(x) - k + 1:] = y[:k]]), 0) AS n FROM w)
SELECT session_id, sentence_id, md5(array_to_string(list_concat(x, y[n + 1:]), ' ')) AS joined_md5 FROM n"""

_FLIPS = f"""WITH {TEXTS}, p AS (SELECT *, last_value(CASE WHEN NOT is_final THEN lang_code END IGNORE NULLS) OVER (PARTITION BY session_id, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS predicted FROM gx)
SELECT session_id, seq FROM p WHERE is_final AND lang_code <> '' AND predicted <> '' AND predicted <> lang_code"""
SQL["session_summary"] = SQL["session_summary"].replace("@flips", _FLIPS).replace("@runs", SQL["circuit_breaker"])
SQL["language_disagrees"] = f"SELECT session_id, count(*) AS disagrees FROM ({_FLIPS}) GROUP BY 1"
SQL["refused_translations"] = f"WITH {tq.ASKED} SELECT session_id, count(*) AS refused FROM ans WHERE reason <> '' GROUP BY 1"
SQL["fold_stream"] = tq.SQL["fold_messages"]
SQL["corrections_stream"] = f"WITH {tq.FOLDED} SELECT session_id, sentence_id, speaker_id FROM fl WHERE relabelled"
SQL["backlog_stream"] = f"""WITH {FRAMES}, n AS (SELECT session_id, frame_idx AS sentence_id, row_number() OVER (PARTITION BY session_id ORDER BY frame_idx DESC) AS n FROM frames WHERE frame_idx % 3 <> 0)
SELECT session_id, sentence_id, CASE WHEN n > 16 THEN 'evicted: too many waiting' ELSE 'the session ended first' END AS reason FROM n"""
_DRIFT = {"far_from_partial": "1", "lost_turns": "1", "refused_translations": "refused", "language_disagrees": "disagrees"}
SQL["compare_runs"] = f"""WITH m AS ({" UNION ALL ".join(f"SELECT '{k}' AS metric, session_id % 3 AS run, {v} AS value FROM ({SQL[k]})" for k, v in _DRIFT.items())}),
c AS (SELECT metric, {", ".join(f"CAST(sum(value) FILTER (run = {i}) AS BIGINT) AS r{i}" for i in range(3))} FROM m GROUP BY 1) SELECT *, r1 - r0 AS r1_change, r2 - r0 AS r2_change FROM c"""
