"""Queries of guards, answers, transcripts, messages, quality and drift."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import answers as an
from parley.operators import drift as dr
from parley.operators import guards as gd
from parley.operators import quality as ql
from parley.operators import transcript as tr
from parley.plans import stream_queries as sq
from parley.plans.bind import FRAMES, TURNS, frames, spread, table, turns
from parley.sources import contract as ct
from parley.sources import lists, sinks

LANG = {"user": "xx", "assistant": "yy"}


def pieces(spark, d):
    """The lines of documents as decoded pieces of an utterance each; their figures come from the text itself."""
    own = spread(table(spark, d, "documents")).select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    n = F.length("text")
    return own.select(
        F.col("source").alias("session_id"), F.col("doc_id").alias("utt_id"), (F.shiftleft("doc_id", 32) + F.col("i")).alias("piece_idx"), "text",
        (n % 2000).cast("double").alias("duration_ms"), (-(n % 130) / 100).alias("avg_logprob"), ((n % 97) / 97).alias("no_speech_prob"), ((n % 61) / 25).alias("ratio"),
        (n % 83).cast("double").alias("decode_ms"), F.when(n % 5 == 0, "").otherwise(F.col("lang")).alias("detected"),
    )


PIECES = """lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
pieces AS (SELECT source AS session_id, doc_id AS utt_id, doc_id * 4294967296 + i AS piece_idx, text, CAST(length(text) % 2000 AS DOUBLE) AS duration_ms,
  -(length(text) % 130) / 100 AS avg_logprob, (length(text) % 97) / 97 AS no_speech_prob, (length(text) % 61) / 25 AS ratio,
  CAST(length(text) % 83 AS DOUBLE) AS decode_ms, CASE WHEN length(text) % 5 = 0 THEN '' ELSE lang END AS detected FROM lines)"""


def lines_of(spark, d, judged):
    """The lines of the documents with that label."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").where(judged).select("doc_id"), "doc_id", "left_semi")
    return docs.select(F.explode(F.split("text", "\n", -1)).alias("line"))


def block_list(spark, d):
    return lines_of(spark, d, "toxic = 1").select(F.concat("line", F.lit(" !")).alias("line"))


def keep_list(spark, d):
    return lines_of(spark, d, "quality = 0")


def judged_pieces(spark, d):
    own = gd.listed(pieces(spark, d), block_list(spark, d), ["the .* of"], keep_list(spark, d))
    return own.withColumn("reason", gd.refuse_reason(*(F.col(c) for c in ("text", "no_speech_prob", "avg_logprob", "ratio", "duration_ms", "invented"))))


_CLASS = (tx.BLANKS + tx.MARKS).replace("'", "''").replace("{", "{{").replace("}", "}}")
_EX = "lower(regexp_replace({0}, '[" + _CLASS + "]', '', 'g'))"
_SP = "trim(lower(regexp_replace({0}, '[" + _CLASS + "]+', ' ', 'g')), ' ')"
JUDGED = f"""{PIECES}, lab AS (SELECT text, toxic, quality FROM lines JOIN labels USING (doc_id)),
bl AS (SELECT DISTINCT {_EX.format("text || ' !'")} AS n FROM lab WHERE toxic = 1), kl AS (SELECT DISTINCT {_EX.format("text")} AS n FROM lab WHERE quality = 0),
ls AS (SELECT *, ({_EX.format('text')} IN (SELECT n FROM bl WHERE n <> '') OR regexp_full_match({_SP.format('text')}, 'the .* of')) AND {_EX.format('text')} NOT IN (SELECT n FROM kl) AS invented FROM pieces),
judged AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN no_speech_prob > 0.6 AND (duration_ms < 600 OR avg_logprob <= -1) THEN 'no speech' WHEN avg_logprob < -1 THEN 'low confidence'
  WHEN ratio > 2.4 THEN 'repetition' WHEN invented THEN 'known hallucination' ELSE '' END AS reason FROM ls)"""


def refuse_reason(spark, d):
    return judged_pieces(spark, d).select("session_id", "piece_idx", "invented", "reason")


def norm_forms(spark, d):
    return pieces(spark, d).select("piece_idx", F.md5(tx.norm_exact(F.col("text"))).alias("exact_md5"), F.md5(tx.norm_spaced(F.col("text"))).alias("spaced_md5"))


def assembled(spark, d):
    out = gd.assemble(judged_pieces(spark, d), ["session_id", "utt_id"], detected="detected")
    return out.select("session_id", "utt_id", F.md5("transcript").alias("transcript_md5"), "kept", "dropped", "dropped_reasons", "lang_code")


def transcript_stats(spark, d):
    return gd.transcript_stats(judged_pieces(spark, d), ["session_id"])


def kept_despite_silence(spark, d):
    return gd.kept_despite_silence(judged_pieces(spark, d)).select("session_id", "piece_idx", "no_speech_prob")


def refusal_report(spark, d):
    return gd.refusal_report(judged_pieces(spark, d), ["session_id"], F.col("duration_ms") > 1900)


def vocabulary_prompt(spark, d):
    return gd.vocabulary_prompt(table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("word")))


def compression(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.compression_ratio("text").alias("ratio"))


def wordlist(spark, d):
    """Lines of the documents as a word list file would have them."""
    return lists.entries(table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))).groupBy("line").agg(F.count("*").alias("n")).where("n > 1")


def asked(spark, d):
    """User turns as sentences, the next turn as their answer."""
    by = W.partitionBy("session_id").orderBy("sentence_id")
    t = spread(turns(spark, d), "session_id").withColumns({"raw": F.lead("transcript").over(by), "nxt": F.lead("speaker_id").over(by), "seq": F.col("sentence_id")})
    own = t.withColumns({"lang_code": F.when(F.col("sentence_id") % 5 == 4, "").otherwise(F.when(F.col("speaker_id") == "user", "ja").otherwise("vi")), "raw": F.when(F.col("sentence_id") % 4 == 3, F.concat("transcript", F.lit("!"))).when(F.col("sentence_id") % 7 == 2, F.concat(F.lit("Sure! Translation: \""), F.coalesce("raw", F.lit("")), F.lit("\""))).otherwise(F.col("raw"))})
    return own.withColumn("target", an.target_language(F.col("lang_code")))


ASKED = f"""{TURNS}, t0 AS (SELECT *, lead(transcript) OVER (PARTITION BY session_id ORDER BY sentence_id) AS nxt FROM turns),
asked AS (SELECT session_id, sentence_id, speaker_id, transcript, CASE WHEN sentence_id % 5 = 4 THEN '' WHEN speaker_id = 'user' THEN 'ja' ELSE 'vi' END AS lang_code,
  CASE WHEN sentence_id % 4 = 3 THEN transcript || '!' ELSE nxt END AS cleaned FROM t0),
tg AS (SELECT *, CASE lang_code WHEN 'ja' THEN 'vi' WHEN 'vi' THEN 'ja' ELSE '' END AS target, trim(coalesce(cleaned, '')) AS t FROM asked),
ans AS (SELECT *, CASE WHEN trim(coalesce(transcript, '')) = '' THEN 'nothing to translate' WHEN target = '' THEN 'the language was undecided' WHEN t = '' THEN 'there is no answer'
  WHEN lower(regexp_replace(transcript, '[^\\p{{L}}\\p{{N}}]', '', 'g')) = lower(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) THEN 'the answer repeats the source'
  WHEN target = 'ja' AND regexp_matches(t, '\\p{{L}}') THEN 'the answer is not written in ja'
  WHEN length(t) > length(transcript) * CASE target WHEN 'vi' THEN 2.0 ELSE 1.0 END + 50 THEN 'the answer is too long' ELSE '' END AS reason FROM tg)"""


def judged(spark, d):
    return an.judge_answer(asked(spark, d))


def judge_answer(spark, d):
    return judged(spark, d).select("session_id", "sentence_id", "target", "reason", F.md5("translation").alias("translation_md5"))


def translation_stats(spark, d):
    return an.translation_stats(judged(spark, d))


def expansion_stats(spark, d):
    return an.expansion_stats(judged(spark, d), ["target"])


def history(spark, d):
    own = an.turn_history(judged(spark, d), ["speaker_id", "transcript", "translation"])
    styles = [F.md5(an.render_history(F.col("history"), style)).alias(f"{style}_md5") for style in ("plain", "labelled", "sources")]
    return own.select("session_id", "sentence_id", *styles, F.size("history").alias("n"))


def prompts(spark, d):
    own = an.turn_history(asked(spark, d), ["transcript"]).withColumn("history_text", an.render_history(F.col("history")))
    return an.build_prompts(own).select("session_id", "sentence_id", "system_prompt", F.md5("user_prompt").alias("user_md5"))


def inferred(spark, d):
    def make():
        def client(asks):
            if any("\n\n" not in u for _, u in asks):
                raise ValueError("no history")
            return [u[::-1] for _, u in asks]

        return client

    own = an.turn_history(asked(spark, d), ["transcript"]).withColumn("history_text", an.render_history(F.col("history"))).drop("history")
    return an.infer(an.build_prompts(own), make).select("session_id", "sentence_id", F.md5("raw").alias("raw_md5"), "error")


def retried(spark, d):
    return an.retry_echoes(judged(spark, d), lambda: lambda asks: ["x" + u[-9:] for _, u in asks], ["session_id", "sentence_id"]).select("session_id", "sentence_id", "retried", "rescued", "reason")


def stale(spark, d):
    by = W.partitionBy("session_id").orderBy("ts", "event_id")
    j = frames(spark, d).withColumn("taken_at", F.lead("ts").over(by)).where("taken_at is not null")
    return an.drop_stale(j, "ts", budget_s=43_200.0).select("session_id", "frame_idx", "age_s", "stale", "reason")


def backlog(spark, d):
    j = frames(spark, d).select("session_id", F.col("frame_idx").alias("sentence_id"), (F.col("frame_idx") % 3 != 0).alias("waiting"))
    return an.bounded_backlog(j)


def leftovers(spark, d):
    t = turns(spark, d)
    return an.answer_leftovers(t.where("speaker_id = 'user'"), t.where("speaker_id = 'assistant'").withColumn("sentence_id", F.col("sentence_id") - 1), ["session_id", "sentence_id"])


def timed(spark, d):
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("session_id") * 1000 + F.col("sentence_id") * 7)
    return judged(spark, d).withColumn("arrived_at", start)


def answer_status(spark, d):
    t = timed(spark, d)
    a = t.where("sentence_id % 3 <> 1").withColumn("arrived_at", F.col("arrived_at") + F.expr("make_interval(0, 0, 0, 0, 0, 0, 3)"))
    return an.answer_status(t, a, ["session_id", "sentence_id"])


def message_log(spark, d):
    """finals, answers and relabellings of conversations as one log: the turns are judged once, and each gives its messages."""
    t = judged(spark, d).select("session_id", "sentence_id", "speaker_id", "lang_code", "transcript", "translation", "reason", "raw")
    own = t.withColumn("kind", F.explode(F.array(*map(F.lit, ("final", "partial", "translation", "speakers")))))
    own = own.where("kind in ('final', 'partial') or kind = 'translation' and sentence_id % 6 <> 5 or kind = 'speakers' and sentence_id % 3 = 2")
    n, of = F.col("sentence_id"), lambda kind, c: F.when(F.col("kind") == kind, c)
    late = n % 7 == 3
    return own.select(
        "session_id", (n * 10 + of("final", 0).when(F.col("kind") == "partial", -3).when(F.col("kind") == "translation", 14).otherwise(5)).alias("seq"), "kind",
        of("final", n).when(F.col("kind") == "translation", n + F.when(n == 4, 100).otherwise(0)).alias("sentence_id"),
        of("final", F.col("speaker_id")).alias("speaker_id"), of("final", F.col("lang_code")).alias("lang_code"), F.when(F.col("kind").isin("final", "partial"), F.col("transcript")).alias("transcript"),
        of("speakers", F.create_map((n - 1).cast("string"), F.lit("Speaker_09"), F.lit("999"), F.lit("Speaker_10"))).alias("labels"),
        of("translation", F.when(late, "").otherwise(F.col("translation"))).alias("translation"), of("translation", F.when(late, "too late (9 s)").otherwise(F.col("reason"))).alias("reason"), of("translation", F.col("raw")).alias("raw"),
    )


def folded(spark, d):
    return tr.fold_messages(message_log(spark, d))


def fold_messages(spark, d):
    return folded(spark, d).select("session_id", "sentence_id", "speaker_id", "relabelled", "answered", "reason", F.md5("translation").alias("translation_md5"))


FOLDED = f"""{ASKED}, fl AS (SELECT session_id, sentence_id, sentence_id * 10 AS seq, CASE WHEN relabelled THEN 'Speaker_09' ELSE speaker_id END AS speaker_id, relabelled, answered, transcript, lang_code,
  CASE WHEN answered THEN CASE WHEN sentence_id % 7 = 3 THEN 'too late (9 s)' ELSE reason END END AS reason, CASE WHEN answered THEN CASE WHEN reason = '' AND sentence_id % 7 <> 3 THEN t ELSE '' END END AS translation
  FROM (SELECT a.*, a.sentence_id % 6 <> 5 AND a.sentence_id <> 4 AS answered, n.sentence_id IS NOT NULL AND a.speaker_id <> 'Speaker_09' AS relabelled
    FROM ans a LEFT JOIN ans n ON n.session_id = a.session_id AND n.sentence_id = a.sentence_id + 1 AND n.sentence_id % 3 = 2))"""


def newest_rows(spark, d):
    return tr.keep_latest(folded(spark, d), n=3).select("session_id", "sentence_id")


def running_text(spark, d):
    log = message_log(spark, d)
    return tr.current_partial(log.where("not (kind = 'final' and session_id % 2 = 0 and seq > 20)"))


def transcript_counts(spark, d):
    return tr.transcript_counts(folded(spark, d), message_log(spark, d))


def speakers_in_order(spark, d):
    return tr.speakers_in_order(folded(spark, d)).select("session_id", F.array_join("speakers", ",").alias("speakers"))


def minutes(spark, d):
    return sinks.minutes(folded(spark, d)).select("session_id", F.md5("minutes").alias("minutes_md5"))


def event_log(spark, d):
    e = frames(spark, d)
    own = sinks.event_log(e.select("session_id", F.col("frame_idx").alias("seq"), F.col("ts").alias("arrived_at"), F.col("label").alias("kind"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("text")))
    return own


def meeting_names(spark, d):
    return frames(spark, d).groupBy("session_id").agg(sinks.meeting_folder(F.min("ts")).alias("folder"))


def raw_messages(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_id") % 11 == 0, F.lit("nope")).when(F.col("event_id") % 11 == 1, F.lit("[1]")).when(F.col("event_id") % 11 == 2, F.lit('{"type":"zzz"}')).when(F.col("event_id") % 11 == 3, F.col("props")).otherwise(F.to_json(F.struct(F.lit("partial").alias("type"), F.col("event_type").alias("transcript"))))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), raw.alias("raw"))


def parsed(spark, d):
    return ct.parse_messages(raw_messages(spark, d)).select("session_id", "seq", "kind", "problem")


def typed_partials(spark, d):
    return ct.typed(ct.parse_messages(raw_messages(spark, d)), "partial").groupBy("transcript").agg(F.count("*").alias("n"))


def hellos(spark, d):
    e = table(spark, d, "events")
    sid = F.when(F.col("event_id") % 5 == 0, F.lit('"session_id":"",')).when(F.col("event_id") % 5 == 1, F.lit('"session_id":7,')).otherwise(F.concat(F.lit('"session_id":"u'), F.col("user_id"), F.lit('",')))
    raw = F.concat(F.lit('{"type":"hello",'), sid, F.when(F.col("event_id") % 2 == 0, '"sample_rate":8000,').otherwise(""), F.lit('"other":1}'))
    m = ct.parse_hello(ct.parse_messages(e.select(F.col("event_id").alias("seq"), raw.alias("raw"))))
    bad = ct.contract_mismatch(m, {"sample_rate": 16_000, "channels": 1})
    return bad.select("seq", "sample_rate", "channels", "client", "problem", "mismatch")


def serialised(spark, d):
    v = frames(spark, d).select("session_id", "frame_idx", F.lit("speech_start").alias("event"), (F.col("frame_idx") * 32.0 + 0.5).alias("at_ms"))
    return v.select("session_id", "frame_idx", F.get_json_object(ct.to_messages(v, "vad"), "$.at_ms").cast("double").alias("at_ms"), F.get_json_object(ct.to_messages(v, "vad"), "$.type").alias("type"))


def round_trip(spark, d):
    """Finals, answers and running texts as messages, read back by their fields."""
    log, out = message_log(spark, d).withColumn("speech_score", F.lit(0.25)), None
    for kind, text in (("final", "transcript"), ("translation", "translation"), ("partial", "transcript")):
        own = log.where(F.col("kind") == kind)
        back = ct.typed(ct.parse_messages(own.select("session_id", "seq", ct.to_messages(own, kind).alias("raw"))), kind)
        rows = back.select("session_id", "seq", F.lit(kind).alias("kind"), (F.col("sentence_id") if kind != "partial" else F.lit(None).cast("long")).alias("sentence_id"), F.md5(text).alias("text_md5"))
        out = rows if out is None else out.unionByName(rows)
    return out


def message_kinds(spark, d):
    """Events as messages of the other six kinds, serialised and read back: a text, a number and a count of each."""
    f = frames(spark, d)
    known = {"session_id": F.concat(F.lit("s"), F.col("session_id").cast("string")), "protocol_version": F.lit(1), "sample_rate": F.lit(16_000), "channels": F.lit(1), "sample_width": F.lit(2), "chunk_ms": F.lit(200), "chunk_bytes": F.lit(6_400)}
    said = {
        "hello": ({"client": F.col("label")}, "client", None, "sample_rate"), "ready": ({}, "session_id", None, "chunk_bytes"), "bye": ({"reason": F.col("label")}, "reason", None, None),
        "error": ({"message": F.col("label"), "fatal": F.col("power") > 60}, "message", None, "fatal"),
        "speakers": ({"labels": F.create_map(F.col("event_id").cast("string"), F.col("label"))}, "labels", None, None),
        "utterance": ({"index": F.col("frame_idx"), "start_ms": F.col("power"), "end_ms": F.col("power") + 32, "duration_ms": F.lit(32.0), "reason": F.lit("pause"), "continues_previous": F.lit(False), "kept": F.lit(True), "speech_score": F.col("prob"), "speaker_id": F.col("label"), "lang_code": F.lit("")}, "speaker_id", "start_ms", "index"),
    }
    out = None
    for kind, (fields, text, number, count) in said.items():
        own = f.withColumns({"seq": F.col("event_id"), **known, **fields})
        back = ct.typed(ct.parse_messages(own.select("seq", ct.to_messages(own, kind).alias("raw"))), kind)
        told = F.element_at("labels", F.col("seq").cast("string")) if text == "labels" else F.col(text)
        rows = back.select("seq", F.lit(kind).alias("kind"), told.alias("said"), (F.col(number) if number else F.lit(None)).cast("double").alias("number"), (F.col(count) if count else F.lit(None)).cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def violations(spark, d):
    kind = F.when(F.col("label") == "click", "hello").when(F.col("label") == "purchase", "bye").when(F.col("label") == "view", "audio").otherwise("final")
    return ct.protocol_violations(frames(spark, d).select("session_id", F.col("frame_idx").alias("seq"), kind.alias("kind")))


def checked_chunks(spark, d):
    ok, bad = ct.split_valid(sq.byte_chunks(spark, d), [(F.octet_length("pcm") >= 1000, F.lit("too small")), (F.octet_length("pcm") % 2 == 0, F.lit("half a sample"))])
    return ok.select("session_id", "seq", F.lit("").alias("problem")).unionByName(bad.select("session_id", "seq", "problem"))


QUERIES = {
    "refuse_reason": refuse_reason, "norm_forms": norm_forms, "assemble": assembled, "transcript_stats": transcript_stats, "kept_despite_silence": kept_despite_silence,
    "refusal_report": refusal_report, "vocabulary_prompt": vocabulary_prompt, "compression_ratio": compression, "wordlist": wordlist,
    "judge_answer": judge_answer, "translation_stats": translation_stats, "expansion_stats": expansion_stats, "turn_history": history, "build_prompts": prompts,
    "infer": inferred, "retry_echoes": retried, "drop_stale": stale, "bounded_backlog": backlog, "answer_leftovers": leftovers, "answer_status": answer_status,
    "fold_messages": fold_messages, "keep_latest": newest_rows, "current_partial": running_text, "transcript_counts": transcript_counts, "speakers_in_order": speakers_in_order,
    "minutes": minutes, "event_log": event_log, "meeting_names": meeting_names, "parse_messages": parsed, "typed_messages": typed_partials, "parse_hello": hellos,
    "to_messages": serialised, "messages_round_trip": round_trip, "message_kinds": message_kinds, "protocol_violations": violations, "split_valid": checked_chunks,
}

SQL = {
    "refuse_reason": f"WITH {JUDGED} SELECT session_id, piece_idx, invented, reason FROM judged",
    "norm_forms": f"WITH {PIECES} SELECT piece_idx, md5({_EX.format('text')}) AS exact_md5, md5({_SP.format('text')}) AS spaced_md5 FROM pieces",
    "assemble": f"""WITH {JUDGED} SELECT session_id, utt_id, md5(coalesce(string_agg(trim(text, ' '), ' ' ORDER BY piece_idx) FILTER (reason = ''), '')) AS transcript_md5, count(*) FILTER (reason = '') AS kept,
count(*) FILTER (reason <> '') AS dropped, coalesce(string_agg(reason, '; ' ORDER BY piece_idx) FILTER (reason <> ''), '') AS dropped_reasons,
coalesce(arg_min(detected, piece_idx) FILTER (detected <> ''), '') AS lang_code FROM judged GROUP BY 1, 2""",
    "transcript_stats": f"""WITH {JUDGED} SELECT session_id, count(*) AS pieces, count(*) FILTER (reason = '') AS kept, count(*) FILTER (reason = 'empty') AS empty, count(*) FILTER (reason = 'no speech') AS no_speech_n,
count(*) FILTER (reason = 'low confidence') AS low_confidence, count(*) FILTER (reason = 'repetition') AS repetition, count(*) FILTER (reason = 'known hallucination') AS hallucination,
sum(decode_ms) / 1000 AS decode_s, sum(duration_ms) / 1000 AS audio_s, CASE WHEN sum(duration_ms) > 0 THEN (sum(decode_ms) / 1000) / (sum(duration_ms) / 1000) ELSE 0 END AS realtime_factor FROM judged GROUP BY 1""",
    "kept_despite_silence": f"WITH {JUDGED} SELECT session_id, piece_idx, no_speech_prob FROM judged WHERE reason = '' AND no_speech_prob > 0.6",
    "refusal_report": f"""WITH {JUDGED}, r AS (SELECT session_id, count(*) AS judged, count(*) FILTER (reason <> '') AS refused FROM judged WHERE duration_ms <= 1900 GROUP BY 1) SELECT *, refused / judged AS share, refused / judged <= 0.35 AS within FROM r""",
    "vocabulary_prompt": "WITH w AS (SELECT p_partkey, p_name, sum(length(p_name) + 2) OVER (ORDER BY p_partkey) - 2 AS e FROM part WHERE length(p_name) > 0) SELECT string_agg(p_name, ', ' ORDER BY p_partkey) AS prompt FROM w WHERE e <= 400",
    "wordlist": "WITH l AS (SELECT regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM documents) SELECT line, count(*) AS n FROM l WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY 1 HAVING count(*) > 1",
    "judge_answer": f"WITH {ASKED} SELECT session_id, sentence_id, target, reason, md5(CASE WHEN reason = '' THEN t ELSE '' END) AS translation_md5 FROM ans",
    "translation_stats": f"""WITH {ASKED} SELECT session_id, count(*) AS seen, count(*) FILTER (reason = '') AS translated, count(*) FILTER (reason <> '') AS refused, count(*) FILTER (reason = 'the answer repeats the source') AS echoes,
count(*) FILTER (reason = 'the answer is too long') AS too_long, count(*) FILTER (starts_with(reason, 'the answer is not')) AS wrong_script FROM ans GROUP BY 1""",
    "expansion_stats": f"WITH {ASKED}, x AS (SELECT target, length(t) / length(transcript) AS x FROM ans WHERE reason = '' AND length(transcript) > 0) SELECT target, count(*) AS n, min(x) AS least, quantile_cont(x, 0.5) AS median, max(x) AS most FROM x GROUP BY 1",
    "turn_history": f"""WITH {ASKED}, a AS (SELECT *, transcript || ' => ' || CASE WHEN reason = '' THEN t ELSE '' END AS pair FROM ans),
h AS (SELECT session_id, sentence_id, list(pair) OVER w AS p, list(speaker_id || ': ' || pair) OVER w AS l, list(transcript) OVER w AS s FROM a WINDOW w AS (PARTITION BY session_id ORDER BY sentence_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT session_id, sentence_id, md5(coalesce(array_to_string(p, chr(10)), '')) AS plain_md5, md5(coalesce(array_to_string(l, chr(10)), '')) AS labelled_md5, md5(coalesce(array_to_string(s, chr(10)), '')) AS sources_md5, CAST(coalesce(len(s), 0) AS INTEGER) AS n FROM h""",
    "build_prompts": f"""WITH {ASKED}, h AS (SELECT *, coalesce(array_to_string(list(transcript) OVER (PARTITION BY session_id ORDER BY sentence_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), chr(10)), '') AS h FROM tg)
SELECT session_id, sentence_id, CASE WHEN target = '' OR trim(transcript) = '' THEN '' ELSE 'Translate ' || CASE lang_code WHEN 'ja' THEN 'Japanese into Vietnamese' ELSE 'Vietnamese into Japanese' END || '. Answer with the translation only.' || CASE WHEN length(trim(transcript)) < 12 THEN ' The line is short; translate it as it stands.' ELSE '' END END AS system_prompt,
md5(CASE WHEN target = '' OR trim(transcript) = '' THEN '' ELSE CASE WHEN h <> '' THEN 'Earlier lines:' || chr(10) || h || chr(10) || chr(10) ELSE '' END || 'Line:' || chr(10) || trim(transcript) END) AS user_md5 FROM h""",
    "drop_stale": f"""WITH {FRAMES}, j AS (SELECT session_id, frame_idx, ts, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS taken FROM frames),
a AS (SELECT session_id, frame_idx, (epoch_us(taken) - epoch_us(ts)) / 1000000.0::DOUBLE AS age_s FROM j WHERE taken IS NOT NULL) SELECT *, age_s > 43200 AS stale, CASE WHEN age_s > 43200 THEN format('too late ({{:d}} s)', CAST(floor(age_s) AS BIGINT)) ELSE '' END AS reason FROM a""",
    "bounded_backlog": f"""WITH {FRAMES}, j AS (SELECT session_id, frame_idx AS sentence_id, frame_idx % 3 <> 0 AS waiting FROM frames), n AS (SELECT *, row_number() OVER (PARTITION BY session_id, waiting ORDER BY sentence_id DESC) AS n FROM j)
SELECT session_id, sentence_id, waiting, CASE WHEN waiting AND n > 16 THEN 'evicted: too many waiting' ELSE '' END AS reason FROM n""",
    "answer_leftovers": f"WITH {TURNS} SELECT session_id, sentence_id, 'the session ended first' AS reason FROM turns a WHERE speaker_id = 'user' AND NOT EXISTS (SELECT 1 FROM turns b WHERE b.session_id = a.session_id AND b.sentence_id = a.sentence_id + 1 AND b.speaker_id = 'assistant')",
    "answer_status": f"WITH {ASKED} SELECT session_id, sentence_id, CASE WHEN sentence_id % 3 = 1 THEN 'never answered' WHEN reason = '' THEN 'translated' ELSE 'refused' END AS status, CASE WHEN sentence_id % 3 <> 1 THEN 3.0::DOUBLE END AS lag_s FROM ans",
    "fold_messages": f"WITH {FOLDED} SELECT session_id, sentence_id, speaker_id, relabelled, answered, reason, md5(translation) AS translation_md5 FROM fl",
    "keep_latest": f"WITH {TURNS} SELECT session_id, sentence_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sentence_id DESC) AS n FROM turns) WHERE n <= 3",
    "current_partial": f"""WITH {TURNS}, m AS (SELECT session_id, sentence_id * 10 AS seq, 'final' AS kind, transcript FROM turns WHERE NOT (session_id % 2 = 0 AND sentence_id > 2) UNION ALL SELECT session_id, sentence_id * 10 - 3, 'partial', transcript FROM turns)
SELECT session_id, CASE WHEN arg_max(kind, seq) = 'partial' THEN arg_max(transcript, seq) ELSE '' END AS running FROM m GROUP BY 1""",
    "transcript_counts": f"""WITH {FOLDED} SELECT session_id, count(*) AS sentences, count(*) FILTER (translation <> '') AS translated, count(*) FILTER (NOT answered) AS waiting, count(*) FILTER (answered AND translation = '') AS refused, count(*) FILTER (answered AND translation = '' AND starts_with(reason, 'too late')) AS dropped, count(transcript) AS partials, count(*) FILTER (relabelled) AS relabelled_n FROM fl GROUP BY 1""",
    "speakers_in_order": f"WITH {FOLDED}, s AS (SELECT session_id, speaker_id, min(seq) AS q FROM fl GROUP BY 1, 2) SELECT session_id, string_agg(speaker_id, ',' ORDER BY q) AS speakers FROM s GROUP BY 1",
    "minutes": f"""WITH {FOLDED} SELECT session_id, md5(string_agg(speaker_id || ': ' || transcript || chr(10) || '    ' || CASE WHEN NOT answered THEN '(still waiting)' WHEN translation = '' THEN '(not translated: ' || reason || ')' ELSE translation END, chr(10) || chr(10) ORDER BY sentence_id)) AS minutes_md5 FROM fl GROUP BY 1""",
    "event_log": f"WITH {FRAMES} SELECT session_id, frame_idx AS seq, strftime(ts, '%H:%M:%S') || ' +' || CAST((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY session_id)) // 1000000 AS VARCHAR) || ' ' || rpad(label, 12, ' ') || 'event ' || event_id AS line FROM frames",
    "meeting_names": f"WITH {FRAMES} SELECT session_id, strftime(min(ts), '%Y-%m-%d_%H%M%S') AS folder FROM frames GROUP BY 1",
    "parse_messages": "SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_id % 11 > 3 THEN 'partial' END AS kind, CASE event_id % 11 WHEN 0 THEN 'not valid JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'unknown type' WHEN 3 THEN 'unknown type' ELSE '' END AS problem FROM events",
    "typed_messages": "SELECT event_type AS transcript, count(*) AS n FROM events WHERE event_id % 11 > 3 GROUP BY 1",
    "parse_hello": """SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 8000 ELSE 16000 END AS sample_rate, 1 AS channels, '' AS client, CASE WHEN event_id % 5 < 2 THEN 'session_id must be a text that is not empty' ELSE '' END AS problem,
CASE WHEN event_id % 2 = 0 THEN 'sample_rate: 8000, expected 16000' ELSE '' END AS mismatch FROM events""",
    "to_messages": f"WITH {FRAMES} SELECT session_id, frame_idx, frame_idx * 32.0::DOUBLE + 0.5 AS at_ms, 'vad' AS type FROM frames",
    "message_kinds": f"""WITH {FRAMES}, k AS (SELECT unnest(['hello', 'ready', 'bye', 'error', 'speakers', 'utterance']) AS kind)
SELECT event_id AS seq, kind, CASE WHEN kind = 'ready' THEN 's' || session_id ELSE label END AS said, CASE WHEN kind = 'utterance' THEN round_even(power, 1) END AS number,
CASE kind WHEN 'hello' THEN 16000 WHEN 'ready' THEN 6400 WHEN 'error' THEN CAST(power > 60 AS BIGINT) WHEN 'utterance' THEN frame_idx END AS n FROM frames CROSS JOIN k""",
    "messages_round_trip": f"""WITH {ASKED} SELECT session_id, sentence_id * 10 AS seq, 'final' AS kind, sentence_id, md5(transcript) AS text_md5 FROM ans
UNION ALL SELECT session_id, sentence_id * 10 + 14, 'translation', sentence_id + CASE sentence_id WHEN 4 THEN 100 ELSE 0 END, md5(CASE WHEN reason = '' AND sentence_id % 7 <> 3 THEN t ELSE '' END) FROM ans WHERE sentence_id % 6 <> 5
UNION ALL SELECT session_id, sentence_id * 10 - 3, 'partial', NULL, md5(transcript) FROM ans""",
    "protocol_violations": f"""WITH {FRAMES}, k AS (SELECT session_id, frame_idx AS seq, CASE label WHEN 'click' THEN 'hello' WHEN 'purchase' THEN 'bye' WHEN 'view' THEN 'audio' ELSE 'final' END AS kind FROM frames),
b AS (SELECT *, coalesce(max(CASE WHEN kind = 'hello' THEN 1 ELSE 0 END) OVER w, 0) = 1 AS h, coalesce(max(CASE WHEN kind = 'bye' THEN 1 ELSE 0 END) OVER w, 0) = 1 AS c FROM k WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT session_id, seq, kind, CASE WHEN c THEN 'after close' WHEN kind = 'hello' AND h THEN 'second hello' WHEN kind = 'audio' AND NOT h THEN 'audio before hello' WHEN kind NOT IN ('audio', 'hello', 'bye') THEN 'not for a client to send' END AS violation FROM b) SELECT * FROM v WHERE violation IS NOT NULL""",
    "split_valid": "SELECT source AS session_id, doc_id AS seq, CASE WHEN octet_length(encode(text)) < 1000 THEN 'too small' WHEN octet_length(encode(text)) % 2 = 1 THEN 'half a sample' ELSE '' END AS problem FROM documents",
}
