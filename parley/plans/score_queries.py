"""Queries of levels, labels, languages and voices."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import labels as lb
from parley.operators import language as lg
from parley.operators import levels as lv
from parley.operators import voices as vc
from parley.plans.bind import FRAMES, frames, table


def samples(spark, d):
    """Event values as samples in [-1, 1]."""
    return frames(spark, d).select("session_id", F.col("frame_idx").alias("pos"), (F.least(F.col("power"), F.lit(500.0)) / 500 * F.when(F.col("frame_idx") % 2 == 0, 1).otherwise(-1)).alias("value"))


SAMPLES = f"{FRAMES}, samples AS (SELECT session_id, frame_idx AS pos, least(power, 500.0) / 500 * CASE WHEN frame_idx % 2 = 0 THEN 1 ELSE -1 END AS value FROM frames)"


def envelope(spark, d):
    return lv.envelope(samples(spark, d), 8, ["session_id"])


def peak_envelope(spark, d):
    return lv.envelope(samples(spark, d), 8, ["session_id"], how="peak")


def speaking_level(spark, d):
    return lv.speaking_level(envelope(spark, d), ["session_id"])


def session_levels(spark, d):
    s = samples(spark, d).groupBy("session_id").agg(F.collect_list("value").alias("v"))
    return s.select("session_id", F.round(lv.rms_dbfs(F.col("v")), 9).alias("level_db"), lv.peak_dbfs(F.col("v")).alias("peak_db"))


def level_policy(spark, d):
    s = samples(spark, d).groupBy("session_id", F.floor(F.col("pos") / 4).alias("utt")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("r"), F.max(F.abs("value")).alias("p"), F.count("*").alias("n"))
    return lv.level_policy(s.select("session_id", "utt", F.when(F.col("n") == 4, lv.dbfs(F.col("r")) - 25).alias("level_db"), lv.dbfs(F.col("p")).alias("peak_db")))


def level_stats(spark, d):
    return lv.level_stats(level_policy(spark, d), ["session_id"])


def signal_health(spark, d):
    return lv.signal_health(samples(spark, d), ["session_id"], 8)


def level_gain(spark, d):
    """Levels of four samples each, before and after the gate of the policy."""
    own = samples(spark, d).withColumn("utt", F.floor(F.col("pos") / 4))
    gated = lv.gated_levels(own, level_policy(spark, d), ["session_id", "utt"])
    out = lv.level_stats(gated, ["session_id"], after_db="after_db")
    return out.select("session_id", "shaped_n", *(F.round(c, 6).alias(c) for c in ("mean_gain_db", "least_gain_db", "most_gain_db")))


def compare_levels(spark, d):
    """The second half of each session's samples as another treatment of the first."""
    own = samples(spark, d).withColumn("half", F.col("pos") * 2 >= F.count("*").over(W.partitionBy("session_id")))
    s = own.groupBy("session_id", "half").agg(lv.dbfs(F.max(F.abs("value"))).alias("dominant_db"), lv.dbfs(F.avg(F.abs("value"))).alias("bleed_db"))
    out = lv.compare_levels(s.where(~F.col("half")).drop("half"), s.where("half").drop("half"), ["session_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("kept_db", "removed_db")})


LABELS = ["click", "view", "purchase"]
QUIET = ["scroll", "login", "logout", "signup", "error"]


def scores(spark, d):
    return frames(spark, d).select("session_id", F.to_date("ts").alias("day"), "label", F.col("prob").alias("score"))


def best_label(spark, d):
    return lb.best_label(scores(spark, d), ["session_id", "day"], LABELS)


def top_labels(spark, d):
    return lb.top_labels(scores(spark, d), ["session_id"], 3)


def verdicts(spark, d):
    s = scores(spark, d)
    one = lb.best_label(s, ["session_id", "day"], LABELS[:1]).select("session_id", "day", F.col("score").alias("speech_score"))
    two = lb.best_label(s, ["session_id", "day"], LABELS[1:]).select("session_id", "day", F.col("score").alias("noise_score"), F.col("label").alias("noise_label"))
    return lb.keep_verdict(one.join(two, ["session_id", "day"]))


def verdict_stats(spark, d):
    return lb.verdict_stats(verdicts(spark, d))


def label_coverage(spark, d):
    return lb.label_coverage(scores(spark, d), LABELS, QUIET)


LANGS = ("en", "de", "fr", "es")
MARKS = {"en": "thw", "de": "uzä", "fr": "éqx", "es": "ñía"}


def lang_scores(spark, d):
    """Scores from the letters of a language's marks in a text."""
    t = F.lower("text")
    share = lambda chars: (F.length(t) - F.length(F.regexp_replace(t, f"[{chars}]", ""))) / F.greatest(F.length(t), F.lit(1)) * 20
    pairs = [x for k in LANGS for x in (F.lit(k), share(MARKS[k]))]
    docs = table(spark, d, "documents")
    return docs.select(F.col("source").alias("session_id"), F.col("doc_id").alias("seq"), F.col("lang").alias("truth"), (F.length("text") * 1.0).alias("duration_ms"), (F.col("doc_id") % 3 == 0).alias("is_final"), F.create_map(*pairs).alias("scores"))


_share = lambda k: f"(length(lower(text)) - length(regexp_replace(lower(text), '[{MARKS[k]}]', '', 'g'))) / greatest(length(lower(text)), 1) * 20"
LANG_SCORES = f"""ls AS (SELECT source AS session_id, doc_id AS seq, lang AS truth, length(text) * 1.0::DOUBLE AS duration_ms, doc_id % 3 = 0 AS is_final,
  {", ".join(f"{_share(k)} AS {k}" for k in LANGS)} FROM documents),
ex AS (SELECT *, greatest({", ".join(LANGS)}) AS top FROM ls),
lp AS (SELECT *, {", ".join(f"exp({k} - top) / ({' + '.join(f'exp({j} - top)' for j in sorted(LANGS))}) AS p_{k}" for k in LANGS)} FROM ex),
rk AS (SELECT *, list_sort([{", ".join(f"{{'p': -p_{k}, 'k': '{k}'}}" for k in LANGS)}]) AS r FROM lp),
mg AS (SELECT *, -r[1].p AS conf, r[2].p - r[1].p AS mar, duration_ms < 600 AS short FROM rk),
decided AS (SELECT session_id, seq, truth, duration_ms, is_final, CASE WHEN NOT short AND mar >= 0.3 THEN r[1].k ELSE '' END AS lang_code,
  CASE WHEN short THEN 0 ELSE conf END AS confidence, CASE WHEN short THEN 0 ELSE mar END AS margin,
  CASE WHEN short THEN format('too short ({{:.0f}} ms)', duration_ms) WHEN mar < 0.3 THEN 'undecided' ELSE '' END AS reason FROM mg)"""


def decided(spark, d):
    return lg.decide_language(lang_scores(spark, d), LANGS)


def decide_language(spark, d):
    r = F.when(F.col("reason").startswith("undecided"), "undecided").otherwise(F.col("reason"))
    return decided(spark, d).select("session_id", "seq", "lang_code", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), r.alias("reason"))


def fill_language(spark, d):
    return lg.fill_language(decided(spark, d)).select("session_id", "seq", "lang_code", "filled")


def language_flips(spark, d):
    return lg.language_flips(decided(spark, d))


def language_stats(spark, d):
    return lg.language_stats(decided(spark, d)).select("session_id", "seen", "unknown", "decided", F.array_join(F.transform(F.map_entries("languages"), lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("languages"))


def evaluate_language(spark, d):
    return lg.evaluate_language(decided(spark, d), "truth")


def language_codes(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.concat(F.lit(" "), F.upper("lang"), F.lit(" : "), F.col("source")).alias("label"))
    return c.select("doc_id", lg.language_code(F.col("label")).alias("code"))


def boundaries(spark, d):
    w = decided(spark, d).select("session_id", F.floor(F.col("seq") / 100).alias("utt"), F.col("seq").alias("window_idx"), F.col("lang_code").alias("lang"))
    return lg.language_boundary(w, ["session_id", "utt"])


def split_utterances(spark, d):
    b = boundaries(spark, d)
    u = b.select("session_id", "utt", (F.col("utt") * 10_000.0).alias("start_ms"), (F.col("utt") * 10_000.0 + 5_000).alias("end_ms"), F.lit(False).alias("continues_previous"))
    return lg.split_by_language(u, b, ["session_id", "utt"], 1000.0)


def split_stats(spark, d):
    return lg.split_stats(boundaries(spark, d))


def voices(spark, d):
    """Embeddings as voices: a session per label, the cluster label as the true voice."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").alias("session_id"), F.col("vec_id").alias("sentence_id"), (F.col("vec_id") % 40 * 50.0).alias("duration_ms"), "embedding", F.concat(F.lit("Speaker_"), F.lpad((F.col("vec_id") % 3 + 1).cast("string"), 2, "0")).alias("label"))


VOICES = "v AS (SELECT label AS session_id, vec_id AS sentence_id, vec_id % 40 * 50.0::DOUBLE AS duration_ms, embedding, 'Speaker_' || lpad(CAST(vec_id % 3 + 1 AS VARCHAR), 2, '0') AS label FROM embeddings)"
_COS = "coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0)"


def usable(spark, d):
    return vc.usable_voice(voices(spark, d)).select("session_id", "sentence_id", "usable", "reason")


def pairs(spark, d):
    """The newest 300 usable voices of each session."""
    return vc.pairwise(vc.newest_voices(vc.usable_voice(voices(spark, d)).where("usable")))


def pairwise(spark, d):
    return pairs(spark, d).select("session_id", "a", "b", F.round("similarity", 6).alias("similarity"))


_LONG = "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sentence_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY sentence_id DESC) AS m FROM v WHERE duration_ms >= 600"
PAIRS = f"{VOICES}, kept AS ({_LONG} QUALIFY m <= 300), pairs AS (SELECT a.session_id, a.sentence_id AS a, b.sentence_id AS b, {_COS} AS similarity FROM kept a JOIN kept b ON a.session_id = b.session_id AND a.sentence_id < b.sentence_id)"


def assigned(spark, d):
    return vc.assign_voices(vc.usable_voice(voices(spark, d)).where("usable"))


def assign_voices(spark, d):
    return assigned(spark, d).withColumn("similarity", F.round("similarity", 6))


def voice_stats(spark, d):
    s = vc.voice_stats(assigned(spark, d))
    return s.withColumn("speakers", F.array_join(F.transform(F.map_entries("speakers"), lambda e: F.concat(e.key, F.lit("="), e.value)), ","))


def clustered(spark, d):
    return vc.cluster_voices(voices(spark, d))


def corrections(spark, d):
    return vc.label_corrections(voices(spark, d), clustered(spark, d), ["session_id", "sentence_id"])


def plain_corrections(spark, d):
    v = voices(spark, d)
    after = v.withColumn("label", F.when(F.col("sentence_id") % 7 == 0, "Speaker_01").otherwise(F.col("label")))
    return vc.label_corrections(v, after, ["session_id", "sentence_id"])


def voice_window(spark, d):
    return vc.voice_window(voices(spark, d), every=5, keep=12)


def voice_changes(spark, d):
    return vc.voice_changes(voices(spark, d), ["session_id"], "sentence_id").withColumn("similarity", F.round("similarity", 6))


def recluster_runs(spark, d):
    return vc.recluster_runs(voices(spark, d))


def deciles(spark, d):
    return vc.deciles(frames(spark, d), "prob", ["session_id"])


def separation(spark, d):
    own = vc.newest_voices(vc.usable_voice(voices(spark, d)).where("usable"))
    out = vc.voice_separation(own)
    return out.select("session_id", *(F.round(c, 6).alias(c) for c in out.columns if c != "session_id"))


def label_purity(spark, d):
    v = voices(spark, d)
    return vc.label_purity(v, "session_id")


def label_count(spark, d):
    return vc.label_count(voices(spark, d), "session_id")


def half_similarity(spark, d):
    """Neighbouring embeddings as the halves of a sentence."""
    h = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("sentence_id"), (F.col("vec_id") % 2).alias("half"), "embedding")
    return vc.half_similarity(h, ["sentence_id"]).withColumn("similarity", F.round("similarity", 6))


QUERIES = {
    "label_count": label_count, "half_similarity": half_similarity, "level_gain": level_gain,
    "envelope": envelope, "peak_envelope": peak_envelope, "speaking_level": speaking_level, "session_levels": session_levels,
    "level_policy": level_policy, "level_stats": level_stats, "signal_health": signal_health, "compare_levels": compare_levels,
    "best_label": best_label, "top_labels": top_labels, "keep_verdict": verdicts, "verdict_stats": verdict_stats, "label_coverage": label_coverage,
    "language_codes": language_codes, "decide_language": decide_language, "fill_language": fill_language, "language_flips": language_flips,
    "language_stats": language_stats, "evaluate_language": evaluate_language, "language_boundary": boundaries,
    "split_by_language": split_utterances, "split_stats": split_stats,
    "usable_voice": usable, "pairwise": pairwise, "assign_voices": assign_voices, "voice_stats": voice_stats, "cluster_voices": clustered,
    "voice_corrections": corrections, "label_corrections": plain_corrections, "voice_window": voice_window, "voice_changes": voice_changes, "recluster_runs": recluster_runs,
    "deciles": deciles, "separation": separation, "label_purity": label_purity,
}

_ENV = f"{SAMPLES}, e AS (SELECT session_id, pos // 8 AS window_idx, count(*) AS n, sqrt(avg(value * value)) AS level, max(abs(value)) AS peak FROM samples GROUP BY 1, 2), env AS (SELECT * FROM e WHERE n = 8 OR window_idx = 0)"
_DB = "CASE WHEN {0} > 0 THEN greatest(-120.0, 20 * log10({0})) ELSE -120.0 END"
_POL = f"""{SAMPLES}, u AS (SELECT session_id, pos // 4 AS utt, sqrt(avg(value * value)) AS r, max(abs(value)) AS p, count(*) AS n FROM samples GROUP BY 1, 2),
l AS (SELECT session_id, utt, CASE WHEN n = 4 THEN {_DB.format('r')} - 25 END AS level_db, {_DB.format('p')} AS peak_db FROM u),
pol AS (SELECT *, coalesce(level_db > -55, false) AS shaped, CASE WHEN level_db IS NULL THEN 'empty audio' WHEN level_db <= -55 THEN format('too quiet ({{:.1f}} dBFS)', level_db) ELSE '' END AS reason,
CASE WHEN level_db > -55 THEN peak_db - 12 END AS gate_db, CASE WHEN level_db > -55 THEN peak_db + 3 END AS compressor_db FROM l)"""
_SC = f"{FRAMES}, sc AS (SELECT session_id, CAST(ts AS DATE) AS day, label, prob AS score FROM frames)"
_IN = lambda ls: ", ".join(f"'{x}'" for x in ls)
_RANK = lambda ls: f"list_position([{_IN(ls)}], label)"
_BEST = lambda ls: f"SELECT session_id, day, coalesce(max(score) FILTER (label IN ({_IN(ls)})), 0) AS score, coalesce(arg_max(label, (score, -{_RANK(ls)})) FILTER (label IN ({_IN(ls)}) AND score > 0), '') AS label FROM sc GROUP BY 1, 2"
_VER = f"""{_SC}, one AS ({_BEST(LABELS[:1])}), two AS ({_BEST(LABELS[1:])}),
ver AS (SELECT session_id, day, one.score AS speech_score, two.score AS noise_score, two.label AS noise_label, one.score >= 0.2 OR two.score < 0.3 AS keep,
CASE WHEN one.score >= 0.2 THEN 'speech' WHEN two.score < 0.3 THEN 'nothing conclusive' ELSE format('noise: {{}} ({{:.2f}})', two.label, floor(two.score * 100) / 100) END AS reason FROM one JOIN two USING (session_id, day))"""

#: Voices in order: the centroids of a session so far, as a list.
_RUN = f"""WITH RECURSIVE {VOICES}, u AS (SELECT session_id, sentence_id, CAST(embedding AS DOUBLE[]) AS e, n FROM ({_LONG})),
run AS (
  SELECT session_id, n, sentence_id, [e] AS known, 1::BIGINT AS who, 0.0::DOUBLE AS similarity, true AS is_new FROM u WHERE n = 1
  UNION ALL
  SELECT session_id, n, sentence_id,
    CASE WHEN fresh THEN list_append(known, e) ELSE [CASE WHEN i = best THEN [0.7::DOUBLE * known[i][j] + 0.3::DOUBLE * e[j] FOR j IN range(1, len(e) + 1)] ELSE known[i] END FOR i IN range(1, len(known) + 1)] END,
    CASE WHEN fresh THEN len(known) + 1 ELSE best END, near, fresh
  FROM (SELECT *, list_position(sims, list_max(sims)) AS best, list_max(sims) AS near, list_max(sims) < 0.3 AND len(known) < 12 AS fresh
    FROM (SELECT u.*, known, [coalesce(list_cosine_similarity(c, u.e), 0) FOR c IN known] AS sims FROM run JOIN u ON u.session_id = run.session_id AND u.n = run.n + 1))),
told AS (SELECT session_id, sentence_id, 'Speaker_' || lpad(CAST(who AS VARCHAR), 2, '0') AS label, similarity, is_new FROM run)"""

_ASSIGNED = f"""{_RUN} SELECT session_id, sentence_id, label, round(similarity, 6) AS similarity, is_new,
CASE WHEN is_new THEN 'no voice is near' WHEN similarity >= 0.3 THEN 'near a known voice' ELSE 'no room for another voice' END AS reason FROM told"""
#: Of all voices, also short ones.
ASSIGNED_ALL = _ASSIGNED.replace(" WHERE duration_ms >= 600", "").replace("SELECT session_id, sentence_id, label, round", "SELECT CAST(session_id AS BIGINT) AS session_id, sentence_id, label, round")

SQL = {
    "assign_voices": _ASSIGNED,
    "voice_stats": f"""{_RUN}, each AS (SELECT session_id, label, count(*) AS n, count(*) FILTER (is_new) AS w FROM told GROUP BY 1, 2)
SELECT session_id, CAST(sum(n) AS BIGINT) AS seen, CAST(sum(n) AS BIGINT) AS identified, 0::BIGINT AS unknown, CAST(sum(w) AS BIGINT) AS new, string_agg(label || '=' || n, ',' ORDER BY label) AS speakers FROM each GROUP BY 1""",
    "voice_changes": f"""WITH RECURSIVE {VOICES}, w AS (SELECT session_id, sentence_id, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY session_id ORDER BY sentence_id) AS n FROM v),
nxt AS (SELECT a.session_id, a.n, min(b.n) AS m FROM w a JOIN w b ON a.session_id = b.session_id AND b.n > a.n WHERE list_cosine_similarity(a.e, b.e) < 0.25 GROUP BY 1, 2),
hop AS (SELECT session_id, n, m FROM nxt WHERE n = 1 UNION ALL SELECT h.session_id, x.n, x.m FROM hop h JOIN nxt x ON x.session_id = h.session_id AND x.n = h.m)
SELECT h.session_id, b.sentence_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM hop h JOIN w a ON a.session_id = h.session_id AND a.n = h.n JOIN w b ON b.session_id = h.session_id AND b.n = h.m""",
    "envelope": f"WITH {_ENV} SELECT session_id, window_idx, level FROM env",
    "peak_envelope": f"WITH {_ENV} SELECT session_id, window_idx, peak AS level FROM env",
    "speaking_level": f"WITH {_ENV} SELECT session_id, quantile_cont(level, 0.9) AS speaking_level FROM env GROUP BY 1",
    "session_levels": f"WITH {SAMPLES}, s AS (SELECT session_id, sqrt(avg(value * value)) AS r, max(abs(value)) AS p FROM samples GROUP BY 1) SELECT session_id, round({_DB.format('r')}, 9) AS level_db, {_DB.format('p')} AS peak_db FROM s",
    "level_policy": f"WITH {_POL} SELECT * FROM pol",
    "level_stats": f"WITH {_POL} SELECT session_id, count(*) AS seen, count(*) FILTER (shaped) AS shaped_n, count(*) FILTER (starts_with(reason, 'too quiet')) AS too_quiet, count(*) FILTER (level_db IS NULL) AS empty FROM pol GROUP BY 1",
    "signal_health": f"""WITH {SAMPLES}, w AS (SELECT session_id, pos // 8 AS k, count(*) AS n, count(*) FILTER (abs(value) >= 0.999) AS c, max(abs(value)) AS p, sum(value * value) AS q FROM samples GROUP BY 1, 2)
SELECT session_id, CAST(sum(n) AS BIGINT) AS samples, CAST(sum(c) AS BIGINT) AS clipped, avg(CASE WHEN p < 1e-4 THEN 1 ELSE 0 END) AS silent_share, max(p) AS peak, sqrt(sum(q) / sum(n)) AS level FROM w GROUP BY 1""",
    "compare_levels": f"""WITH {SAMPLES}, h AS (SELECT session_id, pos * 2 >= count(*) OVER (PARTITION BY session_id) AS half, value FROM samples),
s AS (SELECT session_id, half, {_DB.format('max(abs(value))')} AS d, {_DB.format('avg(abs(value))')} AS b FROM h GROUP BY 1, 2)
SELECT x.session_id, round(y.d - x.d, 6) AS kept_db, round(x.b - y.b, 6) AS removed_db, abs(y.d - x.d) <= 3 AND x.b - y.b >= 6 AS separates FROM s x JOIN s y ON x.session_id = y.session_id AND NOT x.half AND y.half""",
    "level_gain": f"""WITH {_POL}, g AS (SELECT session_id, pos // 4 AS utt, value FROM samples), a AS (SELECT pol.session_id, pol.utt, shaped, level_db, sqrt(avg(value * value) FILTER ({_DB.format('abs(value)')} >= gate_db)) AS r FROM pol JOIN g ON g.session_id = pol.session_id AND g.utt = pol.utt GROUP BY 1, 2, 3, 4),
n AS (SELECT session_id, shaped, CASE WHEN shaped THEN {_DB.format('coalesce(r, 0)')} - level_db END AS gain FROM a)
SELECT session_id, count(*) FILTER (shaped) AS shaped_n, round(coalesce(avg(gain), 0), 6) AS mean_gain_db, round(min(gain), 6) AS least_gain_db, round(max(gain), 6) AS most_gain_db FROM n GROUP BY 1""",
    "label_count": f"WITH {VOICES} SELECT count(DISTINCT session_id) AS voices, count(DISTINCT label) AS labels, count(DISTINCT session_id) = count(DISTINCT label) AS as_many FROM v",
    "half_similarity": f"SELECT a.vec_id // 2 AS sentence_id, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0",
    "best_label": f"WITH {_SC} {_BEST(LABELS)}",
    "top_labels": f"""WITH {_SC}, p AS (SELECT session_id, label, max(score) AS score FROM sc GROUP BY 1, 2)
SELECT session_id, label, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, label) AS r FROM p) WHERE r <= 3""",
    "keep_verdict": f"WITH {_VER} SELECT * FROM ver",
    "verdict_stats": f"WITH {_VER} SELECT noise_label AS label, count(*) FILTER (NOT keep) AS dropped, count(*) FILTER (keep) AS kept FROM ver GROUP BY 1",
    "label_coverage": f"""WITH {_SC}, k AS (SELECT DISTINCT label FROM sc), a AS (SELECT 's' AS kind, unnest([{_IN(LABELS)}]) AS x, generate_subscripts([{_IN(LABELS)}], 1) AS i UNION ALL SELECT 'n', unnest([{_IN(QUIET)}]), generate_subscripts([{_IN(QUIET)}], 1)),
m AS (SELECT a.*, k.label IS NOT NULL AS known FROM a LEFT JOIN k ON k.label = a.x), c AS (SELECT count(*) FILTER (kind = 's' AND known) AS s, count(*) FILTER (kind = 'n' AND known) AS n,
coalesce(string_agg(x, ',' ORDER BY i) FILTER (kind = 's' AND NOT known), '') AS sm, coalesce(string_agg(x, ',' ORDER BY i) FILTER (kind = 'n' AND NOT known), '') AS nm FROM m)
SELECT s AS speech_known, n AS noise_known, sm AS speech_missing, nm AS noise_missing, s > 0 AND n > 0 AS ok FROM c""",
    "language_codes": "SELECT doc_id, lower(lang) AS code FROM documents",
    "decide_language": f"WITH {LANG_SCORES} SELECT session_id, seq, lang_code, round(confidence, 6) AS confidence, round(margin, 6) AS margin, reason FROM decided",
    "fill_language": f"""WITH {LANG_SCORES} SELECT session_id, seq, lang_code, CASE WHEN lang_code <> '' THEN lang_code ELSE
coalesce(last_value(CASE WHEN is_final AND lang_code <> '' THEN lang_code END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '') END AS filled FROM decided""",
    "language_flips": f"""WITH {LANG_SCORES}, g AS (SELECT *, coalesce(sum(CAST(is_final AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM decided),
p AS (SELECT *, last_value(CASE WHEN NOT is_final THEN lang_code END IGNORE NULLS) OVER (PARTITION BY session_id, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS predicted FROM g)
SELECT session_id, seq, predicted, lang_code FROM p WHERE is_final AND lang_code <> '' AND predicted <> '' AND predicted <> lang_code""",
    "language_stats": f"""WITH {LANG_SCORES}, e AS (SELECT session_id, lang_code, count(*) AS n FROM decided GROUP BY 1, 2)
SELECT session_id, CAST(sum(n) AS BIGINT) AS seen, CAST(coalesce(sum(n) FILTER (lang_code = ''), 0) AS BIGINT) AS unknown, CAST(coalesce(sum(n) FILTER (lang_code <> ''), 0) AS BIGINT) AS decided,
coalesce(string_agg(lang_code || '=' || n, ',' ORDER BY lang_code) FILTER (lang_code <> ''), '') AS languages FROM e GROUP BY 1""",
    "evaluate_language": f"""WITH {LANG_SCORES} SELECT truth, count(*) FILTER (lang_code = truth) AS right_n, count(*) FILTER (lang_code <> truth AND lang_code <> '') AS wrong_n, count(*) FILTER (lang_code = '') AS unknown_n,
min(margin) FILTER (lang_code = truth) AS least_right, max(margin) FILTER (lang_code <> truth AND lang_code <> '') AS most_wrong, quantile_cont(margin, 0.5) AS median_margin FROM decided GROUP BY 1""",
    "usable_voice": f"WITH {VOICES} SELECT session_id, sentence_id, duration_ms >= 600 AS usable, CASE WHEN duration_ms < 600 THEN format('too short ({{:.0f}} ms)', duration_ms) ELSE '' END AS reason FROM v",
    "pairwise": f"WITH {PAIRS} SELECT session_id, a, b, round(similarity, 6) AS similarity FROM pairs",
    "label_corrections": f"WITH {VOICES} SELECT session_id, sentence_id, label AS old, 'Speaker_01' AS new FROM v WHERE sentence_id % 7 = 0 AND label <> 'Speaker_01'",
    "voice_window": f"""WITH {VOICES}, n AS (SELECT session_id, sentence_id, row_number() OVER (PARTITION BY session_id ORDER BY sentence_id) AS n, count(*) OVER (PARTITION BY session_id) AS total FROM v)
SELECT session_id, sentence_id, run FROM (SELECT *, unnest(range(1, total // 5 + 1)) AS run FROM n) WHERE n <= run * 5 AND n > run * 5 - 12""",
    "deciles": f"""WITH {FRAMES}, r AS (SELECT session_id, prob, row_number() OVER (PARTITION BY session_id ORDER BY prob) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM frames)
SELECT session_id, CAST(i AS INTEGER) AS decile, prob AS value FROM r, range(0, 11) t(i) WHERE r = least(n - 1, n * i // 10)""",
    "separation": f"""WITH {PAIRS}, s AS (SELECT session_id, quantile_cont(similarity, 0.5) FILTER (a % 3 = b % 3) AS same_median, quantile_cont(similarity, 0.5) FILTER (a % 3 <> b % 3) AS other_median,
min(similarity) FILTER (a % 3 = b % 3) AS same_min, max(similarity) FILTER (a % 3 <> b % 3) AS other_max FROM pairs GROUP BY 1)
SELECT session_id, round(same_median, 6) AS same_median, round(other_median, 6) AS other_median, round(same_min, 6) AS same_min, round(other_max, 6) AS other_max, round(same_min - other_max, 6) AS gap, round((same_min + other_max) / 2, 6) AS threshold FROM s""",
    "label_purity": f"""WITH {VOICES}, p AS (SELECT DISTINCT session_id AS truth, label FROM v), n AS (SELECT label, count(*) AS n FROM p GROUP BY 1)
SELECT truth, count(*) AS labels, count(*) FILTER (n > 1) AS shared FROM p JOIN n USING (label) GROUP BY 1""",
}


def _search_step(before: str, after: str) -> str:
    """One step of the binary search over the languages of an utterance's windows."""
    open_, mid = "outcome = 'split' AND hi - lo > 1", "(lo + hi) // 2"
    return f"""{after} AS (SELECT * REPLACE (CASE WHEN {open_} AND l[{mid} + 1] = b THEN {mid} ELSE lo END AS lo, CASE WHEN {open_} AND l[{mid} + 1] <> b THEN {mid} ELSE hi END AS hi,
  CASE WHEN {open_} THEN probes + 1 ELSE probes END AS probes) FROM {before})"""


_BOUNDS = f"""WITH {LANG_SCORES}, g AS (SELECT session_id, seq // 100 AS utt, list(lang_code ORDER BY seq) AS l FROM decided GROUP BY 1, 2),
o AS (SELECT *, len(l) AS n, l[1] AS b, l[len(l)] AS a, CASE WHEN len(l) < 2 THEN 'too_short' WHEN l[1] = '' OR l[len(l)] = '' THEN 'undecided' WHEN l[1] = l[len(l)] THEN 'one_language' ELSE 'split' END AS outcome FROM g),
s0 AS (SELECT *, 1 AS lo, n - 1 AS hi, CASE WHEN outcome = 'too_short' THEN 0 ELSE 2 END AS probes FROM o), {_search_step("s0", "s1")}, {_search_step("s1", "s2")}, {_search_step("s2", "s3")},
bd AS (SELECT session_id, utt, CASE WHEN outcome = 'split' THEN hi END AS at_window, CASE WHEN outcome IN ('split', 'one_language') THEN b ELSE '' END AS before, CASE WHEN outcome IN ('split', 'one_language') THEN a ELSE '' END AS after, probes, outcome FROM s3)"""
SQL["language_boundary"] = f"{_BOUNDS} SELECT * FROM bd"
SQL["split_stats"] = f"""{_BOUNDS} SELECT session_id, count(*) AS checked, {", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in ("split", "one_language", "undecided", "too_short"))}, CAST(sum(probes) AS BIGINT) AS probes, arg_max(outcome, utt) AS last_reason FROM bd GROUP BY 1"""
SQL["split_by_language"] = f"""{_BOUNDS}, u AS (SELECT *, utt * 10000.0::DOUBLE AS st, utt * 10000.0::DOUBLE + 5000 AS en, coalesce(at_window * 1000 >= 600 AND 5000 - at_window * 1000 >= 600, false) AS ok FROM bd)
SELECT session_id, utt, 0 AS part, st AS start_ms, CASE WHEN ok THEN st + at_window * 1000 ELSE en END AS end_ms, before AS lang_code, false AS continues_previous FROM u
UNION ALL SELECT session_id, utt, 1, st + at_window * 1000, en, after, false FROM u WHERE ok"""
