"""Guards on transcripts: refusal reasons, word lists, prompts, assembly and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import DEFAULTS
from parley.functions.text import norm_exact, norm_spaced

#: Word lists are broadcast up to this many bytes of normal forms; beyond it the join is left to the optimizer.
LIST_BYTES = 16 << 20


def listed(df: DataFrame, exact: DataFrame, patterns: list[str], keep: DataFrame, text: str = "text") -> DataFrame:
    """Adds invented: the whole line is on the exact list or matches a pattern, and is not on the keep list.

    exact, keep: line. Lines are compared without punctuation and case; patterns match the whole spaced form. Both lists are one table of
    normal forms, joined by hash and form; lines without a letter have a hash of their own each, as they are on no list.
    """
    marked = lambda lines, mark: lines.select(norm_exact(F.col("line")).alias("_n"), F.lit(mark).alias("_m"))
    both = marked(exact, False).unionByName(marked(keep, True)).where("_n <> ''").groupBy(F.xxhash64("_n").alias("_h"), "_n").agg(F.bool_or(~F.col("_m")).alias("_x"), F.bool_or("_m").alias("_k"))
    size = both.agg(F.sum(F.octet_length("_n") + 16)).first()[0] or 0
    own = df.withColumn("_n", norm_exact(F.col(text)))
    own = own.withColumn("_h", F.when(F.col("_n") != "", F.xxhash64("_n")).otherwise(F.xxhash64(F.monotonically_increasing_id())))
    out = own.join(F.broadcast(both) if size <= LIST_BYTES else both, ["_h", "_n"], "left")
    hit = F.coalesce("_x", F.lit(False))
    if patterns:
        hit = hit | F.coalesce(norm_spaced(F.col(text)).rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\z"), F.lit(False))
    return out.withColumn("invented", hit & ~F.coalesce("_k", F.lit(False))).drop("_n", "_h", "_x", "_k")


def refuse_reason(text: Column, no_speech: Column, logprob: Column, ratio: Column, duration_ms: Column, invented: Column) -> Column:
    """'' to keep; else the first of: empty, no speech, low confidence, repetition, known hallucination."""
    quiet = (no_speech > DEFAULTS.no_speech) & ((duration_ms < DEFAULTS.short_ms) | (logprob <= DEFAULTS.min_logprob))
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(quiet, "no speech").when(logprob < DEFAULTS.min_logprob, "low confidence")
        .when(ratio > DEFAULTS.max_repetition, "repetition").when(invented, "known hallucination").otherwise("")
    )


def vocabulary_prompt(words: DataFrame, order: str = "pos", word: str = "word", limit: int = DEFAULTS.prompt_chars) -> DataFrame:
    """One row, prompt: the words joined by ', ' as far as limit characters reach, never past the first that does not fit.

    A vocabulary is a short list by nature; only its first limit words can matter, so only those are ordered.
    """
    first = words.where(F.length(word) > 0).orderBy(order).limit(limit)
    by = W.partitionBy(F.lit(1)).orderBy(order)
    run = F.sum(F.length(word) + 2).over(by.rowsBetween(W.unboundedPreceding, 0)) - 2
    own = first.withColumn("_e", run).where(F.col("_e") <= limit)
    return own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]), ", ").alias("prompt"))


def assemble(pieces: DataFrame, keys: list[str], order: str = "piece_idx", text: str = "text", reason: str = "reason", detected: str | None = None, forced: str = "") -> DataFrame:
    """(keys, transcript, kept, dropped, dropped_reasons, lang_code): the trimmed kept pieces by order, joined by a space.

    The language is the forced one, else what the column detected says of the first piece that names one, else ''.
    """
    told = F.when(F.length(detected) > 0, F.col(detected)) if detected else F.lit(None).cast("string")
    lang = F.lit(forced) if forced else F.coalesce(F.min_by(told, F.when(told.isNotNull(), F.col(order))), F.lit(""))
    kept = F.col(reason) == ""
    gather = lambda c, what: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(F.col(order).alias("o"), what.alias("x"))))), lambda x: x.x)
    return pieces.groupBy(*keys).agg(
        F.array_join(gather(kept, F.trim(text)), " ").alias("transcript"), F.count(F.when(kept, 1)).alias("kept"),
        F.count(F.when(~kept, 1)).alias("dropped"), F.array_join(gather(~kept, F.col(reason)), "; ").alias("dropped_reasons"), lang.alias("lang_code"),
    )


def transcript_stats(pieces: DataFrame, keys: list[str], reason: str = "reason", decode_ms: str = "decode_ms", audio_ms: str = "duration_ms") -> DataFrame:
    """(keys, pieces, kept, one count per reason, decode_s, audio_s, realtime_factor): how a session's pieces fared, and the
    seconds of decoding a second of audio took (0 without audio)."""
    count = lambda r: F.count(F.when(F.col(reason) == r, 1))
    names = [("kept", ""), ("empty", "empty"), ("no_speech_n", "no speech"), ("low_confidence", "low confidence"), ("repetition", "repetition"), ("hallucination", "known hallucination")]
    seconds = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / 1000
    out = pieces.groupBy(*keys).agg(F.count("*").alias("pieces"), *(count(r).alias(n) for n, r in names), seconds(decode_ms).alias("decode_s"), seconds(audio_ms).alias("audio_s"))
    return out.withColumn("realtime_factor", F.when(F.col("audio_s") > 0, F.col("decode_s") / F.col("audio_s")).otherwise(0.0))


def kept_despite_silence(pieces: DataFrame, no_speech: str = "no_speech_prob", reason: str = "reason") -> DataFrame:
    return pieces.where((F.col(reason) == "") & (F.col(no_speech) > DEFAULTS.no_speech))


def refusal_report(pieces: DataFrame, keys: list[str], truncated: Column, reason: str = "reason") -> DataFrame:
    """(keys, judged, refused, share, within): truncated rows are not judged; at most 35 % should be refused."""
    own = pieces.where(~truncated)
    refused = F.count(F.when(F.col(reason) != "", 1))
    return own.groupBy(*keys).agg(F.count("*").alias("judged"), refused.alias("refused")).withColumn("share", F.col("refused") / F.col("judged")).withColumn("within", F.col("share") <= 0.35)
