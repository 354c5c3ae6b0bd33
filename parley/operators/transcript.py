"""The keyed transcript that messages build up, late corrections included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import DEFAULTS


def fold_messages(messages: DataFrame, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """(session, sentence_id, speaker_id, lang_code, transcript, translation, reason, raw, relabelled) of a message log.

    messages: key, seq, kind, sentence_id, speaker_id, lang_code, transcript, translation, reason, raw, labels
    (map of sentence id as text to speaker). A final inserts (the last of one id wins), a translation fills, speakers relabel
    what is known by then; other kinds, unknown ids and labels of ids that are no numbers are ignored. One pass: the kinds are folded
    as aggregates of one grouping by sentence.
    """
    own = messages.where("kind in ('final', 'translation')").select(key, seq, "kind", "sentence_id", "speaker_id", "lang_code", "transcript", "translation", "reason", "raw")
    moved = messages.where("kind = 'speakers'").select(key, seq, F.explode("labels").alias("_s", "speaker_id"))
    moved = moved.select(key, seq, F.lit("speakers").alias("kind"), F.expr("try_cast(_s as long)").alias("sentence_id"), "speaker_id").where("sentence_id is not null")
    rows = own.unionByName(moved, allowMissingColumns=True)
    pick = lambda kind, cols: F.max(F.when(F.col("kind") == kind, F.struct(F.col(seq).alias("_q"), *cols)))
    folded = rows.groupBy(key, "sentence_id").agg(
        pick("final", ["speaker_id", "lang_code", "transcript"]).alias("f"), pick("translation", ["translation", "reason", "raw"]).alias("t"), pick("speakers", ["speaker_id"]).alias("s"),
        F.min(F.when(F.col("kind") == "final", F.col(seq))).alias("_first"),
    )
    known = folded.where("f is not null")
    late = lambda x: F.when(F.col(f"{x}._q") > F.col("_first"), F.col(x))
    t, s = late("t"), F.when(F.col("s._q") > F.col("f._q"), F.col("s"))
    return known.select(
        key, "sentence_id", F.col("f._q").alias(seq), F.coalesce(s["speaker_id"], F.col("f.speaker_id")).alias("speaker_id"), F.col("f.lang_code").alias("lang_code"), F.col("f.transcript").alias("transcript"),
        t["translation"].alias("translation"), t["reason"].alias("reason"), t["raw"].alias("raw"), t.isNotNull().alias("answered"),
        F.coalesce(s["speaker_id"] != F.col("f.speaker_id"), F.lit(False)).alias("relabelled"),
    )


def keep_latest(df: DataFrame, key: str = "session_id", order: str = "sentence_id", n: int = DEFAULTS.rows_kept) -> DataFrame:
    by = W.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def current_partial(messages: DataFrame, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """(session, running): the last partial, '' once a final has come after it."""
    own = messages.where("kind in ('partial', 'final')")
    last = own.groupBy(key).agg(F.max_by(F.struct("kind", "transcript"), seq).alias("m"))
    return last.select(key, F.when(F.col("m.kind") == "partial", F.coalesce("m.transcript", F.lit(""))).otherwise("").alias("running"))


def transcript_counts(rows: DataFrame, messages: DataFrame | None = None, key: str = "session_id") -> DataFrame:
    """(session, sentences, translated, waiting, refused, dropped, relabelled_n, partials): dropped ones are the refused ones that
    nobody judged (too late or evicted); partials, from messages, are 0 without them. Sessions without a sentence have no row."""
    text = F.coalesce(F.trim("translation"), F.lit("")) != ""
    n = lambda c: F.count(F.when(c, 1))
    late = F.coalesce(F.col("reason").rlike("^(too late|evicted|the session ended)"), F.lit(False))
    out = rows.groupBy(key).agg(F.count("*").alias("sentences"), n(text).alias("translated"), n(~F.col("answered")).alias("waiting"), n(F.col("answered") & ~text).alias("refused"), n(F.col("answered") & ~text & late).alias("dropped"), n(F.col("relabelled")).alias("relabelled_n"))
    if messages is None:
        return out.withColumn("partials", F.lit(0).cast("long"))
    shown = messages.where("kind = 'partial'").groupBy(key).agg(F.count("*").alias("partials"))
    return out.join(shown, key, "left").fillna(0, ["partials"])


def speakers_in_order(rows: DataFrame, key: str = "session_id", seq: str = "seq") -> DataFrame:
    """(session, speakers): labels by first appearance."""
    first = rows.groupBy(key, "speaker_id").agg(F.min(seq).alias("_q"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_q", "speaker_id"))), lambda x: x.speaker_id).alias("speakers"))
