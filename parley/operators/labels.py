"""Policies on sound-label scores that drop a row only for a clear reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import DEFAULTS


def best_label(scores: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """(keys, score, label): the highest score of any window among the labels, ties to the first label of the list;
    0 and '' where none is above 0."""
    rank = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("label"))
    inside = F.when((rank > 0) & (F.col("score") > 0), F.struct("score", (-rank).alias("r"), "label"))
    best = scores.groupBy(*keys).agg(F.max(inside).alias("m"))
    return best.select(*keys, F.coalesce("m.score", F.lit(0.0)).alias("score"), F.coalesce("m.label", F.lit("")).alias("label"))


def top_labels(scores: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """(keys, rank, label, score): the n labels of the highest peak score, ties by label."""
    peak = scores.groupBy(*keys, "label").agg(F.max("score").alias("score"))
    by = W.partitionBy(*keys).orderBy(F.desc("score"), "label")
    return peak.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def keep_verdict(best: DataFrame, speech: str = "speech_score", noise: str = "noise_score", label: str = "noise_label") -> DataFrame:
    """Adds keep and reason; null scores (an empty row) are dropped."""
    s, n = F.col(speech), F.col(noise)
    keep = F.when(s.isNull() | n.isNull(), False).otherwise((s >= DEFAULTS.min_speech) | (n < DEFAULTS.min_noise))
    reason = F.when(s.isNull() | n.isNull(), "empty").when(s >= DEFAULTS.min_speech, "speech").when(n < DEFAULTS.min_noise, "nothing conclusive").otherwise(F.format_string("noise: %s (%.2f)", F.col(label), F.floor(n * 100) / 100))
    return best.withColumns({"keep": keep, "reason": reason})


def label_coverage(scores: DataFrame, speech: list[str], noise: list[str]) -> DataFrame:
    """One row: how many labels of both lists are known, the names of the missing ones in the lists' order; ok only
    where each list has a known one. Only labels of the lists are gathered."""
    known = scores.where(F.col("label").isin([*speech, *noise])).select("label").distinct().agg(F.collect_list("label").alias("_k"))
    missing = lambda ls: F.array_except(F.array(*(F.lit(x) for x in ls)), "_k")
    out = known.select(missing(speech).alias("_s"), missing(noise).alias("_n"))
    left = out.select((len(set(speech)) - F.size("_s")).cast("long").alias("speech_known"), (len(set(noise)) - F.size("_n")).cast("long").alias("noise_known"), F.array_join("_s", ",").alias("speech_missing"), F.array_join("_n", ",").alias("noise_missing"))
    return left.withColumn("ok", (F.col("speech_known") > 0) & (F.col("noise_known") > 0))


def verdict_stats(verdicts: DataFrame, label: str = "noise_label") -> DataFrame:
    """(label, dropped, kept) by the noise label of the rows."""
    return verdicts.groupBy(F.col(label).alias("label")).agg(F.count(F.when(~F.col("keep"), 1)).alias("dropped"), F.count(F.when(F.col("keep"), 1)).alias("kept"))
