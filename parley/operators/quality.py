"""Cost, lag and invariants of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import DEFAULTS


def session_summary(finals: DataFrame, answers: DataFrame, utterances: DataFrame, key: str = "session_id", **more: DataFrame) -> DataFrame:
    """One wide row per session from aggregates that are made before the join; what is not there counts as 0.

    more, each optional: chunks (bytes), segments, partials, flips, corrections, splits (boundaries with outcome), runs
    (rows of circuit_breaker: stage, failed, skipped, notice), timings (item_id, seconds) and lags (rows of answer_status: lag_s).
    """
    n = lambda c: F.count(F.when(c, 1))
    text = F.length(F.trim(F.coalesce("translation", F.lit("")))) > 0
    late = F.coalesce(F.col("reason").rlike("^(too late|evicted|the session ended)"), F.lit(False))
    f = finals.groupBy(key).agg(F.count("*").alias("sentences"), F.sum(F.length("transcript")).alias("chars"), F.count_distinct("speaker_id").alias("speakers"))
    a = answers.groupBy(key).agg(F.count("*").alias("answers"), n(F.length("translation") > 0).alias("translated"), n(F.col("reason") != "").alias("refused"), n(~text & late).alias("dropped"), F.count_distinct(F.when(F.col("lang_code") != "", F.col("lang_code"))).alias("languages"), n(F.col("lang_code") != "").alias("with_language"))
    u = utterances.groupBy(key).agg(F.count("*").alias("utterances"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("audio_ms"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"))
    makers = {
        "chunks": lambda t: t.groupBy(key).agg(F.count("*").alias("chunks"), F.sum("bytes").cast("long").alias("bytes")),
        "segments": lambda t: t.groupBy(key).agg(F.count("*").alias("segments")),
        "partials": lambda t: t.groupBy(key).agg(F.count("*").alias("partials")),
        "flips": lambda t: t.groupBy(key).agg(F.count("*").alias("language_flips")),
        "corrections": lambda t: t.groupBy(key).agg(F.count("*").alias("speaker_corrections")),
        "splits": lambda t: t.groupBy(key).agg(n(F.col("outcome") == "split").alias("language_splits")),
        "runs": lambda t: t.groupBy(key).agg(n(F.col("failed") & ~F.col("skipped")).alias("stage_failures"), n(F.col("notice")).alias("stages_disabled")),
        "timings": lambda t: t.groupBy(key, "item_id").agg(F.sum("seconds").alias("s")).groupBy(key).agg(F.sum("s").alias("stage_seconds"), F.max("s").alias("slowest_item_s")),
        "lags": lambda t: t.groupBy(key).agg(F.max("lag_s").alias("worst_lag_s")),
    }
    out = f
    for part in (a, u, *(makers[name](t) for name, t in more.items())):
        out = out.join(part, key, "full")
    return out.fillna(0, [c for c in out.columns if c != key])


def _exact_sum(c: str) -> Column:
    """The sum of doubles by their decimals, 12 places of them, so that it does not depend on the order of the rows and equal sums are equal."""
    return F.sum(F.col(c).cast("decimal(28,12)")).cast("double")


def _summed(rows: DataFrame, keys: list[str], order: str | None, **values: str) -> DataFrame:
    """(keys, the named sums, and _at, the least order): added up as doubles, row by row in that order, as SQL adds rows that come so; by decimals without one."""
    if order is None:
        return rows.groupBy(*keys).agg(*(_exact_sum(c).alias(n) for n, c in values.items()))
    by = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    run = rows.select(*keys, order, *(F.sum(c).over(by).alias(n) for n, c in values.items()))
    return run.groupBy(*keys).agg(F.min(order).alias("_at"), *(F.max_by(n, order).alias(n) for n in values))


def stage_cost(timings: DataFrame, key: str = "session_id", order: str | None = None) -> DataFrame:
    """(session, stage, seconds, share, rank): seconds of each stage and their share of the audio.

    order, unique in a session, says in what order doubles are added up; without it they are summed by decimals.
    """
    each = _summed(timings, [key, "stage"], order, seconds="seconds", _a="audio_seconds")
    by = W.partitionBy(key).orderBy(F.desc("seconds"), "stage")
    return each.select(key, "stage", "seconds", (F.col("seconds") / F.max("_a").over(W.partitionBy(key))).alias("share"), F.row_number().over(by).alias("rank"))


def slow_items(timings: DataFrame, keys: list[str], limit_s: float = DEFAULTS.slow_s, order: str | None = None) -> DataFrame:
    """(keys, total, worst, breakdown): items that took limit_s or more, their slowest stage and all stages.

    order as in stage_cost; the stages of an item are added up in the order in which they begin.
    """
    each = _summed(timings, [*keys, "stage"], order, s="seconds")
    told = [F.max(F.struct("s", "stage")).alias("w"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "s")))).alias("breakdown")]
    if order is None:
        out = each.groupBy(*keys).agg(_exact_sum("s").alias("total"), *told)
    else:
        run = F.sum("s").over(W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
        out = each.withColumn("_t", run).groupBy(*keys).agg(F.max_by("_t", "_at").alias("total"), *told)
    return out.where(F.col("total") >= limit_s).select(*keys, "total", F.col("w.stage").alias("worst"), "breakdown")


def circuit_breaker(runs: DataFrame, keys: list[str], order: str = "seq", failed: str = "failed", message: str = "message", limit: int = DEFAULTS.failures, fatal: str = r"(?i)cuda|cudnn|cublas|out of memory") -> DataFrame:
    """Adds skipped and notice: a stage is off after limit failures in a row, or at once after a fatal message; rows
    behind that one are skipped, and that row alone carries the notice."""
    by = W.partitionBy(*keys).orderBy(order)
    near = by.rowsBetween(1 - limit, 0)
    row = F.sum(F.col(failed).cast("int")).over(near) == limit
    trip = row | (F.col(failed) & F.coalesce(F.col(message).rlike(fatal), F.lit(False)))
    own = runs.withColumn("_t", trip)
    at = F.min(F.when(F.col("_t"), F.col(order))).over(W.partitionBy(*keys))
    return own.withColumn("_a", at).withColumns({"skipped": F.coalesce(F.col(order) > F.col("_a"), F.lit(False)), "notice": F.coalesce(F.col(order) == F.col("_a"), F.lit(False))}).drop("_t", "_a")


def event_lag(events: DataFrame, start_s: Column | None = None) -> DataFrame:
    """Adds lag_ms: arrival less position, both from the start."""
    start = F.lit(0.0) if start_s is None else start_s
    return events.withColumn("lag_ms", (F.col("arrived_s") - start) * 1000 - F.col("at_ms"))


def corrected_lag(events: DataFrame, gaps: DataFrame, key: str = "session_id") -> DataFrame:
    """Adds corrected_ms: the lag less all pauses that began at or before the event's position.

    A pause at gap_at_s of arrival stands at that time less the pauses before it. Events and pauses are one
    ordered series per session; a running sum carries the pauses to the events (an as-of join without a join).
    """
    by = W.partitionBy(key).orderBy("gap_at_s")
    before = F.coalesce(F.sum("waited_s").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    marks = gaps.select(key, ((F.col("gap_at_s") - before) * 1000).alias("at_ms"), F.col("waited_s").alias("_w"), F.lit(0).alias("_k"))
    rows = events.withColumns({"_w": F.lit(0.0), "_k": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    run = F.sum("_w").over(W.partitionBy(key).orderBy("at_ms", "_k").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("corrected_ms", F.col("lag_ms") - run * 1000).where("_k = 1").drop("_w", "_k")


def judgeable(wall_s: Column, audio_s: Column, gaps_s: Column, limit_s: float = 1.0) -> Column:
    """Lag is judged only where all missing audio but limit_s is explained by pauses."""
    return wall_s - audio_s - gaps_s <= limit_s


def check_session(utterances: DataFrame, finals: DataFrame, answers: DataFrame, key: str = "session_id", longest_ms: float = DEFAULTS.max_utterance_ms + 40) -> DataFrame:
    """(session, name, passed, failures): the invariants of a session, one row each.

    What is dropped has a label where the utterances tell kept and label; a refused answer shows its raw text where the
    answers tell raw and the model did answer.
    """
    by = W.partitionBy(key).orderBy("idx")
    if "continues_previous" not in utterances.columns:
        utterances = utterances.withColumn("continues_previous", F.lit(False))
    u = utterances.withColumns({"_i": F.row_number().over(by) - 1, "_e": F.lag("end_ms").over(by)})
    bad = lambda c: F.count(F.when(c, 1))
    first = u.groupBy(key).agg(
        bad(F.col("idx") != F.col("_i")).alias("indexes are consecutive"), bad(F.col("end_ms") - F.col("start_ms") > longest_ms).alias("no utterance is too long"),
        bad(F.col("start_ms") < F.col("_e")).alias("utterances do not overlap"), bad(F.col("end_ms") <= F.col("start_ms")).alias("utterances have length"),
        bad(F.col("continues_previous") & (F.abs(F.col("start_ms") - F.col("_e")) >= 1)).alias("a continuation has no gap"),
        *([bad(~F.col("kept") & (F.coalesce("label", F.lit("")) == "")).alias("what is dropped has a label")] if {"kept", "label"} <= set(utterances.columns) else []),
    )
    raw = ["raw"] if "raw" in answers.columns else []
    judged = F.coalesce(F.col("reason").startswith("the answer"), F.lit(False))
    said = finals.join(answers.select(key, "sentence_id", "translation", "reason", *raw), [key, "sentence_id"], "left")
    text = F.coalesce(F.trim("translation"), F.lit("")) != ""
    second = said.groupBy(key).agg(
        bad(F.coalesce(F.trim("transcript"), F.lit("")) == "").alias("finals have text"), bad(F.col("speaker_id").isNull()).alias("finals have a speaker"),
        bad(F.col("translation").isNull() & F.col("reason").isNull()).alias("finals are answered"), bad(~text & (F.coalesce("reason", F.lit("")) == "")).alias("no silent refusal"),
        bad(text & (F.col("translation") == F.col("transcript"))).alias("no answer is its source"),
        *([bad(F.coalesce("lang_code", F.lit("")) == "").alias("finals have a language")] if "lang_code" in finals.columns else []),
        *([bad(judged & (F.coalesce("raw", F.lit("")) == "")).alias("a refused answer shows its text")] if raw else []),
    )
    tall = lambda df: df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("failures")) for c in df.columns if c != key))).alias("c"))
    return tall(first).unionByName(tall(second)).select(key, "c.name", (F.col("c.failures") == 0).alias("passed"), "c.failures")


def check_events(events: DataFrame, utterances: DataFrame, partials: DataFrame, finals: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """(session, name, passed, failures) of the log of events: starts and ends alternate and are as many, no end
    without its utterance, and the first running text comes before the first committed one."""
    by = W.partitionBy(key).orderBy("at_ms", "kind")
    e = events.withColumn("_b", F.lag("kind").over(by))
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    turns = e.groupBy(key).agg(F.count(F.when(F.col("_b") == F.col("kind"), 1)).alias("alternate"), (n("speech_start") - n("speech_end")).alias("more_starts"), n("speech_end").alias("_ends"))
    said = utterances.groupBy(key).agg(F.count("*").alias("_n"))
    first = partials.groupBy(key).agg(F.min(order).alias("_p")).join(finals.groupBy(key).agg(F.min(order).alias("_f")), key, "full")
    own = turns.join(said, key, "left").join(first, key, "left")
    checks = {"starts and ends alternate": F.col("alternate"), "as many starts as ends": F.abs("more_starts"), "no end without an utterance": F.greatest(F.lit(0), F.col("_ends") - F.coalesce("_n", F.lit(0))), "running text comes first": F.coalesce((F.col("_p") >= F.col("_f")).cast("int"), F.lit(0))}
    tall = own.select(key, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("long").alias("failures")) for k, v in checks.items()))).alias("c"))
    return tall.select(key, "c.name", (F.col("c.failures") == 0).alias("passed"), "c.failures")


def check_partition(utterances: DataFrame, segments: DataFrame, frame_ms: float, key: str = "session_id") -> DataFrame:
    """(session, audio_ms, forwarded_ms, twice, covered): utterances hold exactly the forwarded audio, and nothing twice
    (twice: utterances that begin before an earlier one ends)."""
    before = F.max("end_ms").over(W.partitionBy(key).orderBy("start_ms", "end_ms").rowsBetween(W.unboundedPreceding, -1))
    own = utterances.withColumn("_b", before)
    u = own.groupBy(key).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("audio_ms"), F.count(F.when(F.col("start_ms") < F.col("_b"), 1)).alias("twice"))
    s = segments.groupBy(key).agg(F.sum((F.col("end_frame") - F.col("start_frame")) * F.lit(float(frame_ms))).alias("forwarded_ms"))
    return u.join(s, key, "full").withColumn("covered", F.coalesce((F.col("audio_ms") == F.col("forwarded_ms")) & (F.col("twice") == 0), F.lit(False)))


def latency_report(df: DataFrame, keys: list[str], value: str = "seconds", shares: tuple = (0.5, 0.9, 0.99)) -> DataFrame:
    """(keys, n, mean, worst, p50, ...): percentiles by nearest rank, max(1, min(n, round(share * n)))."""
    by, whole = W.partitionBy(*keys).orderBy(value), W.partitionBy(*keys)
    own = df.select(*keys, F.col(value).alias("_v"), F.row_number().over(by).alias("_r"), F.count("*").over(whole).alias("_n"))
    rank = lambda s: F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.col("_n") * F.lit(s)).cast("long")))
    return own.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.max("_v").alias("worst"), *(F.max(F.when(F.col("_r") == rank(s), F.col("_v"))).alias(f"p{round(s * 100)}") for s in shares))


def partial_cadence(ticks: DataFrame, keys: list[str], every_ms: float = DEFAULTS.partial_every_ms) -> DataFrame:
    """(keys, largest_gap_ms, ok): no pause between partials above twice the interval."""
    by = W.partitionBy(*keys).orderBy("at_ms")
    own = ticks.withColumn("_g", F.col("at_ms") - F.lag("at_ms").over(by))
    return own.groupBy(*keys).agg(F.coalesce(F.max("_g"), F.lit(0.0)).alias("largest_gap_ms")).withColumn("ok", F.col("largest_gap_ms") <= 2 * every_ms)


def sentence_gaps(df: DataFrame, key: str, at_s: Column, order: list) -> DataFrame:
    """(session, n, median_gap_s, shortest_gap_s, busiest_per_s)."""
    by = W.partitionBy(key).orderBy(*order)
    own = df.withColumn("_s", at_s).withColumn("_g", F.col("_s") - F.lag("_s").over(by))
    out = own.groupBy(key).agg(F.count("_g").alias("n"), F.percentile("_g", F.lit(0.5)).alias("median_gap_s"), F.min("_g").alias("shortest_gap_s"))
    return out.withColumn("busiest_per_s", F.when(F.col("shortest_gap_s") > 0, 1 / F.col("shortest_gap_s")))
