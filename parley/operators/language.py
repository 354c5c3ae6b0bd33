"""Language decisions that prefer none to a guess, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import DEFAULTS


def language_code(label: Column) -> Column:
    """' JA : Japanese ' -> 'ja'."""
    return F.lower(F.trim(F.split_part(label, F.lit(":"), F.lit(1))))


def restricted_softmax(scores: Column, langs) -> Column:
    """Softmax over the wanted languages alone; scores: map<string,double>."""
    own = F.map_filter(scores, lambda k, v: k.isin(list(langs)))
    top = F.array_max(F.map_values(own))
    powers = F.transform_values(own, lambda k, v: F.exp(v - top))
    total = F.aggregate(F.map_values(powers), F.lit(0.0), lambda a, x: a + x)
    return F.transform_values(powers, lambda k, v: v / total)


def decide_language(df: DataFrame, langs=DEFAULTS.languages, min_margin: float = DEFAULTS.language_margin, min_ms: float = DEFAULTS.min_voice_ms, scores: str = "scores", duration: str = "duration_ms") -> DataFrame:
    """Adds lang_code ('' unknown), confidence, margin and reason.

    Too short, or without a score for a wanted language: unknown. A margin under min_margin:
    unknown too, but confidence and margin are told.
    """
    missing = F.array_except(F.array(*(F.lit(x) for x in langs)), F.map_keys(scores))
    short, lacks = F.col(duration) < min_ms, F.size(missing) > 0
    ranked = F.array_sort(F.transform(F.map_entries(restricted_softmax(F.col(scores), langs)), lambda e: F.struct((-e.value).alias("p"), e.key.alias("k"))))
    own = df.withColumn("_r", F.when(~short & ~lacks, ranked))
    best, margin = -F.get("_r", F.lit(0)).p, F.get("_r", F.lit(1)).p - F.get("_r", F.lit(0)).p
    sure = margin >= min_margin
    reason = F.when(short, F.format_string("too short (%.0f ms)", F.col(duration).cast("double"))).when(lacks, F.concat(F.lit("no score for "), F.array_join(missing, ", "))).when(~sure, F.format_string("undecided (margin %.2f)", margin)).otherwise("")
    return own.withColumns({"lang_code": F.when(sure, F.get("_r", F.lit(0)).k).otherwise(""), "confidence": F.coalesce(best, F.lit(0.0)), "margin": F.coalesce(margin, F.lit(0.0)), "reason": reason}).drop("_r")


def fill_language(df: DataFrame, key: str = "session_id", order: str = "seq", lang: str = "lang_code", final: str = "is_final") -> DataFrame:
    """Adds filled: an unknown row takes the last language that a final of its session was sure of, '' before any."""
    by = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    known = F.last(F.when(F.col(final) & (F.col(lang) != ""), F.col(lang)), ignorenulls=True).over(by)
    return df.withColumn("filled", F.when(F.col(lang) != "", F.col(lang)).otherwise(F.coalesce(known, F.lit(""))))


def language_flips(df: DataFrame, key: str = "session_id", order: str = "seq", lang: str = "lang_code", final: str = "is_final") -> DataFrame:
    """(key, order, predicted, lang): finals whose language is not that of the last partial since the final before."""
    by = W.partitionBy(key).orderBy(order)
    group = F.coalesce(F.sum(F.col(final).cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = df.withColumn("_g", group)
    near = W.partitionBy(key, "_g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    said = own.withColumn("predicted", F.last(F.when(~F.col(final), F.col(lang)), ignorenulls=True).over(near))
    return said.where(F.col(final) & (F.col(lang) != "") & (F.col("predicted") != "") & (F.col("predicted") != F.col(lang))).select(key, order, "predicted", lang)


def language_boundary(windows: DataFrame, keys: list[str], order: str = "window_idx", lang: str = "lang", probe: int = 1, steps: int = DEFAULTS.probe_steps) -> DataFrame:
    """(keys, at_window, before, after, probes, outcome): where an utterance of two languages changes.

    Both ends are probed; different sure languages start a search of so many steps that halves the stretch where the change
    lies, between a probe from the start and a probe from the end. An utterance is short: its languages are one array, '' undecided,
    and the search an expression on it.
    """
    told = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(lang, F.lit("")).alias("l")))), lambda x: x.l)
    own = windows.groupBy(*keys).agg(told.alias("_w")).withColumns({"_n": F.size("_w"), "_a": F.col("_w")[0], "_b": F.element_at("_w", -1)})
    outcome = F.when(F.col("_n") < 2 * probe, "too_short").when((F.col("_a") == "") | (F.col("_b") == ""), "undecided").when(F.col("_a") == F.col("_b"), "one_language").otherwise("split")
    stretch = lambda a, b, asked: F.struct(a.alias("a"), b.alias("b"), asked.alias("asked"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.a + s.b) / 2).cast("int")
        same = F.get("_w", mid) == F.col("_a")
        return F.when(s.b - s.a > 1, stretch(F.when(same, mid).otherwise(s.a), F.when(same, s.b).otherwise(mid), s.asked + 1)).otherwise(s)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), stretch(F.lit(probe), F.col("_n") - probe, F.lit(2)), halve)
    own = own.withColumn("outcome", outcome).withColumn("_f", F.when(F.col("outcome") == "split", found))
    # an utterance too short is not probed, and one without both languages names none
    named = lambda c: F.when(F.col("outcome").isin("split", "one_language"), F.col(c)).otherwise("")
    probes = F.when(F.col("outcome") == "too_short", 0).otherwise(F.coalesce("_f.asked", F.lit(2)))
    return own.select(*keys, F.col("_f.b").cast("long").alias("at_window"), named("_a").alias("before"), named("_b").alias("after"), probes.alias("probes"), "outcome")


def snap_to_quiet(boundaries: DataFrame, frames: DataFrame, keys: list[str], session: str = "session_id", frame_ms: float = DEFAULTS.frame_ms, search: int = 15) -> DataFrame:
    """Adds cut_ms: where a cut at at_ms falls between words, after the quietest of the last search whole frames before it.

    boundaries: keys, session, start_ms (of the utterance), at_ms; frames: session, frame_idx, power. Ties go to the earliest frame; frames
    before the utterance do not count; without any frame cut_ms is at_ms. Each boundary lists its few frames, so the join is an equality.
    """
    last, first = F.floor(F.col("at_ms") / frame_ms), F.ceil(F.col("start_ms") / frame_ms)
    low = F.greatest(last - search, first)
    listed = boundaries.where(low < last).select(*dict.fromkeys([*keys, session]), F.explode(F.sequence(low, last - 1)).alias("frame_idx"))
    met = listed.join(frames.select(session, "frame_idx", "power"), [session, "frame_idx"])
    quiet = met.groupBy(*keys).agg(F.min(F.struct("power", "frame_idx")).alias("_q")).select(*keys, ((F.col("_q.frame_idx") + 1) * F.lit(float(frame_ms))).alias("_c"))
    return boundaries.join(quiet, keys, "left").withColumn("cut_ms", F.coalesce("_c", "at_ms")).drop("_c")


def split_by_language(utterances: DataFrame, boundaries: DataFrame, keys: list[str], window_ms: float, least_ms: float = DEFAULTS.probe_ms) -> DataFrame:
    """One or two rows per utterance, of one index: cut at the boundary unless a part would be shorter than least_ms.

    The cut is at cut_ms, if the boundaries have been snapped to the quiet, else at the boundary's window.
    """
    own = utterances.join(boundaries.select(*keys, "before", "after", "cut_ms" if "cut_ms" in boundaries.columns else "at_window"), keys, "left")
    at = F.col("cut_ms") if "cut_ms" in own.columns else F.col("start_ms") + F.col("at_window") * F.lit(float(window_ms))
    ok = F.coalesce((at - F.col("start_ms") >= least_ms) & (F.col("end_ms") - at >= least_ms), F.lit(False))
    part = lambda n, a, b, lang, cont: F.struct(F.lit(n).alias("part"), a.alias("start_ms"), b.alias("end_ms"), lang.alias("lang_code"), cont.alias("continues_previous"))
    two = F.array(part(0, F.col("start_ms"), at, F.col("before"), F.col("continues_previous")), part(1, at, F.col("end_ms"), F.col("after"), F.lit(False)))
    one = F.array(part(0, F.col("start_ms"), F.col("end_ms"), F.coalesce("before", F.lit("")), F.col("continues_previous")))
    return own.select(*keys, F.explode(F.when(ok, two).otherwise(one)).alias("p")).select(*keys, "p.*")


def split_stats(boundaries: DataFrame, key: str = "session_id", order: str = "utt") -> DataFrame:
    """(session, checked, one count per outcome, probes, last_reason): last_reason is the outcome of the last utterance by order."""
    count = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    return boundaries.groupBy(key).agg(F.count("*").alias("checked"), count("split"), count("one_language"), count("undecided"), count("too_short"), F.sum("probes").alias("probes"), F.max_by("outcome", order).alias("last_reason"))


def language_stats(df: DataFrame, key: str = "session_id", lang: str = "lang_code") -> DataFrame:
    """(key, seen, unknown, decided, languages): languages maps each to its rows."""
    each = df.groupBy(key, lang).agg(F.count("*").alias("_n"))
    known = F.col(lang) != ""
    return each.groupBy(key).agg(F.sum("_n").alias("seen"), F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("unknown"), F.coalesce(F.sum(F.when(known, F.col("_n"))), F.lit(0)).alias("decided"), F.map_from_entries(F.array_sort(F.collect_list(F.when(known, F.struct(lang, "_n"))))).alias("languages"))


def evaluate_language(df: DataFrame, truth: str, lang: str = "lang_code", margin: str = "margin") -> DataFrame:
    """Per true language: right, wrong, unknown, and the interval of margins that would separate right from wrong."""
    right, unknown = F.col(lang) == F.col(truth), F.col(lang) == ""
    wrong = ~right & ~unknown
    return df.groupBy(F.col(truth).alias("truth")).agg(
        F.count(F.when(right, 1)).alias("right_n"), F.count(F.when(wrong, 1)).alias("wrong_n"), F.count(F.when(unknown, 1)).alias("unknown_n"),
        F.min(F.when(right, F.col(margin))).alias("least_right"), F.max(F.when(wrong, F.col(margin))).alias("most_wrong"), F.percentile(margin, F.lit(0.5)).alias("median_margin"),
    )
