"""Segments to utterances: length limit at the quietest frame, numbering, running windows, counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import DEFAULTS


def quietest_split(frames: DataFrame, keys: list[str], order: str = "frame_idx", power: str = "power", limit: int = 218, search: int = 15, prefer_late: bool = False) -> DataFrame:
    """(keys, cut): one past the frame of least power among the last `search` before frame number `limit` of each group.

    Frames count from 0 in the group. Ties go to the earliest, or the latest; without frames there, cut is limit.
    """
    tie = -F.col(order) if prefer_late else F.col(order)
    inside = (F.col(order) >= limit - search) & (F.col(order) < limit)
    found = frames.groupBy(*keys).agg(F.min(F.when(inside, F.struct(F.col(power), tie.alias("_tie"), F.col(order).alias("at")))).alias("q"))
    return found.select(*keys, F.coalesce(F.col("q.at") + 1, F.lit(limit)).cast("long").alias("cut"))


def split_points(power: np.ndarray, limit: int, search: int) -> list[int]:
    """Cuts of one long segment: while limit frames or more are open, after the quietest of the last `search`."""
    cuts, at = [], 0
    while len(power) - at >= limit:
        low = max(at, at + limit - search)
        at = low + int(np.argmin(power[low : at + limit])) + 1
        cuts.append(at)
    return cuts


def build_utterances(segments: DataFrame, frames: DataFrame, key: str = "session_id", frame_ms: float = DEFAULTS.frame_ms, limit: int = 218, search: int = 15) -> DataFrame:
    """(key, idx, start_ms, end_ms, reason, continues_previous) of every segment.

    A segment of limit frames or more is split at quiet frames (max_duration; what follows continues it); its rest ends
    by pause, or end_of_stream where the segment was open. Only segments that need a split read
    their frames, as one array each, bounded by the segment; cuts fall on frames. idx counts from 0 in the session.
    """
    size = F.col("end_frame") - F.col("start_frame")
    long = segments.where(size >= limit)
    # both sides know stretches of limit frames, so that the join is an equality and reads a session once
    stretch = lambda at: F.floor(at / limit)
    spread = long.select(key, "segment_idx", "start_frame", "end_frame", F.explode(F.sequence(stretch(F.col("start_frame")), stretch(F.col("end_frame") - 1))).alias("_s"))
    met = frames.select(key, "frame_idx", "power", stretch(F.col("frame_idx")).alias("_s")).join(spread, [key, "_s"]).where("frame_idx >= start_frame and frame_idx < end_frame")

    @F.pandas_udf("array<long>")
    def cuts(power: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([[int(a) + c for c in split_points(np.asarray(p, np.float64), limit, search)] for p, a in zip(power, first, strict=True)])

    made = met.groupBy(key, "segment_idx").agg(F.first("start_frame").alias("_a"), F.array_sort(F.collect_list(F.struct("frame_idx", "power"))).alias("_f"))
    made = made.select(key, "segment_idx", cuts(F.col("_f.power"), F.col("_a")).alias("cuts"))
    whole = segments.join(made, [key, "segment_idx"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>")))
    parts = F.arrays_zip(F.concat(F.array("start_frame"), F.col("cuts")).alias("a"), F.concat(F.col("cuts"), F.array("end_frame")).alias("b"))
    each = whole.select(key, "segment_idx", "open_at_end", F.size("cuts").alias("n"), F.posexplode(parts).alias("part", "p")).where("p.b > p.a")
    last = F.when(F.col("open_at_end"), "end_of_stream").otherwise("pause")
    by = W.partitionBy(key).orderBy("segment_idx", "part")
    return each.select(
        key, (F.row_number().over(by) - 1).cast("long").alias("idx"), (F.col("p.a") * F.lit(float(frame_ms))).alias("start_ms"), (F.col("p.b") * F.lit(float(frame_ms))).alias("end_ms"),
        F.when(F.col("part") < F.col("n"), "max_duration").otherwise(last).alias("reason"), (F.col("part") > 0).alias("continues_previous"),
    )


def utterances_from_events(events: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Utterances of a log of speech_start and speech_end: a start while one is open ends that one as pause; what is
    open at the end is end_of_stream; empty ones are left out after numbering."""
    by = W.partitionBy(key).orderBy(order)
    ahead = events.withColumns({"_next": F.lead("kind").over(by), "end_ms": F.lead("at_ms").over(by), "_last": F.max("at_ms").over(W.partitionBy(key))})
    made = ahead.where("kind = 'speech_start'")
    reason = F.when(F.col("_next").isNull(), "end_of_stream").otherwise("pause")
    out = made.select(key, (F.row_number().over(by) - 1).cast("long").alias("idx"), F.col("at_ms").alias("start_ms"), F.coalesce("end_ms", "_last").alias("end_ms"), reason.alias("reason"))
    return out.where("end_ms > start_ms")


def cut_at(utterances: DataFrame, cuts: DataFrame, key: str = "session_id") -> DataFrame:
    """Cuts utterances at (key, idx, at_ms); the second part is no continuation; a cut outside changes nothing."""
    inside = (F.col("at_ms") > F.col("start_ms")) & (F.col("at_ms") < F.col("end_ms"))
    own = utterances.join(cuts.select(key, "idx", "at_ms"), [key, "idx"], "left")
    part = lambda a, b, n, c: F.struct(F.col(a).alias("start_ms"), F.col(b).alias("end_ms"), F.lit(n).alias("part"), c.alias("continues_previous"))
    one, two = part("start_ms", "at_ms", 0, F.col("continues_previous")), part("at_ms", "end_ms", 1, F.lit(False))
    whole = part("start_ms", "end_ms", 0, F.col("continues_previous"))
    parts = F.explode(F.when(inside, F.array(one, two)).otherwise(F.array(whole)))
    return own.select(key, "idx", "reason", parts.alias("p")).select(key, "idx", "p.part", "p.start_ms", "p.end_ms", "reason", "p.continues_previous")


def partial_ticks(utterances: DataFrame, key: str = "session_id", every_ms: int = DEFAULTS.partial_every_ms, chunk_ms: int = DEFAULTS.chunk_ms) -> DataFrame:
    """(key, idx, tick, at_ms): when the open utterance has grown by every_ms since the last tick, on the grid of chunks."""
    step = -(-every_ms // chunk_ms) * chunk_ms
    n = F.floor((F.col("end_ms") - F.col("start_ms")) / step)
    own = utterances.where(n >= 1).withColumn("tick", F.explode(F.sequence(F.lit(1), n.cast("int"))))
    return own.select(key, "idx", "tick", (F.col("start_ms") + F.col("tick") * F.lit(float(step))).alias("at_ms"))


def running_text(utterances: DataFrame, key: str = "session_id", every_ms: int = DEFAULTS.partial_every_ms, chunk_ms: int = DEFAULTS.chunk_ms, frame_ms: float = DEFAULTS.frame_ms, limit_ms: float = DEFAULTS.max_utterance_ms) -> DataFrame:
    """(key, idx, tick, at_ms, start_ms): partial_ticks as they were due while the utterances were open.

    One that was cut for its length had grown to a frame below the limit before the cut, which lies before that, was known.
    """
    grown = F.when(F.col("reason") == "max_duration", F.col("start_ms") + (limit_ms - frame_ms)).otherwise(F.col("end_ms"))
    ticks = partial_ticks(utterances.withColumn("end_ms", grown), key, every_ms, chunk_ms)
    return ticks.join(utterances.select(key, "idx", "start_ms"), [key, "idx"])


def tail_window(start_ms: Column, end_ms: Column, seconds: float = DEFAULTS.partial_window_ms / 1000) -> Column:
    """Start of the last seconds of an utterance."""
    return F.greatest(start_ms, end_ms - seconds * 1000)


def utterance_stats(utterances: DataFrame, key: str = "session_id") -> DataFrame:
    """Per key: utterances, one count per reason, audio_ms, longest_ms."""
    size = F.col("end_ms") - F.col("start_ms")
    count = lambda r: F.count(F.when(F.col("reason") == r, 1)).alias(r)
    return utterances.groupBy(key).agg(F.count("*").alias("utterances"), count("pause"), count("max_duration"), count("end_of_stream"), F.sum(size).alias("audio_ms"), F.max(size).alias("longest_ms"))
