"""Segments of a score series, with hysteresis, padding and events: window functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import DEFAULTS


def speech_state(frames: DataFrame, key: str, order: str, value: str, threshold: float, neg: float, n_open: int, n_close: int) -> DataFrame:
    """Adds state: 1 after n_open values in a row at threshold or more, 0 after n_close under neg, else unchanged."""
    if neg > threshold:
        raise ValueError("neg must not be above threshold")
    by = W.partitionBy(key).orderBy(order)
    high, low = by.rowsBetween(1 - n_open, 0), by.rowsBetween(1 - n_close, 0)
    event = F.when((F.count(value).over(high) == n_open) & (F.min(value).over(high) >= threshold), 1).when((F.count(value).over(low) == n_close) & (F.max(value).over(low) < neg), 0)
    held = F.last(F.col("_event"), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    return frames.withColumn("_event", event).withColumn("state", F.coalesce(held, F.lit(0))).drop("_event")


def segment_hysteresis(frames: DataFrame, key: str = "session_id", order: str = "frame_idx", value: str = "prob", threshold: float = DEFAULTS.threshold, neg: float = DEFAULTS.neg_threshold, n_open: int = DEFAULTS.open_frames, n_close: int = DEFAULTS.close_frames, pad: int = DEFAULTS.pad_frames) -> DataFrame:
    """(key, segment_idx, start_frame, end_frame, open_at_end).

    order counts frames from 0 without gaps. A segment starts up to pad frames before the frame that opened it, but not
    before the frame that closed the one before; it ends at the frame that closed it, or at the end of
    the series (open_at_end).
    """
    by = W.partitionBy(key).orderBy(order)
    state = speech_state(frames, key, order, value, threshold, neg, n_open, n_close)
    total = F.count("*").over(W.partitionBy(key))
    marked = state.select(key, order, "state", F.lag("state", 1, 0).over(by).alias("_before"), total.alias("_total"))
    turn = marked.where("state <> _before").withColumns({"_closed": F.lag(order).over(by), "_end": F.lead(order).over(by)})
    opened = turn.where("state = 1")
    back = F.least(F.lit(pad), F.col(order) - F.coalesce("_closed", F.lit(0)))
    return opened.select(
        key, (F.row_number().over(by) - 1).cast("long").alias("segment_idx"), (F.col(order) - back).cast("long").alias("start_frame"),
        F.coalesce("_end", "_total").cast("long").alias("end_frame"), F.col("_end").isNull().alias("open_at_end"),
    )


def segment_events(segments: DataFrame, key: str = "session_id", frame_ms: float = DEFAULTS.frame_ms) -> DataFrame:
    """(key, kind, at_ms): speech_start and speech_end of every segment."""
    event = lambda kind, frame: F.struct(F.lit(kind).alias("kind"), (F.col(frame) * F.lit(float(frame_ms))).alias("at_ms"))
    both = F.array(event("speech_start", "start_frame"), event("speech_end", "end_frame"))
    return segments.select(key, F.explode(both).alias("e")).select(key, "e.kind", "e.at_ms")


def pair_events(events: DataFrame, key: str = "session_id") -> DataFrame:
    """(key, start_ms, end_ms) of starts that are followed by their end, later than they; at one time the end comes first."""
    by = W.partitionBy(key).orderBy("at_ms", "kind")
    ahead = events.withColumns({"_kind": F.lead("kind").over(by), "end_ms": F.lead("at_ms").over(by)})
    return ahead.where("kind = 'speech_start' and _kind = 'speech_end' and end_ms > at_ms").select(key, F.col("at_ms").alias("start_ms"), "end_ms")


def spans(segments: DataFrame, chunks: DataFrame, key: str = "session_id", frames_per_chunk: int = 6) -> DataFrame:
    """Each segment's part of each chunk: (key, segment_idx, chunk_idx, from_frame, to_frame, opens, closes).

    chunks: key, chunk_idx; a chunk holds frames_per_chunk frames. The join is on key and chunk number, as a segment
    lists the chunks it meets. One that ends on a chunk's first frame has an empty closing span there.
    """
    n = F.lit(frames_per_chunk)
    met = F.sequence(F.floor(F.col("start_frame") / n), F.floor(F.when(F.col("open_at_end"), F.col("end_frame") - 1).otherwise(F.col("end_frame")) / n))
    listed = segments.withColumn("chunk_idx", F.explode(met)).join(chunks.select(key, "chunk_idx"), [key, "chunk_idx"])
    start = F.greatest("start_frame", F.col("chunk_idx") * n)
    stop = F.least("end_frame", (F.col("chunk_idx") + 1) * n)
    return listed.select(
        key, "segment_idx", "chunk_idx", start.alias("from_frame"), stop.alias("to_frame"),
        (F.col("start_frame") >= F.col("chunk_idx") * n).alias("opens"),
        (~F.col("open_at_end") & (F.floor(F.col("end_frame") / n) == F.col("chunk_idx"))).alias("closes"),
    )


def segment_stats(frames: DataFrame, segments: DataFrame, key: str = "session_id", frame_bytes: int = 1024) -> DataFrame:
    """Per key: frames, segments, speech_frames, bytes in and forwarded, speech_ratio, dropped_ratio."""
    seen = frames.groupBy(key).agg(F.count("*").alias("frames"))
    speech = segments.groupBy(key).agg(F.count("*").alias("segments"), F.sum(F.col("end_frame") - F.col("start_frame")).alias("speech_frames"))
    out = seen.join(speech, key, "left").fillna(0, ["segments", "speech_frames"])
    ratio = F.col("speech_frames") / F.col("frames")
    return out.select(key, "frames", "segments", "speech_frames", (F.col("frames") * frame_bytes).alias("bytes_in"), (F.col("speech_frames") * frame_bytes).alias("bytes_out"), ratio.alias("speech_ratio"), (1 - ratio).alias("dropped_ratio"))
