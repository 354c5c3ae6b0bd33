"""Byte and sample series: reframing, windows, gaps and delivery."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import DEFAULTS


def reframe(chunks: DataFrame, frame_bytes: int = 1024, key: str = "session_id", order: str = "seq", pcm: str = "pcm", pad_tail: bool = False) -> DataFrame:
    """(key, frame_idx, pcm): the bytes of a session in frames of a fixed size, whatever the sizes of the chunks.

    A chunk is cut at frame bounds by its running offset, and the pieces of a frame are put together. The running sum
    reads sizes alone; no task holds the bytes of a session. order is unique within a session. The incomplete
    last frame is withheld, or filled with zero bytes.
    """
    size = F.octet_length(pcm)
    places = chunks.select(key, F.col(order).alias("_o"), size.alias("_n")).withColumn("_at", F.sum("_n").over(W.partitionBy(key).orderBy("_o")) - F.col("_n")).where("_n > 0")
    own = chunks.select(key, F.col(order).alias("_o"), F.col(pcm).alias("_b")).join(places, [key, "_o"])
    frames = F.sequence(F.floor(F.col("_at") / frame_bytes), F.floor((F.col("_at") + F.col("_n") - 1) / frame_bytes))
    start = lambda i: F.greatest(F.lit(0), i * frame_bytes - F.col("_at"))
    stop = lambda i: F.least("_n", (i + 1) * frame_bytes - F.col("_at"))
    # the chunk is cut before its pieces become rows, so that a row carries its own piece only
    cut = lambda i: F.struct(i.alias("frame_idx"), F.substr(F.col("_b"), (start(i) + 1).cast("int"), (stop(i) - start(i)).cast("int")).alias("b"))
    piece = own.select(key, "_at", F.explode(F.transform(frames, cut)).alias("p")).select(key, "_at", "p.*")
    sorted_ = F.array_sort(F.collect_list(F.struct("_at", "b")))
    whole = piece.groupBy(key, "frame_idx").agg(F.aggregate(sorted_, F.lit(b""), lambda acc, x: F.concat(acc, x.b)).alias("pcm"))
    if pad_tail:
        whole = whole.withColumn("pcm", F.expr(f"rpad(pcm, {int(frame_bytes)}, X'00')"))
    return whole.where(F.octet_length("pcm") == frame_bytes).select(key, "frame_idx", "pcm")


def decode_pcm(df: DataFrame, fmt: str = "s16", channels: int = 1, scale: float = 32768.0, pcm: str = "pcm") -> DataFrame:
    """Adds samples: array<float> of the mean of the channels; bytes of a partial last frame are dropped."""
    kinds = {"s16": ("<i2", scale), "s32": ("<i4", 2147483648.0), "f32": ("<f4", 1.0)}
    dtype, by = kinds[fmt]

    @F.pandas_udf("array<float>")
    def decode(raw: pd.Series) -> pd.Series:
        wide = np.dtype(dtype).itemsize * channels
        return raw.map(lambda b: None if b is None else (np.frombuffer(b[: len(b) // wide * wide], dtype).reshape(-1, channels).astype(np.float64).mean(axis=1) / by).astype(np.float32))

    return df.withColumn("samples", decode(pcm))


def encode_pcm(df: DataFrame, scale: float = 32767.0, samples: str = "samples") -> DataFrame:
    """Adds pcm: 16-bit little-endian bytes of samples, clipped to [-1, 1]."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.round(np.clip(np.asarray(v, np.float64), -1, 1) * scale).astype("<i2").tobytes())

    return df.withColumn("pcm", encode(samples))


def bytes_to_ms(n: Column, rate: int = DEFAULTS.sample_rate, width: int = 2) -> Column:
    return n / F.lit(rate * width / 1000)


def ms_to_bytes(ms: Column, rate: int = DEFAULTS.sample_rate, width: int = 2) -> Column:
    """Whole samples only."""
    return (F.floor(ms * rate / 1000) * width).cast("long")


def fixed_windows(values: Column, size: int) -> Column:
    """array of windows of size elements; the last one keeps what is left."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(values, i + 1, size))


def fill_window(values: Column, size: int) -> Column:
    """values repeated until they fill size elements; an empty array stays empty."""
    times = F.ceil(F.lit(size) / F.greatest(F.size(values), F.lit(1))).cast("int")
    return F.when(F.size(values) >= size, F.slice(values, 1, size)).otherwise(F.slice(F.flatten(F.array_repeat(values, times)), 1, size))


def tail(values: Column, n: int) -> Column:
    """The last n elements."""
    return F.when(F.size(values) > n, F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)).otherwise(values)


def arrival_gaps(df: DataFrame, limit_s: float, key: str = "session_id", ts: str = "arrived_at", tie: str = "seq") -> DataFrame:
    """(key, at_s, waited_s): pauses between arrivals longer than limit_s; at_s is seconds since the first arrival."""
    by = W.partitionBy(key).orderBy(ts, tie)
    s = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0)
    own = df.withColumns({"_s": s, "_p": F.lag(s).over(by), "_f": F.min(s).over(W.partitionBy(key))})
    return own.where(F.col("_s") - F.col("_p") > limit_s).select(key, (F.col("_p") - F.col("_f")).alias("at_s"), (F.col("_s") - F.col("_p")).alias("waited_s"))


def delivery_report(df: DataFrame, chunk_s: float, valid: Column, key: str = "session_id", ts: str = "arrived_at", tie: str = "seq") -> DataFrame:
    """Per key: chunks, malformed, largest gap, and audio time less wall time."""
    by = W.partitionBy(key).orderBy(ts, tie)
    s = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000.0)
    own = df.withColumns({"_s": s, "_gap": s - F.lag(s).over(by), "_ok": valid})
    wall = F.max("_s") - F.min("_s")
    return own.groupBy(key).agg(F.count("*").alias("chunks"), F.count(F.when(~F.col("_ok"), 1)).alias("malformed"), F.max("_gap").alias("largest_gap_s"), (F.count("*") * chunk_s - wall).alias("drift_s"))
