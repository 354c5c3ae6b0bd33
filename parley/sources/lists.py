"""Word lists, pattern lists and recordings."""

from __future__ import annotations

import io
import re
import wave

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.config import DEFAULTS


def entries(lines: DataFrame, value: str = "value") -> DataFrame:
    """(line): trimmed lines; blank ones and those that begin with # are left out."""
    own = lines.select(F.regexp_replace(value, r"^\s+|\s+$", "").alias("line"))
    return own.where((F.col("line") != "") & ~F.col("line").startswith("#"))


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """Entries of text files, also of zipped or partitioned ones; a missing path is an empty list."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    return entries(lines)


def read_patterns(spark: SparkSession, path: str, most: int = 10_000) -> tuple[list[str], list[tuple[str, str]]]:
    """(patterns, bad ones with the reason): a pattern list is short, it becomes part of an expression."""
    good, bad = [], []
    rows = read_wordlist(spark, path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns")
    for r in rows:
        try:
            re.compile(r.line)
            good.append(r.line)
        except re.error as e:
            bad.append((r.line, str(e)))
    return good, bad


def scan_recordings(spark: SparkSession, glob: str, chunk_bytes: int = DEFAULTS.chunk_bytes) -> DataFrame:
    """(path, seq, pcm, problem) of WAV files: chunks of 16 kHz mono 16-bit audio, or one row with the problem."""

    def read(batches):
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(raw)) as w:
                        told = [f"{n} is {v}, not {want}" for n, v, want in (("rate", w.getframerate(), DEFAULTS.sample_rate), ("channels", w.getnchannels(), 1), ("sample width", w.getsampwidth(), 2)) if v != want]
                        pcm = b"" if told else w.readframes(w.getnframes())
                    rows = [(path, i, pcm[at : at + chunk_bytes], "") for i, at in enumerate(range(0, len(pcm), chunk_bytes))] or [(path, 0, None, "; ".join(told) or "no audio")]
                except (wave.Error, EOFError) as e:
                    rows = [(path, 0, None, f"not a WAV file: {e}")]
                yield pd.DataFrame(rows, columns=["path", "seq", "pcm", "problem"])

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(read, "path string, seq long, pcm binary, problem string")
