"""Models plugged in as columns: one model for each worker, whole batches at a call, and failures as reasons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from parley.operators.sequence import in_sequence

PIECES = "text string, avg_logprob double, no_speech_prob double, compression_ratio double"


def answers(model: Callable, asked: list) -> tuple[list, list[str]]:
    """What the model says to each of asked, and the reason where it failed. If a whole batch fails, its inputs are asked one by one."""
    try:
        said = list(model(asked))
        if len(said) != len(asked):
            raise ValueError(f"{len(said)} answers to {len(asked)} inputs")
        return said, [""] * len(asked)
    except Exception as whole:
        if len(asked) == 1:
            return [None], [f"{type(whole).__name__}: {whole}"]
        both = [answers(model, [a]) for a in asked]
        return [said[0] for said, _ in both], [reason[0] for _, reason in both]


def modelled(make: Callable[[], Callable[[list], list]], inputs: str | Column, kind: str) -> Column:
    """struct<value: kind, error: string> of a model over a column.

    make() loads the model, once in each worker (a scalar iterator function), and the model takes a list of inputs and gives as many
    values. Null inputs are not asked: their value is null, without an error. The contracts of the library are kinds of it:
    classifier and language scorer map<string,double>, embedder array<float>, processor array to array.
    """
    @F.pandas_udf(f"value {kind}, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for one in batches:
            asked = [i for i, there in enumerate(one.notna()) if there]
            said, error = answers(model, [one.iloc[i] for i in asked]) if asked else ([], [])
            value, reason = [None] * len(one), [""] * len(one)
            for i, v, e in zip(asked, said, error, strict=True):
                value[i], reason[i] = v, e
            yield pd.DataFrame({"value": pd.Series(value, dtype=object), "error": reason})

    return run(inputs)


def classify(df: DataFrame, make: Callable, inputs: str = "samples", name: str = "scores") -> DataFrame:
    """Adds name, a map of labels to scores, and error: for the label and language policies."""
    out = df.withColumn("_m", modelled(make, F.col(inputs), "map<string,double>"))
    return out.withColumns({name: F.col("_m.value"), "error": F.col("_m.error")}).drop("_m")


def embed(df: DataFrame, make: Callable, inputs: str = "samples", name: str = "embedding") -> DataFrame:
    """Adds name, a vector, and error: for the voice operators."""
    out = df.withColumn("_m", modelled(make, F.col(inputs), "array<float>"))
    return out.withColumns({name: F.col("_m.value"), "error": F.col("_m.error")}).drop("_m")


def process(df: DataFrame, make: Callable, samples: str = "samples") -> DataFrame:
    """samples as the model gives them back, and error; where it fails they stay as they are."""
    out = df.withColumn("_m", modelled(make, F.col(samples), "array<float>"))
    return out.withColumns({samples: F.coalesce("_m.value", F.col(samples).cast("array<float>")), "error": F.col("_m.error")}).drop("_m")


def score_frames(df: DataFrame, make: Callable[[], Callable], keys: list[str], order: str = "frame_idx", frame: str = "samples") -> DataFrame:
    """(keys, order, prob): a scorer that remembers what it heard: make() gives a fresh one for each session, which takes one frame after the other."""
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}", "prob double"])
    step = lambda scorer, row: [(*(row[k] for k in keys), row[order], scorer(row[frame]))]
    return in_sequence(df.select(*keys, order, frame), keys, order, make, step, schema)


def decode(df: DataFrame, make: Callable, keys: list[str], inputs: str = "samples") -> DataFrame:
    """(keys, piece_idx, text, avg_logprob, no_speech_prob, compression_ratio, error): the pieces that the decoder hears in each row.

    The decoder takes a list of inputs and gives for each a list of pieces as dictionaries. A row without pieces has no rows here; one that failed has
    a row with its error alone, of piece_idx null.
    """
    own = df.select(*keys, F.col(inputs).alias("_in")).where(F.col("_in").isNotNull())
    named = own.drop("_in").schema
    schema = StructType([*named.fields, *StructType.fromDDL(f"piece_idx int, {PIECES}, error string").fields])
    types = [to_arrow_type(f.dataType) for f in schema]
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            rows, out = b.to_pylist(), []
            said, error = answers(model, [r["_in"] for r in rows])
            for row, pieces, reason in zip(rows, said, error, strict=True):
                own = [row[k] for k in keys]
                if reason:
                    out.append([*own, None, None, None, None, None, reason])
                out += [[*own, i, *(p.get(n) for n in names), ""] for i, p in enumerate(pieces or [])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

    return own.mapInArrow(run, schema)
