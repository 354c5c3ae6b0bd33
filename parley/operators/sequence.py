"""Rules that go through the rows of a key in order, with a small state, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def in_sequence(df: DataFrame, keys: list[str], order: str, start: Callable[[], object], step: Callable[[object, dict], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that step(state, row) gives for the rows of each key in order; start() makes the state of a key.

    Keys are dealt to tasks and rows sorted by Spark, which spills; a task reads them batch by batch and carries the state of
    one key from batch to batch, so that a key of any number of rows needs no more memory than its state.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    kind = StructType.fromDDL(schema)
    types = [to_arrow_type(f.dataType) for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != own:
                    own, state = key, start()
                out += step(state, row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(col), t) for col, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, kind)
