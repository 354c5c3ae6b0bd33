"""What the operators on whole-number vectors share: blocks of rows, exact distances, sums of all blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import cut

#: Rows of a block, which one task holds at a time.
BLOCK = 4096
#: Scaled components of this size or more would give distances beyond a long: such vectors take no part.
LARGEST = 1 << 26


def usable(vector: Column, scale: int) -> Column:
    """No null vector, no component that is null, not finite, or too large once scaled."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) * scale < LARGEST, F.lit(False)))


def blocks(vectors: DataFrame, carry: list[str], vector: str, scale: int, rows: int = BLOCK) -> DataFrame:
    """block, rows (array of the carried columns as structs), raw (int32 floor(scale * x), row by row), written once.

    The rows of a partition are packed as they come, so nothing is shuffled and a hot id or vector fills many blocks.
    All vectors need the same length.
    """
    own = vectors.select(F.struct(*carry).alias("row"), F.col(vector).cast("array<double>").alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                part, b = b.slice(0, rows - n), b.slice(rows - n)
                held.append(part)
                n += part.num_rows
                if n == rows:
                    yield out(held)
                    held, n = [], 0
        if n:
            yield out(held)

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        row = t["row"].chunk(0)
        flat = np.concatenate([np.asarray(c.flatten()) for c in t["e"].chunks])
        raw = np.floor(flat * scale).astype("<i4")
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row), pa.array([raw.tobytes()])], names=["rows", "raw"])

    kind = own.schema["row"].dataType.simpleString()
    return cut(own.mapInArrow(pack, f"rows array<{kind}>, raw binary").withColumn("block", F.monotonically_increasing_id()))


def unpack(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dim).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows, exactly: by a product of doubles where all sums stay below 2 ** 53."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    top = max(int(np.abs(x).max()), int(np.abs(c).max()))
    if 4 * top * top * x.shape[1] < 2**53:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)


def grouped_sums(x: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """(k, dim + 1): the sums of the rows of each group, and their number in the last place."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if len(of) else np.zeros(0, np.int64)
    rows = np.c_[x, np.ones(len(x), np.int64)]
    if len(first):
        out[of[order][first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def total(df: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of a binary column of size longs over all rows: added up in each task, then by place; size rows reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                acc += np.frombuffer(x.as_py(), "<i8")
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(acc[at])], names=["place", "value"])

    out = np.zeros(size, np.int64)
    for r in df.select(column).mapInArrow(add, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out


def means(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each group; a group without rows stays as before."""
    n = sums[:, -1:]
    return np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), before)
