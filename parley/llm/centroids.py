"""Centroid clustering with heap-ordered bounds."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import cut, table
from parley.llm.vector_blocks import BLOCK, blocks, grouped_sums, means, squared, total, unpack, usable

#: Gaps within this of their offset are rescanned: more than all rounding of square roots and of their sums.
SLACK = 1e-3
STATE = "block long, keys binary, at binary, sizes array<long>, delta binary, scanned long"


class Heaps:
    """The vectors of a block: one heap of (gap, place) for each cluster.

    A gap is the distance to the second nearest centroid less that to the own one, plus the offset of the cluster when it
    was pushed. The offset grows by what the own centroid has moved and the farthest that any other has, so a vector whose gap is
    above it still has its nearest centroid; only the others are popped.
    """

    def __init__(self, k: int, keys: bytes = b"", at: bytes = b"", sizes: list[int] | None = None):
        ends = np.cumsum([0, *(sizes or [0] * k)])
        both = list(zip(np.frombuffer(keys, "<f8").tolist(), np.frombuffer(at, "<i4").tolist(), strict=True))
        self.heaps = [both[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def pop(self, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose gap has run out, and the cluster that each was in."""
        out, of = [], []
        for c, heap in enumerate(self.heaps):
            n = len(out)
            while heap and heap[0][0] <= offset[c] + SLACK:
                out.append(heapq.heappop(heap)[1])
            of += [c] * (len(out) - n)
        return np.array(out, np.int64), np.array(of, np.int64)

    def push(self, places: np.ndarray, of: np.ndarray, gaps: np.ndarray, offset: np.ndarray) -> None:
        for p, c, g in zip(places.tolist(), of.tolist(), (gaps + offset[of]).tolist(), strict=True):
            heapq.heappush(self.heaps[c], (g, p))

    def clusters(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for c, heap in enumerate(self.heaps):
            out[[p for _, p in heap]] = c
        return out

    def state(self) -> tuple[bytes, bytes, list[int]]:
        """As they stand, so that each slice is a heap again."""
        both = [x for heap in self.heaps for x in heap]
        return np.array([g for g, _ in both], "<f8").tobytes(), np.array([p for _, p in both], "<i4").tobytes(), [len(h) for h in self.heaps]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: the first), and by how much the second is farther away."""
    d = squared(x, centroids)
    own = d.argmin(axis=1)
    if len(centroids) == 1:
        return own, np.full(len(x), np.inf)
    row = np.arange(len(x))
    least = d[row, own]
    d[row, own] = np.iinfo(np.int64).max
    return own, np.sqrt(d.min(axis=1)) - np.sqrt(least)


def step(x: np.ndarray, heaps: Heaps, centroids: np.ndarray, offset: np.ndarray, fresh: bool) -> tuple[np.ndarray, int]:
    """Rescans what has expired (all, if fresh); how the sums of the clusters change, and how many were rescanned."""
    k = len(centroids)
    out, before = (np.arange(len(x)), None) if fresh else heaps.pop(offset)
    own, gap = nearest(x[out], centroids)
    heaps.push(out, own, gap, offset)
    if fresh:
        return grouped_sums(x, own, k), len(out)
    moved = own != before
    return grouped_sums(x[out[moved]], own[moved], k) - grouped_sums(x[out[moved]], before[moved], k), len(out)


def cluster(vectors: DataFrame, carry: list[str], order: Column, vector: str = "embedding", k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, block: int = BLOCK) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Lloyd's rounds over floor(scale * x), exactly; the carried columns with cluster and distance (squared), the centroids, and the rescans of each pass.

    Vectors of another length than dim, null ones, and those with a component that is null, not finite or, scaled, of 2 ** 26 or
    more, take no part. The first k by order (ties by the vector) are the first centroids; fewer vectors give fewer centroids.
    Ties in distance go to the smaller number; a centroid without vectors stays.

    Blocks of vectors keep their heaps from round to round. The packed vectors are dealt by block once and kept on the executors' disks;
    a round joins the heaps to them (12 bytes a vector travel, not the vectors), pops what has expired and passes on by how much
    the sums of the clusters change: k * (dim + 1) numbers. A lost executor's blocks are read again from the written table.
    """
    own = vectors.where((F.size(vector) == dim) & usable(F.col(vector), scale))
    first = own.select(order.alias("o"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("q")).orderBy(F.asc_nulls_last("o"), "q").limit(k)
    centroids = np.array([r.q for r in first.collect()], np.int64).reshape(-1, dim)
    k = len(centroids)
    kind = own.select(*carry).schema
    result = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    if not k:
        return own.sparkSession.createDataFrame([], f"{result}, cluster int, distance long"), centroids, []
    packed = blocks(own, carry, vector, scale, block)
    parts = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-packed.count() // 64))
    data = packed.repartition(parts, "block").persist()

    def run(now: np.ndarray, offset: np.ndarray, fresh: bool):
        def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.select([n for n in b.schema.names if n != "rows"]).to_pylist():
                    x = unpack(row["raw"], dim)
                    heaps = Heaps(k) if fresh else Heaps(k, row["keys"], row["at"], row["sizes"])
                    delta, scanned = step(x, heaps, now, offset, fresh)
                    keys, at, sizes = heaps.state()
                    yield pa.RecordBatch.from_pylist([{"block": row["block"], "keys": keys, "at": at, "sizes": sizes, "delta": delta.astype("<i8").tobytes(), "scanned": scanned}])

        return states

    def last(now: np.ndarray, offset: np.ndarray, fresh: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.schema.names
                for i, row in enumerate(b.select([n for n in names if n != "rows"]).to_pylist()):
                    x = unpack(row["raw"], dim)
                    heaps = Heaps(k) if fresh else Heaps(k, row["keys"], row["at"], row["sizes"])
                    step(x, heaps, now, offset, fresh)
                    of = heaps.clusters(len(x))
                    kept = b.column("rows")[i].values
                    far = ((x - now[of]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([*kept.flatten(), pa.array(of.astype(np.int32)), pa.array(far)], names=[*kind.names, "cluster", "distance"])

        return rows

    offset, sums, state, scans = np.zeros(k), np.zeros((k, dim + 1), np.int64), None, []
    for _ in range(rounds):
        joined = data if state is None else data.join(state.drop("delta", "scanned"), "block")
        state = cut(joined.mapInArrow(run(centroids, offset, state is None), STATE))
        sums = sums + total(state, "delta", sums.size).reshape(sums.shape)
        scans.append(state.agg(F.sum("scanned")).first()[0])
        moved = means(sums, centroids)
        drift = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(float))
        others = np.array([np.delete(drift, c).max(initial=0.0) for c in range(k)])
        offset, centroids = offset + drift + others, moved
    joined = data if state is None else data.join(state.drop("delta", "scanned"), "block")
    out = cut(joined.mapInArrow(last(centroids, offset, state is None), f"{result}, cluster int, distance long"))
    data.unpersist()
    return out, centroids, scans


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: embeddings in 16 clusters after three rounds, the first centroids by the hash of 1:vec_id."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    out, centroids, _ = cluster(table(spark, sf_dir, "embeddings"), ["vec_id"], order)
    # one row a cluster
    sums = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = 2**63 - 1
    per = F.array(*(F.lit(min(int(sums.get(c, 0)), most)).cast("long") for c in range(max(1, len(centroids)))))
    digest = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids), *([] if len(centroids) else [F.lit("")]))
    inertia = F.lit(min(int(sum(sums.values())), most)).cast("long")
    place = F.col("cluster") + 1
    return out.select("vec_id", "cluster", "distance", F.element_at(per, place).alias("cluster_inertia"), inertia.alias("inertia"), F.element_at(digest, place).alias("centroid_sha256"))


def _sql(rounds: int = 3, k: int = 16) -> str:
    parts = [
        """WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept)
  ORDER BY c LIMIT {k}
)""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, min(s).c AS c, min(s).d AS d FROM (
    SELECT k.r, k.vec_id, k.v, {{'d': CAST(list_sum([(k.v[i] - c.v[i]) * (k.v[i] - c.v[i]) FOR i IN range(1, 65)]) AS BIGINT), 'c': c.c}} AS s
    FROM kept k CROSS JOIN c{i} c
  ) GROUP BY r, vec_id, v
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list(x ORDER BY i) AS v FROM (
      SELECT c, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{i}, range(1, 65) t(i) GROUP BY c, i
    ) GROUP BY c
  ) m USING (c)
)""")
    return (
        ", ".join(parts)
        + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c"""
    )


SQL = _sql()
