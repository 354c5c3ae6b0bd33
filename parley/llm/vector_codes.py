"""Vector code compression: a codebook for each part of the vectors, learnt over metric trees built by anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import cut, join_hot, table
from parley.llm.vector_blocks import BLOCK, blocks, grouped_sums, means, squared, total, unpack, usable

#: Balls of at most so many points are leaves.
LEAF = 256
#: An entry is dropped from a ball's candidates only if it is farther by more than these shares of the squared distances
#: and of the distance between entries, which are above all rounding.
MARGIN, SHIFT = 1e-9, 1e-6


class Tree(NamedTuple):
    """Balls of one part of a block's vectors. A ball holds the points order[low:high]; its sums carry their number last.

    The root is the last ball; a leaf has no left ball (-1).
    """

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray


KINDS = {"order": "<i4", "centre": "<f8", "radius": "<f8", "sums": "<i8", "low": "<i4", "high": "<i4", "left": "<i4", "right": "<i4"}


def anchors(x: np.ndarray) -> list[np.ndarray]:
    """About sqrt(n) groups of the points, each nearest to its anchor.

    Each anchor keeps its points from the farthest to the nearest. A new anchor is the farthest point of the widest group; it
    looks at a group's points only while they are farther from their anchor than half the distance of the two anchors,
    for no nearer point can be closer to the new one.
    """
    first = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    by = np.argsort(-first, kind="stable")
    points, far, spots = [by], [first[by]], [x[0]]
    for _ in range(int(np.ceil(np.sqrt(len(x)))) - 1):
        wide = max(range(len(far)), key=lambda i: far[i][0])
        if far[wide][0] == 0:
            break
        spot = x[points[wide][0]]
        apart = np.sqrt(((np.array(spots) - spot) ** 2).sum(axis=1)) / 2
        new_points, new_far = [], []
        for i, half in enumerate(apart):
            n = int(np.searchsorted(-far[i], -half, side="right"))
            if not n:
                continue
            d = np.sqrt(((x[points[i][:n]] - spot) ** 2).sum(axis=1))
            gone = d < far[i][:n]
            if gone.any():
                new_points.append(points[i][:n][gone])
                new_far.append(d[gone])
                keep = np.r_[~gone, np.ones(len(points[i]) - n, bool)]
                points[i], far[i] = points[i][keep], far[i][keep]
        p, d = np.concatenate(new_points), np.concatenate(new_far)
        by = np.argsort(-d, kind="stable")
        points.append(p[by])
        far.append(d[by])
        spots.append(spot)
    return points


def build(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree from the middle out: anchors first, then upwards the two balls whose union is smallest, and downwards the same inside each anchor."""
    y = x.astype(float)
    balls: list[tuple] = []  # centre, radius, sums, points, left, right

    def ball(points: np.ndarray, left: int = -1, right: int = -1) -> int:
        own = y[points]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        balls.append((centre, radius, np.r_[x[points].sum(axis=0), len(points)], points, left, right))
        return len(balls) - 1

    def grow(points: np.ndarray) -> int:
        groups = [points[g] for g in anchors(y[points])] if len(points) > leaf else [points]
        if len(groups) == 1:
            return ball(points)
        live = [grow(g) for g in groups]
        n, top = len(live), live[0]
        # union[i, j]: the radius of the smallest ball around two live balls; two are joined until one is left
        union = np.full((n, n), np.inf)

        def around(i: int) -> np.ndarray:
            centre, radius = np.array([balls[j][0] for j in live]), np.array([balls[j][1] for j in live])
            return (np.sqrt(((centre - balls[i][0]) ** 2).sum(axis=1)) + radius + balls[i][1]) / 2

        for i in range(n):
            union[i] = around(live[i])
            union[i, i] = np.inf
        gone = np.zeros(n, bool)
        for _ in range(n - 1):
            i, j = np.unravel_index(int(union.argmin()), union.shape)
            a, b = live[i], live[j]
            live[i] = ball(np.concatenate([balls[a][3], balls[b][3]]), a, b)
            gone[j] = True
            union[i] = union[:, i] = np.where(gone, np.inf, around(live[i]))
            union[i, i], union[j], union[:, j] = np.inf, np.inf, np.inf
            top = live[i]
        return top

    root = grow(np.arange(len(x)))
    # points in the order of the leaves, so that every ball is a range of them
    low, high, order = np.zeros(len(balls), np.int32), np.zeros(len(balls), np.int32), []
    stack, n = [(root, False)], 0
    while stack:
        at, done = stack.pop()
        left, right = balls[at][4], balls[at][5]
        if left < 0:
            low[at], n = n, n + len(balls[at][3])
            high[at] = n
            order.append(balls[at][3])
        elif done:
            low[at], high[at] = low[left], high[right]
        else:
            stack += [(at, True), (right, False), (left, False)]
    column = lambda i, kind: np.array([b[i] for b in balls], kind)
    return Tree(np.concatenate(order).astype(np.int32), column(0, float), column(1, float), column(2, np.int64), low, high, column(4, np.int32), column(5, np.int32))


def candidates(centre: np.ndarray, radius: float, entries: np.ndarray, apart: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Those of the entries (few, ascending) that may be nearest to some point of a ball.

    One is dropped if the whole ball lies strictly on the other side of the plane halfway between it and the entry nearest to the centre.
    """
    d = ((entries[few] - centre) ** 2).sum(axis=1)
    best = int(d.argmin())
    beyond = d - d[best] - 2 * radius * apart[few[best], few]
    return few[beyond <= MARGIN * (d + d[best] + 1) + SHIFT * apart[few[best], few]]


def walk(x: np.ndarray, tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each point, the sums of each entry's points, and how many distances of points were looked at.

    A ball inherits the candidates of the one above and shrinks them; a ball with one left adds its cached sums whole. Only the points of
    leaves with several are compared, exactly, ties to the lower index.
    """
    k = len(entries)
    code, owned, looked = np.zeros(len(x), np.int64), np.zeros((k, x.shape[1] + 1), np.int64), 0
    real = entries.astype(float)
    apart = np.sqrt(squared(entries, entries).astype(float))
    scanned = []
    stack = [(len(tree.radius) - 1, np.arange(k))]
    while stack:
        at, few = stack.pop()
        few = candidates(tree.centre[at], tree.radius[at], real, apart, few)
        mine = tree.order[tree.low[at] : tree.high[at]]
        if len(few) == 1:
            code[mine] = few[0]
            owned[few[0]] += tree.sums[at]
        elif tree.left[at] < 0:
            code[mine] = few[squared(x[mine], entries[few]).argmin(axis=1)]
            looked += len(mine) * len(few)
            scanned.append(mine)
        else:
            stack += [(int(tree.left[at]), few), (int(tree.right[at]), few)]
    if scanned:
        them = np.concatenate(scanned)
        owned += grouped_sums(x[them], code[them], k)
    return code, owned, looked


def compress(vectors: DataFrame, carry: list[str], order: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """Codes of vectors: (the carried columns with code and error, the codebooks as parts x entries x components).

    Components become floor(scale * x) and vectors are cut into equal consecutive parts. A codebook starts as that part of the
    first vectors by order (ties by the vector, null last; fewer vectors give fewer entries) and goes through so many of Lloyd's
    rounds over all vectors, exactly; entries without parts stay. code holds the indexes in hex digits, two each up to 256 entries; error is the
    squared distance summed over parts.

    Null vectors and those with a component that is null, not finite or, scaled, of 2 ** 26 or more take no part, nor do vectors of
    another length than the commonest one that the parts divide (ties: the longest). Each block of vectors has one tree for each part,
    written with it once; a round reads the trees and brings parts * entries * (dim / parts + 1) numbers to the driver.
    """
    spark = vectors.sparkSession
    own = vectors.where(usable(F.col(vector), scale) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    kind = own.select(*carry).schema
    result = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    result += ", code string, error long"
    sizes = own.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], result), np.zeros((parts, 0, 0), np.int64)
    dim = sizes[0].dim
    own = own.where(F.size(vector) == dim)
    first = own.select(F.col(order).alias("o"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("q")).orderBy(F.asc_nulls_last("o"), "q").limit(entries)
    books = np.array([r.q for r in first.collect()], np.int64).reshape(-1, parts, dim // parts).transpose(1, 0, 2)
    k, wide = books.shape[1], dim // parts
    digits = max(2, len(f"{k - 1:x}"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column("raw")):
                x = unpack(raw.as_py(), dim)
                for p in range(parts):
                    part = np.ascontiguousarray(x[:, p * wide : (p + 1) * wide])
                    tree = build(part)
                    held = [pa.array([getattr(tree, n).astype(t).tobytes()]) for n, t in KINDS.items()]
                    yield pa.RecordBatch.from_arrays([b.column("block").slice(i, 1), pa.array([p], pa.int32()), pa.array([part.astype("<i4").tobytes()]), *held], names=["block", "part", "raw", *KINDS])

    def read(row: dict) -> tuple[np.ndarray, Tree]:
        tree = Tree(*(np.frombuffer(row[n], t) for n, t in KINDS.items()))
        return unpack(row["raw"], wide), tree._replace(centre=tree.centre.reshape(-1, wide), sums=tree.sums.reshape(-1, wide + 1))

    def gather(now: np.ndarray):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((parts, k, wide + 1), np.int64)
            for b in batches:
                for row in b.to_pylist():
                    acc[row["part"]] += walk(*read(row), now[row["part"]])[1]
            yield pa.RecordBatch.from_arrays([pa.array([acc.astype("<i8").tobytes()])], names=["sums"])

        return sums

    def encode(now: np.ndarray):
        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    p = row["part"]
                    x, tree = read(row)
                    code = walk(x, tree, now[p])[0]
                    error = ((x - now[p][code]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([p], pa.int32()), pa.array([code.astype("<i4").tobytes()]), pa.array([error.astype("<i8").tobytes()])], names=["block", "part", "code", "error"])

        return codes

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, held in enumerate(b.column("parts")):
                held = sorted(held.as_py(), key=lambda h: h["part"])
                code = np.array([np.frombuffer(h["code"], "<i4") for h in held])
                error = sum(np.frombuffer(h["error"], "<i8") for h in held)
                hexed = ["".join(f"{c:0{digits}x}" for c in one) for one in code.T.tolist()]
                kept = b.column("rows")[i].values
                yield pa.RecordBatch.from_arrays([*kept.flatten(), pa.array(hexed, pa.string()), pa.array(error)], names=[*kind.names, "code", "error"])

    packed = blocks(own, carry, vector, scale, block)
    fields = ", ".join(f"{n} binary" for n in KINDS)
    trees = cut(packed.select("block", "raw").mapInArrow(plant, f"block long, part int, raw binary, {fields}"))
    for _ in range(rounds):
        sums = total(trees.mapInArrow(gather(books), "sums binary"), "sums", books.shape[0] * k * (wide + 1))
        sums = sums.reshape(parts, k, wide + 1)
        books = np.stack([means(sums[p], books[p]) for p in range(parts)])
    coded = trees.mapInArrow(encode(books), "block long, part int, code binary, error binary")
    # a block has one row for each part
    joined = coded.groupBy("block").agg(F.collect_list(F.struct("part", "code", "error")).alias("parts")).join(packed.select("block", "rows"), "block")
    return cut(joined.mapInArrow(spread, result)), books


def with_totals(df: DataFrame, key: str, value: str, name: str, share: int = 1000) -> DataFrame:
    """df with the sum of value over the rows that share key (nulls together), as a long."""
    sums = df.groupBy(key).agg(F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long").alias(name), F.count("*").alias("_n"))
    return join_hot(df, cut(sums), [key], "_n", share).drop("_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: embeddings as four codes of 256 entries each."""
    out, books = compress(table(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return with_totals(out, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = 4, dim: int = 64, parts: int = 4, entries: int = 256) -> str:
    wide = dim // parts
    out = [
        f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dim}
), part AS MATERIALIZED (
  SELECT r, p, v[p * {wide} + 1 : p * {wide} + {wide}] AS v FROM kept, range({parts}) t(p)
), e0 AS MATERIALIZED (
  SELECT p, n AS e, part.v FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS n FROM kept) USING (r) WHERE n < {entries}
)"""
    ]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (
  SELECT r, p, v, min(s).e AS e, min(s).d AS d FROM (
    SELECT x.r, x.p, x.v, {{'d': CAST(list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) FOR i IN range(1, {wide + 1})]) AS BIGINT), 'e': c.e}} AS s
    FROM part x JOIN e{i} c ON c.p = x.p
  ) GROUP BY r, p, v
)""")
        if i < rounds:
            out.append(f"""e{i + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM e{i} c LEFT JOIN (
    SELECT p, e, list(x ORDER BY i) AS v FROM (
      SELECT p, e, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM a{i}, range(1, {wide + 1}) t(i) GROUP BY p, e, i
    ) GROUP BY p, e
  ) m ON m.p = c.p AND m.e = c.e
)""")
    return (
        ", ".join(out)
        + f"""
, coded AS (
  SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM e{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""
    )


SQL = _sql()
