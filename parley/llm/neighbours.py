"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import cut, table

#: Pivots are drawn from at most this many rows.
PIVOT_SAMPLE = 2048
PIVOTS = 512
#: Places of a vector's permutation that are posted: it stands in the inverted files of so many pivots.
PREFIX = 32
#: Rows of a block of the index, and of queries.
BLOCK = 8192
QUERY_BLOCK = 1024
#: Blocks of the index, and of queries, that meet in one task at most: 32 MB of each, for vectors of 64 components.
TILE, QUERY_TILE = 8, 64
#: Share of a block that is ranked best by footrule distance and then reranked.
RERANK = 0.2


def usable(embedding: Column) -> Column:
    """No null, no empty or zero vector, and all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0)


def _unit(raw: np.ndarray, dim: int) -> np.ndarray:
    v = np.frombuffer(raw, dtype="<f8").reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _ranks(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Place of each pivot in the order of nearness, prefix for all beyond it."""
    order = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")
    ranks = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(ranks, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.int16), order.shape), axis=1)
    return np.minimum(ranks, prefix)


def _files(ranks: np.ndarray, prefix: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The inverted file of each pivot: the rows that have it among their prefix nearest, and its places there."""
    row, pivot = np.nonzero(ranks < prefix)
    order = np.argsort(pivot, kind="stable")
    ends = np.cumsum(np.bincount(pivot, minlength=ranks.shape[1]))[:-1]
    return list(zip(np.split(row[order], ends), np.split(ranks[row, pivot][order], ends), strict=True))


def _nearness(asked: list, posted: list, n_asked: int, n_posted: int, prefix: int) -> np.ndarray:
    """Footrule nearness of asked and posted rows from their inverted files: 2 * this = a constant - the distance."""
    near = np.zeros((n_asked, n_posted), dtype=np.int16)
    for (a, ra), (x, rx) in zip(asked, posted, strict=True):
        if len(a) and len(x):
            near[np.ix_(a, x)] += prefix - np.maximum.outer(ra, rx)
    return near


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaling by powers of two changes no digit and keeps squares finite."""
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (a, b))
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


def _first(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, nearest first, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
    top = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)])) < k
    return query[top], vec[top], score[top]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, rerank: float = RERANK, pivots: int = PIVOTS, prefix: int = PREFIX, seed: int = 7) -> DataFrame:
    """The k nearest found of every query: (query_id, rank, vec_id, score).

    vectors, queries: vec_id, embedding of the same length; other columns are ignored. Every vector is
    indexed: its pivots in order of nearness (prefix of them) are posted in the inverted files of
    its block. A query meets every block, the stated queries against all rows: tiles of a few blocks of either side meet in a task, so
    that what a task and a batch hold stays the same as the tables grow. The files of a query's own pivots give the footrule
    distance of its permutation to a block's rows, and only the best share rerank of them is compared as vectors, by
    exact cosine. Pivots are a seeded sample of at most
    PIVOT_SAMPLE rows. Nearest first, ties to the smaller vec_id; a row of the query's own
    vec_id is no candidate, repeated rows count once. Null ids, and vectors null, empty, zero or
    not finite, take no part; vectors of another length than most of the sample neither.
    """
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    asked = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    sample = [r.e for r in own.orderBy(F.xxhash64("e", "vec_id")).limit(PIVOT_SAMPLE).select("e").collect()]
    schema = "query_id long, vec_id long, score double"
    if not sample:
        return own.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(x) for x in sample]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
    points = np.array([x for x in sample if len(x) == dim])
    points = _unit(points.astype("<f8").tobytes(), dim)
    points = points[np.random.default_rng(seed).permutation(len(points))[:pivots]]
    prefix = min(prefix, len(points))

    def pack(rows: pa.Table) -> pa.Table:
        flat = np.asarray(rows["e"].combine_chunks().flatten(), dtype="<f8")
        return pa.table({"block": rows["block"].slice(0, 1), "ids": [np.asarray(rows["vec_id"], dtype="<i8").tobytes()], "raw": [flat.tobytes()]})

    def blocks(df: DataFrame, rows: int, total: int) -> tuple[DataFrame, int]:
        """(block, ids, raw): about so many rows each, dealt by a hash of the id, so that no block grows with the data."""
        n = max(1, -(-total // rows))
        dealt = df.where(F.size("e") == dim).distinct().withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
        return dealt.groupBy("block").applyInArrow(pack, "block long, ids binary, raw binary"), n

    def found_in(q_ids: np.ndarray, q_raw: bytes, x_ids: np.ndarray, x_raw: bytes, posted: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query_id, vec_id, score): the k nearest found in a block of the index, of some queries at a time."""
        q, x = np.frombuffer(q_raw, "<f8").reshape(-1, dim), np.frombuffer(x_raw, "<f8").reshape(-1, dim)
        uq, ux = _unit(q_raw, dim), _unit(x_raw, dim)
        keep = min(len(x), max(2 * k + 1, int(np.ceil(rerank * len(x)))))
        for at in range(0, len(q), 256):
            part = uq[at : at + 256]
            near = _nearness(_files(_ranks(part, points, prefix), prefix), posted, len(part), len(x), prefix)
            out_q, out_x = [], []
            for i, own in enumerate(near):
                # the rows that share the nearest pivots: these alone are compared as vectors
                few = np.argpartition(own, len(x) - keep)[len(x) - keep :]
                few = few[x_ids[few] != q_ids[at + i]]
                dots = ux[few] @ part[i]
                # all that may be among the k best, rounding and ties included
                best = min(k, len(few))
                hit = few[dots >= np.partition(dots, len(few) - best)[len(few) - best] - 1e-9] if best else few
                out_q.append(np.full(len(hit), at + i))
                out_x.append(hit)
            i, j = np.concatenate(out_q), np.concatenate(out_x)
            yield _first(q_ids[i], x_ids[j], _cosine(q[i], x[j]) if len(i) else np.zeros(0), k)

    def compare(ask: pa.Table, index: pa.Table) -> pa.Table:
        """One tile of queries against one of the index, block by block."""
        best = {}
        for xi, xr in zip(index["ids"], index["raw"], strict=True):
            x_ids, x_raw = np.frombuffer(xi.as_py(), "<i8"), xr.as_py()
            posted = _files(_ranks(_unit(x_raw, dim), points, prefix), prefix)
            for n, (qi, qr) in enumerate(zip(ask["ids"], ask["raw"], strict=True)):
                parts = [best[n]] if n in best else []
                parts += found_in(np.frombuffer(qi.as_py(), "<i8"), qr.as_py(), x_ids, x_raw, posted)
                best[n] = _first(*(np.concatenate(c) for c in zip(*parts, strict=True)), k)
        columns = [np.concatenate(c) for c in zip(*best.values(), strict=True)] if best else [np.zeros(0, "<i8"), np.zeros(0, "<i8"), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    def tiled(df: DataFrame, name: str, per: int) -> tuple[DataFrame, int]:
        """Blocks with the number of their tile, and the number of tiles."""
        df = cut(df)
        n = (df.agg(F.max("block")).first()[0] or 0) // per + 1
        return df.withColumn(name, F.pmod("block", F.lit(n))), n

    # the stated query set against all rows: every tile of queries is sent to every tile of the index, and the other way round
    index, n = blocks(own, BLOCK, own.count())
    ask, _ = blocks(asked, QUERY_BLOCK, asked.count())
    # few blocks are still dealt to all cores
    index, x_tiles = tiled(index, "x_tile", max(1, min(TILE, n // (4 * own.sparkSession.sparkContext.defaultParallelism))))
    ask, q_tiles = tiled(ask, "q_tile", QUERY_TILE)
    every = lambda name, many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias(name)
    sent = ask.select("ids", "raw", "q_tile", every("x_tile", x_tiles)).groupBy("q_tile", "x_tile")
    found = sent.cogroup(index.select("ids", "raw", every("q_tile", q_tiles), "x_tile").groupBy("q_tile", "x_tile")).applyInArrow(compare, schema)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the rows whose vec_id is divisible by 50 against every row of embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))
