"""SimHash near-duplicates by vantage-point trees over the fingerprints, and near-duplicates by exact shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bucket_links
from parley.llm.bucket_links import merge as _merge
from parley.llm.common import connected_components, cut, table
from parley.llm.line_dedup import binary, bucket_hashes, signatures
from parley.llm.textblocks import LOWER, SPACE, chunks, mix, names, word_grams, words

#: Distinct fingerprints, at most, that reach the driver to fit the trees.
TREE_SAMPLE = 20_000
#: Distinct fingerprints that a shard is meant to hold.
SHARD = 16_384
#: Deepest tree that is broadcast: 2 ** MAX_DEPTH shards at most; a shard goes on with a tree of its own.
MAX_DEPTH = 12
LEAF = 64


def _majority(h: np.ndarray) -> bytes:
    """8 bytes of the bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        votes += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(h)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, fp): fp is a binary of 8 * lanes bytes, 64 bits a lane.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; shingles of so many words,
    repeats included (fewer words: the whole sequence; none: zero). Lane 0 votes with the bits of XXH64 with
    seed 42, further lanes with a fixed mixture of it. A bit is 1 if set in over half the shingles.
    Null texts count as empty; rows of null doc_id are left out.
    """

    def tell(batches):
        digest = xxhash.xxh64_intdigest
        salts = [np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(lanes)]
        for batch in batches:
            out = []
            for value in batch.column("text"):
                ws = (value.as_py() or "").encode().lower().split()
                if not ws:
                    out.append(bytes(8 * lanes))
                    continue
                n = max(1, len(ws) - shingle + 1)
                joined, k = b" ".join(ws), min(shingle, len(ws))
                ends = np.cumsum([len(w) + 1 for w in ws])
                starts = (ends - [len(w) + 1 for w in ws])[:n].tolist()
                stops = (ends[k - 1 :] - 1).tolist()
                h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
                fp = b""
                for i in range(lanes):
                    fp += _majority(mix(h + salts[i]) if i else h)
                out.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(tell, "doc_id long, fp binary")


def _block(lanes: np.ndarray, block: tuple[int, int, int]) -> np.ndarray:
    lane, shift, width = block
    return ((lanes[:, lane] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.uint64)


def _vantage(values: np.ndarray, radius: int, rng) -> tuple[int, int] | None:
    """The vantage point and bound, of a few tried, that leave the fewest values in both halves."""
    best = None
    for v in rng.choice(values, min(8, len(values)), replace=False):
        d = np.bitwise_count(values ^ v)
        bound = int(np.median(d))
        for mu in (bound - 1, bound):
            inner = int((d <= mu).sum())
            both = int(((d > mu - radius) & (d <= mu + radius)).sum())
            if 0 < inner < len(values):
                cost = (max(inner, len(values) - inner) + both) / len(values)
                if best is None or cost < best[0]:
                    best = (cost, int(v), mu)
    return best and best[1:]


def fit_tree(values: np.ndarray, depth: int, radius: int, seed: int) -> dict | None:
    """Nested nodes {point, bound, inner, outer}; None is a shard."""
    rng = np.random.default_rng(seed)

    def node(values, depth):
        split = depth and len(values) >= 16 and _vantage(values, radius, rng)
        if not split:
            return None
        near = np.bitwise_count(values ^ np.uint64(split[0])) <= split[1]
        return {"point": split[0], "bound": split[1], "inner": node(values[near], depth - 1), "outer": node(values[~near], depth - 1)}

    return node(values, depth)


def route(tree: dict | None, values: np.ndarray, radius: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows, home): every shard that a ball of the radius around a value may reach; home is the value's own."""
    out = []

    def go(node, name, rows, home):
        if node is None:
            out.append((name, rows, home))
            return
        d = np.bitwise_count(values[rows] ^ np.uint64(node["point"])).astype(np.int16)
        # by the triangle inequality a partner's distance differs by the radius at most
        inner, outer = d <= node["bound"] + radius, d > node["bound"] - radius
        go(node["inner"], 2 * name, rows[inner], home[inner] & (d[inner] <= node["bound"]))
        go(node["outer"], 2 * name + 1, rows[outer], home[outer] & (d[outer] > node["bound"]))

    go(tree, 1, np.arange(len(values)), np.ones(len(values), bool))
    return out


def _shard_links(lanes: np.ndarray, home: np.ndarray, block: tuple, block_radius: int, radius: int) -> np.ndarray:
    """Group of each row among those that links join: the tree goes on inside the shard, and leaves are compared whole."""
    values, label = _block(lanes, block), np.arange(len(lanes))
    rng = np.random.default_rng(len(lanes))

    def go(homes, asks, tries):
        if not len(homes) or not len(asks):
            return
        split = len(homes) > LEAF and tries and _vantage(values[rng.choice(homes, min(256, len(homes)), replace=False)], block_radius, rng)
        if split:
            point, bound = np.uint64(split[0]), split[1]
            dh, da = np.bitwise_count(values[homes] ^ point).astype(np.int16), np.bitwise_count(values[asks] ^ point).astype(np.int16)
            near = dh <= bound
            if 0 < near.sum() < len(near):
                go(homes[near], asks[da <= bound + block_radius], tries - 1)
                go(homes[~near], asks[da > bound - block_radius], tries - 1)
                return
        for at in range(0, len(homes), LEAF):
            part = homes[at : at + LEAF]
            for to in range(0, len(asks), 65_536):
                ask = asks[to : to + 65_536]
                i, j = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[ask][None]) <= block_radius)
                if len(i):
                    apart = sum(np.bitwise_count(lanes[part[i], k] ^ lanes[ask[j], k]).astype(np.int16) for k in range(lanes.shape[1]))
                    hit = (apart <= radius) & (part[i] != ask[j])
                    _merge(label, part[i][hit], ask[j][hit])

    go(np.flatnonzero(home), np.arange(len(lanes)), 40)
    return label


def links(fps: DataFrame, radius: int = 3, blocks: tuple = ((0, 0, 32), (0, 32, 32)), block_radius: int = 1) -> DataFrame:
    """(a, b): links of distinct fingerprints (fp binary) at radius bits or fewer, as a spanning forest per shard.

    Each block (lane, shift, width) of bits has a vantage-point tree of its own under the Hamming distance of
    that block. With m blocks that cover all bits and block_radius >= radius // m, two fingerprints
    within the radius are within block_radius in some block, so no link is lost. Trees are fitted
    on a bounded sample on the driver; a fingerprint goes to its shard, and to each shard that the ball
    around it may reach. A shard joins its groups at once: a dense group gives one link per member, not all pairs.
    """
    total = fps.count()
    few = fps.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).select("fp").collect()
    if total < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    wide = len(few[0].fp) // 8
    sample = np.frombuffer(b"".join(r.fp for r in few), "<u8").reshape(-1, wide)
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(total / SHARD))))
    trees = [fit_tree(_block(sample, b), depth, block_radius, i) for i, b in enumerate(blocks)]

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lanes = np.frombuffer(b"".join(batch.column("fp").to_pylist()), "<u8").reshape(-1, wide)
            for i, b in enumerate(blocks):
                for name, rows, home in route(trees[i], _block(lanes, b), block_radius):
                    if len(rows):
                        shard = np.full(len(rows), i << 32 | name, np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("fp").take(pa.array(rows)), pa.array(home)], names=["shard", "fp", "home"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        lanes = np.frombuffer(b"".join(rows["fp"]), "<u8").reshape(-1, wide)
        label = _shard_links(lanes, rows["home"].to_numpy(), blocks[int(rows["shard"].iloc[0]) >> 32], block_radius, radius)
        moved = np.flatnonzero(label != np.arange(len(label)))
        fp = rows["fp"].to_numpy()
        return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})

    return fps.mapInArrow(deal, "shard long, fp binary, home boolean").groupBy("shard").applyInPandas(join, "a binary, b binary")


def near_duplicates(docs: DataFrame, shingle: int = 3, lanes: int = 1, **tree) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: the smallest doc_id that links of fingerprints reach.

    docs: doc_id, text; other columns are ignored. Documents without words have fingerprint zero and link like
    others; equal fingerprints link whatever their number, through one row per distinct
    fingerprint. Repeated rows each get their row; rows of null doc_id are left out.
    """
    own = cut(fingerprints(docs, shingle, lanes))
    first = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = connected_components(links(first.select("fp"), **tree)).withColumnRenamed("node", "fp")
    named = first.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    # one row per distinct fingerprint; a frequent one is split by the adaptive join
    return own.join(named.join(heads, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Near-duplicates: sets of 5-word shingles at a Jaccard similarity of 0.8, told exactly. Candidates have SimHash fingerprints of these sets
#: that links of 3 bits or fewer join, by the trees above, or, as fingerprints of pairs at 0.8 are farther apart, share one of 20
#: bands of 4 MinHash values: a pair at 0.8 is missed with (1 - 0.8 ** 4) ** 20 = 0.003 %.
STAGE = {"shingle": 5, "similarity": 0.8, "bands": 20, "rows": 4}


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted set of k-word shingles of each text, one after the other; words as in fingerprints().

    A text of fewer words is one shingle, one without words has none.
    """
    low = LOWER[data]
    start, stop, first = words(low, offsets, ~SPACE)
    h, cuts = word_grams(names(low, start, stop), first, k)
    sets = [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int64)


def _set_keys(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set."""
    sums = [np.r_[np.uint64(0), np.cumsum(mix(sets ^ salt))] for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))]
    return mix(np.stack([x[ends[1:]] - x[ends[:-1]] for x in sums], axis=1))


def _set_rows(shingle: int, bands: int, rows_: int):
    """(doc_id, short, key, fp, buckets) of each document; fp is the SimHash of its set."""

    def run(batches):
        with np.errstate(over="ignore"):
            for rows, data, offsets in chunks(batches):
                sets, ends = _shingle_sets(data, offsets, shingle)
                key, n = _set_keys(sets, ends), rows.num_rows
                bucket = bucket_hashes(signatures(sets, np.repeat(np.arange(n), np.diff(ends)), n, bands * rows_), bands, rows_)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), pa.array(bucket.reshape(-1).view(np.int64)))
                mixed = mix(sets)
                fp = pa.array([_majority(mixed[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(key[:, 0].view(np.int64)), binary(key), fp, lists], names=["doc_id", "short", "key", "fp", "buckets"])

    return run


def _set_texts(shingle: int):
    """(short, key, text): text is the set of shingles."""

    def run(batches):
        with np.errstate(over="ignore"):
            for _, data, offsets in chunks(batches):
                sets, ends = _shingle_sets(data, offsets, shingle)
                key = _set_keys(sets, ends)
                text = [sets[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[:, 0].view(np.int64)), binary(key), pa.array(text, pa.binary())], names=["short", "key", "text"])

    return run


def _similar_sets(least: float):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                both = int((both[1:] == both[:-1]).sum())
                ok.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("a", "b", "ka", "kb")] + [pa.array(ok, pa.bool_())], names=["a", "b", "ka", "kb", "ok"])

    return run


def _set_tokens(batches):
    for batch in batches:
        sets = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("text")]
        size = np.array([len(x) for x in sets], np.int64)
        at = pa.array(np.repeat(np.arange(len(sets)), size))
        cols = [batch.column("short").take(at), batch.column("key").take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])), pa.array(np.repeat(size, size))]
        yield pa.RecordBatch.from_arrays(cols, names=["short", "key", "token", "size"])


def similar_documents(docs: DataFrame, shingle: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that links of documents at the similarity or more reach.

    Sets of shingles are of whole texts and compared exactly; equal sets, and those of texts without words, link
    whatever their number, through one row per distinct set. Rows of null doc_id are left out.
    """
    own = docs.select("doc_id", "text").where("doc_id is not null")
    sets = cut(own.mapInArrow(_set_rows(shingle, bands, rows), "doc_id long, short long, key binary, fp binary, buckets array<long>"))
    first = cut(sets.groupBy("key").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("short", "fp", "buckets"))))
    # sets whose fingerprints the trees join meet in a bucket of their own
    joined = connected_components(links(cut(first.select("fp").distinct()))).withColumnRenamed("node", "fp").withColumnRenamed("component", "_f")
    buckets = F.concat("buckets", F.array(F.xxhash64(F.lit("fingerprint"), F.coalesce("_f", "fp"))))
    member = bucket_links.members(first.join(joined, "fp", "left").select("short", buckets.alias("buckets")))
    asked = first.join(member.select("short").distinct(), "short", "left_semi").select(F.col("first").alias("doc_id")).distinct()
    # a doc_id with several texts brings all their sets; one row a set stays
    text = cut(own.join(asked, "doc_id", "left_semi").select("text").mapInArrow(_set_texts(shingle), "short long, key binary, text binary").dropDuplicates(["key"]))
    found = bucket_links.links(member, text, _similar_sets(similarity), _set_tokens, similarity)
    groups = connected_components(found).withColumnRenamed("node", "key")
    named = first.join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))
    heads = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return sets.select("doc_id", "key").join(named.join(heads, "component").select("key", "component_id"), "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each group the document of the smallest doc_id stays (STAGE's parameters).

    Rows of null doc_id stay; repeated rows of a kept doc_id all stay.
    """
    gone = similar_documents(docs, **STAGE).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: 64-bit fingerprints of 3-word shingles, linked at 3 bits or fewer."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    # a lane is stored from its lowest byte
    digits = F.concat(*(F.substring(F.hex("fp"), i, 2) for i in range(15, 0, -2)))
    return out.select("doc_id", F.lower(digits).alias("fingerprint"), "component_id")
