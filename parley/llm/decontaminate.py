"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import cut, table, union_all
from parley.llm.textblocks import ALNUM, LOWER, chunks, names, ranges, word_grams, words

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of 64 bits at similarity 0.8 differ in 9.7 bits on average (standard deviation 2.9).
RADIUS = 20
#: Blocks of 8 bits; within 20 bits, some block differs in 20 // 8 = 2 at most.
BLOCKS = 8
#: Benchmark items, and bytes of their texts, that one pass over the documents holds on the driver and in each task.
ITEMS, ITEM_BYTES = 4_000, 4_000_000


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)


class Items:
    """The benchmark items of one pass: shingles, fingerprints, and their multi-index blocks."""

    def __init__(self, rows: list[tuple[int, bytes]], k: int, radius: int):
        data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
        offsets = np.r_[0, np.cumsum([len(t) for _, t in rows])]
        start, stop, first = words(data, offsets, ALNUM)
        gram, at = word_grams(names(LOWER[data], start, stop), first, k)
        keep = [i for i in range(len(rows)) if at[i + 1] > at[i]]
        self.ids = np.array([rows[i][0] for i in keep], np.int64)
        self.grams = [gram[at[i] : at[i + 1]] for i in keep]
        self.counts = [Counter(g.tolist()) for g in self.grams]
        self.size = np.array([len(g) for g in self.grams], np.int64)
        prints = [np.packbits(2 * _bits(g).sum(axis=0, dtype=np.int64) > len(g)) for g in self.grams]
        self.prints = np.array(prints, np.uint8).reshape(-1, 8)
        # shingle -> the window sizes whose items have it
        pairs = sorted({(g, int(n)) for gs, n in zip(self.grams, self.size, strict=True) for g in gs.tolist()})
        hashes = np.array([p[0] for p in pairs], np.uint64)
        self.known, begin = np.unique(hashes, return_index=True)
        self.begin, self.sizes = np.r_[begin, len(pairs)], np.array([p[1] for p in pairs], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known >> np.uint64(44)).astype(np.int64)] = True
        # block b, value v: the items whose block differs from v in radius // BLOCKS bits at most
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None, None] ^ self.prints[None]) <= radius // BLOCKS
        self.near = near.transpose(2, 0, 1)

    def candidates(self, prints: np.ndarray, size: int, radius: int):
        """(window, item, distance) within the radius, of items with that many shingles."""
        own = np.flatnonzero(self.size == size)
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            met = np.zeros((len(part), len(own)), bool)
            for b in range(BLOCKS):
                met |= self.near[b][part[:, b]][:, own]
            w, i = np.nonzero(met)
            apart = np.bitwise_count(part[w] ^ self.prints[own[i]]).sum(axis=1, dtype=np.int64)
            hit = apart <= radius
            yield w[hit] + at, own[i[hit]], apart[hit]


def _weighted(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return both / (a.total() + b.total() - both)


#: The items of the pass that a Python worker is at, made once a worker.
_HELD: dict = {}


def _held(group: list[tuple[int, bytes]], k: int, radius: int) -> Items:
    name = xxhash.xxh3_128_digest(repr((group, k, radius)))
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Items(group, k, radius)
    return _HELD[name]


def _find(group: list[tuple[int, bytes]], k: int, similarity: float, radius: int):
    def run(batches):
        items = _held(group, k, radius)
        with np.errstate(over="ignore"):
            for rows, data, offsets in chunks(batches, limit=1_000_000):
                start, stop, first = words(data, offsets, ALNUM)
                if not len(start) or not len(items.ids):
                    continue
                gram, at = word_grams(names(LOWER[data], start, stop), first, k)
                hit = np.flatnonzero(items.filter[(gram >> np.uint64(44)).astype(np.int64)])
                which = np.minimum(np.searchsorted(items.known, gram[hit]), len(items.known) - 1)
                good = items.known[which] == gram[hit]
                hit, which = hit[good], which[good]
                if not len(hit):
                    continue
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                many = items.begin[which + 1] - items.begin[which]
                place, size = np.repeat(hit, many), items.sizes[ranges(items.begin[which], many)]
                found = []
                for n in np.unique(size):
                    # windows of an item's size that hold one of its shingles: others have similarity 0
                    p = place[size == n]
                    d = doc[p]
                    low = np.maximum(p - n + 1, at[d])
                    high = np.maximum(np.minimum(p, at[d + 1] - n), at[d])
                    depth = np.zeros(len(gram) + 1, np.int64)
                    np.add.at(depth, low, 1)
                    np.add.at(depth, high + 1, -1)
                    w = np.flatnonzero(np.cumsum(depth)[:-1])
                    end = np.minimum(w + n, at[doc[w] + 1])
                    need = np.zeros(len(gram) + 1, np.int64)
                    np.add.at(need, w, 1)
                    np.add.at(need, end, -1)
                    used = np.flatnonzero(np.cumsum(need)[:-1])
                    sums = np.zeros((len(used) + 1, 64), np.int32)
                    np.cumsum(_bits(gram[used]), axis=0, out=sums[1:])
                    a = np.searchsorted(used, w)
                    votes = sums[a + end - w] - sums[a]
                    prints = np.packbits(2 * votes > (end - w)[:, None], axis=1)
                    for i, item, apart in items.candidates(prints, n, radius):
                        found.append(np.stack([w[i], end[i], item, apart, doc[w[i]]], axis=1))
                if not found:
                    continue
                found = np.concatenate(found)
                # by document and item, the nearest fingerprints first; a verified window covers those it overlaps
                found = found[np.lexsort((found[:, 0], found[:, 3], found[:, 2], found[:, 4]))]
                out, taken, last = [], [], None
                for a, b, item, _, d in found.tolist():
                    if (d, item) != last:
                        taken, last = [], (d, item)
                    if any(a < y and x < b for x, y in taken):
                        continue
                    alike = _weighted(Counter(gram[a:b].tolist()), items.counts[item])
                    if alike >= similarity:
                        taken.append((a, b))
                        length = min(b - a + k - 1, int(first[d + 1] - first[d]))
                        out.append((d, int(items.ids[item]), a - int(at[d]), length, alike))
                if out:
                    cols = list(zip(*out, strict=True))
                    ids = rows.column("doc_id").take(pa.array(cols[0]))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.float64())], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): the passages of documents that repeat a benchmark item.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are runs of ASCII letters and
    digits and of all that is not ASCII, A-Z lower-cased. Windows as long as an item (a shorter document:
    all of it) get the SimHash of their word shingles; multi-index blocks find every item within radius
    bits, and the similarity of both multisets of shingles (sum of minima over sum of maxima) decides. Of windows
    that overlap and match the same item, the nearest one is told. Items pass through the documents in groups of
    ITEMS and ITEM_BYTES at most, so that neither driver nor task holds more; a group's matches are written before the next. Null and empty texts, items without words and null ids match nothing.
    """
    own = docs.select("doc_id", "text").where("doc_id is not null")
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    schema = "doc_id long, item_id long, first_word long, n_words long, similarity double"
    search = lambda group: own.mapInArrow(_find(group, shingle, similarity, radius), schema)
    passes, group, size = [], [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        text = r.text.encode()
        if group and (len(group) == ITEMS or size + len(text) > ITEM_BYTES):
            # written at once, so that the driver holds one group at a time
            passes.append(cut(search(group)))
            group, size = [], 0
        group.append((r.item_id, text))
        size += len(text)
    return union_all([*passes, search(group)])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    found = leaks(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents against all of benchmark."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).distinct()
