"""Links at a Jaccard similarity between the members of buckets, compared exactly until none is left."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import connected_components, cut
from parley.llm.textblocks import mix

#: Members of a bucket whose pairs are listed; larger buckets go through prefixes.
FEW = 16
#: Members of a part of a bucket: larger buckets are dealt out in parts, each with the bucket's first.
PART = 2048
#: Bins of the counts that bound an overlap from above.
BINS = 256
PAIRS = "a long, b long, ka binary, kb binary, ok boolean"
TOKENS = "short long, key binary, token long, size long"


def _order():
    return F.xxhash64("bucket", "short")


def _shared(batches):
    """(bucket, part, short, first) of the rows (bucket, short) whose bucket the row before or behind has too; rows come sorted by bucket.

    first: the first short of the bucket, and of each of its parts. Only the last row is held, however long a bucket is.
    """
    held = None
    out = lambda cols: pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["bucket", "part", "short", "first"])
    for batch in batches:
        bucket, short = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(bucket):
            continue
        first, place, mark = short.copy(), np.zeros(len(bucket), np.int64), np.zeros(len(bucket), bool)
        if held is not None:
            bucket, short, first, place, mark = (np.r_[h, x] for h, x in zip(held, (bucket, short, first, place, mark), strict=True))
        same = bucket[1:] == bucket[:-1]
        mark[1:] |= same
        mark[:-1] |= same
        index = np.arange(len(bucket))
        heads = np.maximum.accumulate(np.where(np.r_[True, ~same], index, 0))
        first, place = first[heads], place[heads] + index - heads
        held = bucket[-1], short[-1], first[-1], place[-1], mark[-1]
        keep = np.flatnonzero(mark[:-1])
        more = keep[(place[keep] > 0) & (place[keep] % PART == 0)]
        keep, short_ = np.r_[keep, more], np.r_[short[keep], first[more]]
        yield out((bucket[keep], place[keep] // PART, short_, first[keep]))
    if held is not None and held[4]:
        b, s, f, p, _ = held
        yield out(([b], [p // PART], [s], [f]))
        if p and p % PART == 0:
            yield out(([b], [p // PART], [f], [f]))


def _folded(batches):
    """The rows of _shared(), where a bucket of one part has its name from its members and the smallest of them as its first.

    So buckets of the same members are equal rows. The last bucket is held, up to a part of it: what is held beyond that has a row
    of a later part, and neither it nor the rest is renamed.
    """
    held = None
    for batch in itertools.chain(batches, [None]):
        cols = held if batch is None else [np.asarray(x) for x in batch.columns] if held is None else [np.r_[h, x] for h, x in zip(held, batch.columns, strict=True)]
        if cols is None or not len(cols[0]):
            continue
        # firsts of later parts stand at the end of a batch
        order = np.argsort(cols[0], kind="stable")
        bucket, part, short, first = (x[order] for x in cols)
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        to = len(bucket) if batch is None or len(bucket) - start[-1] > PART else start[-1]
        held = None if to == len(bucket) else [x[to:] for x in (bucket, part, short, first)]
        bucket, part, short, first, start = bucket[:to], part[:to], short[:to], first[:to], start[start < to]
        if not to:
            continue
        size = np.diff(np.r_[start, to])
        # two sums of hashes of the members, whatever their order; where names of two sets met, their members would meet too
        one, two = (np.add.reduceat(mix(short.view(np.uint64) * np.uint64(x)), start) for x in (1, 3))
        named = np.repeat(np.maximum.reduceat(part, start) == 0, size)
        bucket = np.where(named, np.repeat(mix(mix(one) + two + size.astype(np.uint64)).view(np.int64), size), bucket)
        first = np.where(named, np.repeat(np.minimum.reduceat(short, start), size), first)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, part, short, first)], names=["bucket", "part", "short", "first"])


def members(rows: DataFrame) -> DataFrame:
    """(bucket, part, short, first) of buckets (short, buckets) that hold more than one short, written once.

    One shuffle of numbers; a bucket streams through its task, and rows that are alone end there. Of buckets with the same
    members, which near texts share by the band, one stays: the others would have the same pairs.
    """
    # one sort column, a number: Spark's radix sort
    dealt = rows.select(F.explode("buckets").alias("bucket"), "short").repartition("bucket").sortWithinPartitions("bucket")
    # written before rows are folded: the parts of a large bucket follow the order in which its rows came
    return cut(cut(dealt.mapInArrow(lambda batches: _folded(_shared(batches)), "bucket long, part long, short long, first long")).distinct())


def _alike(words: np.ndarray, begin: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the sets words[begin[x]:begin[x + 1]] of rows a[i] and b[i] have that Jaccard similarity.

    words: 44 bits of each element, sorted within its row; counts: elements of each row by bin, which bound the overlap from
    above, so that most pairs that are unlike need no more.
    """
    size = np.diff(begin)
    ok = np.minimum(size[a], size[b]) >= least * np.maximum(size[a], size[b])
    todo = np.flatnonzero(ok)
    for at in range(0, len(todo), 2048):
        part = todo[at : at + 2048]
        most = np.minimum(counts[a[part]], counts[b[part]]).sum(axis=1, dtype=np.int64)
        ok[part] = most >= least * (size[a[part]] + size[b[part]] - most)
    todo = np.flatnonzero(ok)
    ends = np.cumsum(size[a[todo]] + size[b[todo]])
    at = 0
    while at < len(todo):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000, "right")))
        part = todo[at:to]
        number = np.arange(len(part), dtype=np.uint64) << np.uint64(44)
        made = []
        for side in (a[part], b[part]):
            n = size[side]
            stop = np.cumsum(n)
            place = np.arange(stop[-1]) + np.repeat(begin[side] - (stop - n), n)
            made.append(words[place] | np.repeat(number, n))
        # two sorted runs, which a stable sort merges
        merged = np.sort(np.concatenate(made), kind="stable")
        both = np.bincount((merged[1:][merged[1:] == merged[:-1]] >> np.uint64(44)).astype(np.int64), minlength=len(part))
        ok[part] = both >= least * (size[a[part]] + size[b[part]] - both)
        at = to
    return ok


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i]; label[x] becomes the smallest row of x's group."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _solve(sets: Callable, least: float, group: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): linked rows of each group; they make the components of all its links.

    All rows of a group are compared with its first, then each row that is not linked to it with all that are in another
    component than it, until no such row is left.
    """
    hashes, row = sets(text)
    words = np.sort(row.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    words = words[np.r_[True, words[1:] != words[:-1]][: len(words)]]
    begin = np.searchsorted(words, np.arange(len(text) + 1, dtype=np.uint64) << np.uint64(44))
    words &= np.uint64((1 << 44) - 1)
    counts = np.bincount(np.repeat(np.arange(len(text)), np.diff(begin)) * BINS + (words % np.uint64(BINS)).astype(np.int64), minlength=len(text) * BINS).reshape(-1, BINS)
    counts = counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(group)]))
    index, used, found = np.arange(len(group)), np.zeros(len(group), bool), []
    label, pivot = index.copy(), start
    while len(pivot):
        used[pivot] = True
        mate = np.full(len(start), -1)
        mate[of[pivot]] = pivot
        mine = mate[of]
        i = np.flatnonzero((mine >= 0) & (label != label[mine]))
        hit = _alike(words, begin, counts, mine[i], i, least)
        # one link to each component is enough
        i = i[hit]
        i = i[np.unique(label[i], return_index=True)[1]]
        found.append((mine[i], i))
        merge(label, *found[-1])
        open_ = (label != label[start][of]) & ~used
        pivot = np.minimum.reduceat(np.where(open_, index, len(group)), start)
        pivot = pivot[pivot < len(group)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _meet(sets: Callable, least: float, limit: int = 1_000_000):
    """MET: links (ka, kb) of all pairs within the parts of buckets, and the buckets (left) of parts that were torn.

    Rows (bucket, part, key, text) come sorted by part, each part's first before the others. Parts are compared as many
    at a time as have limit bytes of text (a row counts as 64 at least); a part of over twice that is torn into pieces,
    each with the part's first.
    """
    names = ["left", "ka", "kb"]

    def told(held, torn):
        key, text = (pa.concat_arrays([x.column(n) for x, _ in held]) for n in ("key", "text"))
        a, b = _solve(sets, least, np.concatenate([g for _, g in held]), text)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), key.take(pa.array(a)), key.take(pa.array(b))], names=names)
        if torn:
            yield pa.RecordBatch.from_arrays([held[-1][0].column("bucket")[-1:], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=names)

    def run(batches):
        held, size, last, number, head = [], 0, None, 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bucket, part = np.asarray(batch.column("bucket")), np.asarray(batch.column("part"))
            fresh = np.r_[(bucket[0], part[0]) != last, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]
            last = bucket[-1], part[-1]
            group = number + np.cumsum(fresh)
            number = int(group[-1])
            heads, ends = np.flatnonzero(fresh), np.cumsum(np.maximum(np.asarray(pc.binary_length(batch.column("text")), np.int64), 64))
            at = 0
            while at < n:
                base = (ends[at - 1] if at else 0) - size
                if fresh[at] and size > limit:
                    yield from told(held, False)
                    held, size = [], 0
                    continue
                over = np.searchsorted(heads, max(at + 1, int(np.searchsorted(ends, base + limit, "right"))))
                soft = int(heads[over]) if over < len(heads) else n
                hard = max(int(np.searchsorted(ends, base + 2 * limit, "right")), at + (len(held) < 2))
                to = min(soft, hard)
                if to > at:
                    held.append((batch.slice(at, to - at), group[at:to]))
                    size += int(ends[to - 1] - (ends[at - 1] if at else 0))
                    own = heads[(heads >= at) & (heads < to)]
                    head = (batch.slice(own[-1], 1), group[own[-1] : own[-1] + 1]) if len(own) else head
                if to < n and to < soft and not fresh[to]:
                    yield from told(held, True)
                    held, size = [head], int(pc.binary_length(head[0].column("text"))[0].as_py())
                at = to
        if held:
            yield from told(held, False)

    return run


MET = "left long, ka binary, kb binary"


def links(member: DataFrame, text: DataFrame, similar: Callable, tokens: Callable, least: float, rounds: int = 3, sets: Callable | None = None) -> DataFrame:
    """(a, b): keys whose links make the components of all pairs that share a bucket and have the similarity.

    member: as members() gives it. text: (short, key, text). similar and tokens are for mapInArrow: the one tells
    ok for (a, b, ka, kb, ta, tb), the other lists (TOKENS) the distinct shingles of (short, key, text).

    With sets, which gives (hash, row) of the shingles of an array of texts, the texts go to the parts of their buckets and
    are compared there (_solve), and buckets of one part that have no pair left are done. Without, each
    member is compared with its bucket's first, and those that are unlike it among themselves, for so many
    rounds: that joins large groups of copies by few pairs a member and moves a text fewer times. Then
    whatever two members of a bucket are still in different components are compared too: by all their pairs if
    the bucket has FEW members or fewer, else by rest_pairs(), which loses none.
    """
    side = lambda x: text.select(F.col("short").alias(x), F.col("key").alias(f"k{x}"), F.col("text").alias(f"t{x}"))
    told = lambda p: p.join(side("a"), "a").join(side("b"), "b").mapInArrow(similar, PAIRS)
    keys = lambda d: d.where("ok").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    if sets:
        dealt = member.join(text, "short").repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("short") != F.col("first"), "short")
        met = cut(dealt.select("bucket", "part", "key", "text").mapInArrow(_meet(sets, least), MET))
        sure = met.where("left is null").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
        left = cut(met.where("left is not null").select(F.col("left").alias("bucket")).union(member.where("part > 0").select("bucket")).distinct())
        if left.isEmpty():
            return sure
        member, done = member.join(left, "bucket", "left_semi"), None
    else:
        done = _rounds(member, told, rounds)
        sure = keys(done)
    groups = connected_components(sure).withColumnRenamed("node", "key")
    named = cut(text.select("short", "key").distinct().join(groups, "key", "left").withColumn("component", F.coalesce("component", "key")))
    own = member.select("bucket", "short").distinct().join(named.select("short", "component"), "short")
    mixed = own.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("n")).where("_a <> _b and n > 2")
    own = cut(own.join(mixed.select("bucket", "n"), "bucket"))
    small = own.where(F.col("n") <= FEW)
    x, y = (small.select("bucket", F.col("short").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
    listed = x.join(y, "bucket").where("a < b and ca <> cb").select("a", "b")
    large = named.join(own.where(F.col("n") > FEW).select("short").distinct(), "short", "left_semi")
    rest = listed.unionByName(rest_pairs(large, text, tokens, least)).distinct()
    if done is not None:
        known = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = rest.join(known, ["a", "b"], "left_anti")
    return sure.unionByName(keys(told(rest)))


def _rounds(member: DataFrame, told: Callable, rounds: int) -> DataFrame:
    """PAIRS of members and their bucket's first, then of those that are unlike it and the first of them, and so on."""
    done = None
    pairs = member.where("short <> first").select("bucket", F.col("first").alias("a"), F.col("short").alias("b"))
    for turn in range(rounds):
        now = pairs.select("a", "b").distinct()
        if done is not None:
            now = now.join(done.select("a", "b"), ["a", "b"], "left_anti")
        now = told(now)
        done = cut(now if done is None else done.unionByName(now))
        if turn == rounds - 1:
            break
        left = pairs.join(done.where("not ok").select("a", "b").distinct(), ["a", "b"], "left_semi").select("bucket", F.col("b").alias("short"))
        again = left.groupBy("bucket").agg(F.min(F.struct(_order().alias("h"), F.col("short"))).alias("f"))
        pairs = cut(left.join(again.select("bucket", F.col("f.short").alias("a")), "bucket").where("short <> a").select("bucket", "a", F.col("short").alias("b")))
        if pairs.isEmpty():
            break
    return done


def rest_pairs(named: DataFrame, text: DataFrame, tokens: Callable, least: float) -> DataFrame:
    """(a, b), a < b: pairs of shorts of different components, among them every pair that has the similarity.

    With shingles in one order, the rarest first, the first shingle that such a pair shares is among
    the n - ceil(least * n) + 1 first of the larger set and, as the overlap is at least 2 * least / (1 + least) of the
    smaller one, among as many by that share of the smaller one: what a family of alike texts has in common
    stands behind both. Shingles that one component alone has are left out of the join, not of the order.
    """
    own = cut(text.join(named.select("key"), "key", "left_semi").mapInArrow(tokens, TOKENS).distinct().join(named.select("key", "component"), "key"))
    counts = own.groupBy("token").agg(F.count("*").alias("n"), (F.min("component") != F.max("component")).alias("shared"))
    place = F.row_number().over(W.partitionBy("key").orderBy("n", "token"))
    up = lambda share: F.col("size") - F.ceil(F.lit(share) * F.col("size") - F.lit(1e-9)) + 1
    head = own.join(counts, "token").withColumn("place", place).where(F.col("shared") & (F.col("place") <= up(least)))
    head = cut(head.select("token", "short", "size", "component", (F.col("place") <= up(2 * least / (1 + least))).alias("short_head")))
    a = head.select("token", F.col("short").alias("p"), F.col("size").alias("sp"), F.col("component").alias("cp"))
    b = head.where("short_head").select("token", F.col("short").alias("q"), F.col("size").alias("sq"), F.col("component").alias("cq"))
    near = a.join(b, "token").where((F.col("sq") <= F.col("sp")) & (F.col("sq") >= F.lit(least) * F.col("sp") - F.lit(1e-9)) & (F.col("cp") != F.col("cq")))
    return near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
