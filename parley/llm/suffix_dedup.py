"""Exact substring deduplication over bytes by a common-prefix interval tree of enhanced suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import repeats
from parley.llm.common import cut, table
from parley.llm.textblocks import BYTE, chunks, joined, mix, prefix, ranges, sliding_min, spans

WIDTH = 100
#: Bytes of an anchor: the least of the anchors in a window names the bucket of the window's suffix.
ANCHOR = 32
#: Variants of a bucket that one task sorts; larger buckets are split by the windows themselves.
BUCKET = 512


def _stretches(width: int, anchor: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for rows, data, offsets in chunks(batches):
                length = np.diff(offsets)
                if not len(data) or length.max() < width:
                    continue
                sums = prefix(BYTE[data])
                grams = mix(joined(BYTE[data], anchor))
                at = np.arange(len(grams))
                # the least hash of the window, then the first place
                bits = np.uint64(max(1, int(len(grams)).bit_length()))
                low = (np.uint64(1) << bits) - np.uint64(1)
                least = sliding_min((grams >> bits << bits) | at.astype(np.uint64), width - anchor + 1)
                pick = (least & low).astype(np.int64)
                long = np.flatnonzero(length >= width)
                w = ranges(offsets[:-1][long], length[long] - width + 1)
                doc = np.repeat(long, length[long] - width + 1)
                pick = pick[w]
                begins = np.ones(len(w), bool)
                begins[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(begins)
                n = np.diff(np.r_[first, len(w)])
                w, doc, pick = w[first], doc[first], pick[first]
                variant = mix(spans(sums, w, w + n - 1 + width) + (pick - w).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                yield repeats.chains(grams[pick], variant, rows.column("doc_id"), doc, w - offsets[doc], n, width)

    return run


def _contexts(width: int):
    """Bytes of each asked stretch, with the byte before it (-1 at a document's start)."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            asks, raw = rows.column("asked"), data.tobytes()
            lists = np.diff(np.asarray(asks.offsets))
            flat = asks.flatten()
            doc = np.repeat(np.arange(rows.num_rows), lists)
            at, n = offsets[doc] + np.asarray(flat.field("start")), np.asarray(flat.field("n"))
            good = at + n - 1 + width <= offsets[doc + 1]
            at, n, doc, flat = at[good], n[good], doc[good], flat.filter(pa.array(good))
            before = np.where(at > offsets[doc], data[np.maximum(at - 1, 0)], -1).astype(np.int32)
            pieces = [raw[a:b] for a, b in zip(at.tolist(), (at + n - 1 + width).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field("key"), flat.field("variant"), flat.field("n"), pa.array(before), pa.array(pieces, pa.binary())], names=["key", "variant", "n", "before", "piece"])

    return run


def suffix_order(text: np.ndarray, bucket: np.ndarray, place: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes text[place:end], within their buckets; lcp is that with the suffix before.

    Suffixes are at least width long. They are grouped by bucket and first width bytes (by hash), then
    sorted as big-endian words of the bytes beyond, so that equal prefixes stand together.
    """
    sums = prefix(BYTE[text])
    root = mix(spans(sums, place, place + width) ^ bucket)
    beyond, rest = int((end - place).max()) - width, end - place - width
    lanes = []
    for at in range(0, beyond, 8):
        word = np.zeros(len(place), np.uint64)
        for k in range(8):
            inside = at + k < rest
            byte = np.where(inside, text[np.where(inside, place + width + at + k, 0)], 0)
            word = (word << np.uint64(8)) | byte.astype(np.uint64)
        lanes.append(word)
    order = np.lexsort([rest, *lanes[::-1], root])
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    same = root[a] == root[b]
    shared = np.zeros(len(a), np.int64)
    open_ = same.copy()
    for word in lanes:
        diff = word[a] ^ word[b]
        open_now, open_ = open_, open_ & (diff == 0)
        for k in (1, 2, 4, 8, 16, 32):
            diff |= diff >> np.uint64(k)
        # leading equal bytes of the word
        shared += np.where(open_now, (64 - np.bitwise_count(diff).astype(np.int64)) // 8, 0)
    shared = np.minimum(shared, np.minimum(rest[a], rest[b]))
    lcp[1:] = np.where(same, width + shared, 0)
    return order, lcp


def intervals(lcp: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(left, right, depth) of the common-prefix intervals of depth width or more, by a scan with a stack."""
    out, stack = [], []
    for i, h in enumerate([*lcp[1:].tolist(), 0], 1):
        left = i - 1
        while stack and stack[-1][1] > h:
            left, depth = stack.pop()
            out.append((left, i, depth))
        if h >= width and (not stack or stack[-1][1] < h):
            stack.append((left, h))
    return out


def _groups(width: int):
    """Maximal repeats of whole buckets: rows of one bucket follow each other."""

    def solve(keys, variants, counts, befores, pieces):
        text = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        base = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(pieces)), counts)
        place = ranges(base, counts)
        order, lcp = suffix_order(text, keys[owner].view(np.uint64), place, (base + size)[owner], width)
        # the byte to the left; unknown ones, at a document's start, are all different
        first = place == base[owner]
        left = np.where(first, befores[owner], text[np.maximum(place - 1, 0)].astype(np.int64))
        left = np.where(left < 0, -1 - owner, left)[order]
        # changes of the left byte in suffix order: an interval without one is not left-diverse
        changes = np.zeros(len(left) + 1, np.int64)
        changes[2:] = np.cumsum(left[1:] != left[:-1])
        # the first window of a stretch may be continued by the stretch before it: it always counts
        heads = np.r_[0, np.cumsum(first[order])]
        ids, offs, lens, groups = [], [], [], []
        for a, b, depth in intervals(lcp, width):
            if changes[b] > changes[a + 1] or heads[b] > heads[a]:
                o = order[a:b]
                ids.append(owner[o]), offs.append(place[o] - base[owner[o]])
                lens.append(np.full(b - a, depth)), groups.append(np.full(b - a, len(groups)))
        if not ids:
            return None
        ids, offs = np.concatenate(ids), np.concatenate(offs)
        group = mix(np.concatenate(groups).astype(np.uint64) + mix(keys[ids].view(np.uint64)))
        cols = [keys[ids], group.view(np.int64), variants[ids], offs, np.concatenate(lens)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "grp", "variant", "offset", "length"])

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "variant", "n", "before", "piece")), strict=True):
                # whole buckets together, many small ones at a time
                if held and row[0] != held[-1][0] and size > 400_000:
                    yield out if (out := solve(*map(_column, zip(*held, strict=True)))) else empty
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield out if (out := solve(*map(_column, zip(*held, strict=True)))) else empty

    def _column(values):
        return np.array(values, np.int64) if not isinstance(values[0], bytes) else values

    names = ["key", "grp", "variant", "offset", "length"]
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, names=names)
    return run


def _windows(width: int):
    """Hash of each window of a stretch, for buckets that are too large to be sorted in one task."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for key, variant, n, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "variant", "n", "piece")), strict=True):
                    sums, at = prefix(BYTE[np.frombuffer(piece, np.uint8)]), np.arange(n)
                    content = spans(sums, at, at + width).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(content), pa.array(np.full(n, variant)), pa.array(at), pa.array(np.full(n, width))], names=["key", "grp", "variant", "offset", "length"])

    return run


def maximal_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Groups of repeats of width bytes or more, and the occurrences of their variants.

    docs: doc_id, text; other columns are ignored. Suffixes are dealt to buckets by the least anchor of their
    first width bytes, which equal strings share. Buckets whose suffixes all read alike are one repeat.
    Of the others, each distinct surrounding (variant) sends its suffixes to an enhanced suffix
    array; a scan with a stack gives the tree of its common-prefix intervals, and those with
    different bytes to the left are the maximal repeats, with all members. A bucket of more than
    `bucket` variants is split: its windows of width bytes are grouped in Spark, which gives the same covered bytes.

    Returns groups (key, grp, variant, offset, length: a variant's part of a group; least: the group's first
    occurrence (doc_id, start)) and occurrences (key, variant, doc_id, start, n, second, last, first,
    many) of all repeated stretches, by chains; a stretch with many = false is a group of its own, of n - 1 + width
    bytes. A repeat longer than its stretch is continued by the neighbouring stretches. Rows of
    null doc_id are left out; null and short texts have no repeats; repeated rows are one occurrence.
    """
    own = docs.select("doc_id", "text").where("doc_id is not null")
    found = repeats.repeated(own.mapInArrow(_stretches(width, anchor), repeats.STRETCH), across=False)
    pieces = own.join(repeats.asked(found), "doc_id").select("text", "asked").mapInArrow(_contexts(width), "key long, variant long, n long, before int, piece binary")
    pieces = cut(pieces.dropDuplicates(["key", "variant"]))
    large = pieces.groupBy("key").agg(F.count("*").alias("variants")).where(F.col("variants") > bucket).select("key")
    schema = "key long, grp long, variant long, offset long, length long"
    small = pieces.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "variant").mapInArrow(_groups(width), schema)
    split = pieces.join(large, "key", "left_semi").mapInArrow(_windows(width), schema)
    firsts = found.where("many").groupBy("key", "variant").agg(F.min("first").alias("first"))
    members = cut(small.unionByName(split)).join(firsts, ["key", "variant"])
    at = F.struct(F.col("first.doc_id").alias("doc_id"), (F.col("first.start") + F.col("offset")).alias("start"))
    least = members.groupBy("key", "grp").agg(F.min(at).alias("least"))
    return members.join(least, ["key", "grp"]).drop("first"), found


def repeated_bytes(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """(doc_id, spans): the bytes [start, stop) of each document in an occurrence of a maximal repeat that is not its first."""
    groups, found = maximal_repeats(docs, width, **options)
    place = F.struct("doc_id", "start")
    # all of a variant is repeated but its first place; of a chain that stands there, all but its first stretch
    begin = F.when(place > F.col("first"), F.col("start")).when(F.col("last") > F.col("start"), F.col("second"))
    again = found.select("doc_id", begin.alias("start"), (F.col("last") + F.col("n") - 1 + width).alias("stop")).where("start is not null")
    part = groups.groupBy("key", "variant").agg(F.collect_set(F.struct("offset", "length", "least")).alias("parts"))
    head = found.where(F.col("many") & (place <= F.col("first"))).join(part, ["key", "variant"]).select("doc_id", "start", F.explode("parts").alias("p"))
    head = head.where(F.struct("doc_id", (F.col("start") + F.col("p.offset")).alias("start")) > F.col("p.least"))
    head = head.select("doc_id", (F.col("start") + F.col("p.offset")).alias("start"), (F.col("start") + F.col("p.offset") + F.col("p.length")).alias("stop"))
    return repeats.by_document(again.unionByName(head))


def remove_bytes(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the remaining bytes of each text, as binary.

    Every row of docs gives a row, repeated ones too; null texts have no bytes.
    """

    def run(batches):
        for batch in batches:
            n, gone, runs, kept = [], [], [], []
            for text, cuts in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = (text.as_py() or "").encode()
                out, at, removed, count = [], 0, 0, 0
                cuts = cuts.values
                if cuts is not None and len(cuts):
                    a, b = (np.minimum(np.asarray(cuts.field(k)), len(raw)) for k in ("start", "stop"))
                    reach = np.maximum.accumulate(b)
                    heads = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
                    for s, e in zip(a[heads].tolist(), reach[np.r_[heads[1:], len(a)] - 1].tolist(), strict=True):
                        if e > s:
                            out.append(raw[at:s])
                            at, removed, count = e, removed + e - s, count + 1
                out.append(raw[at:])
                n.append(len(raw)), gone.append(removed), runs.append(count), kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, runs)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.select("doc_id", "text").join(found, "doc_id", "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: repeats of 100 bytes of every document."""
    docs = table(spark, sf_dir, "documents")
    out = remove_bytes(docs, repeated_bytes(docs))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
b AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM f),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
s AS (SELECT doc_id, run, min(p) AS start, max(p) + 100 AS stop FROM i GROUP BY 1, 2),
c AS (SELECT s.doc_id, start, stop, substr(h, 2 * coalesce(lag(stop) OVER (PARTITION BY s.doc_id ORDER BY start), 0) + 1, 2 * (start - coalesce(lag(stop) OVER (PARTITION BY s.doc_id ORDER BY start), 0))) AS kept FROM s JOIN d USING (doc_id)),
g AS (SELECT doc_id, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS stop, string_agg(kept, '' ORDER BY start) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
