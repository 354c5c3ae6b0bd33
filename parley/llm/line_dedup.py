"""Fuzzy line deduplication by MinHash over character shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bucket_links
from parley.llm.common import connected_components, cut, table
from parley.llm.textblocks import SPACE, chunks, joined, mix, ranges

#: Characters of a shingle.
SHINGLE = 8
SIMILARITY = 0.8
#: Bands of a signature and hashes of a band: at similarity 0.8 a pair is missed with (1 - 0.8 ** 4) ** 10 = 0.5 %.
BANDS, ROWS = 10, 4
#: Bytes of text that are shingled at a time, so that the arrays stay in a core's cache.
BLOCK = 200_000
#: Codes of characters of one byte.
CODE = mix(np.arange(1, 257, dtype=np.uint64))


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of every line: a text of n line feeds has n + 1 lines."""
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(feeds, offsets)) + 1)
    stop = np.sort(np.concatenate([offsets[1:], feeds]))
    return row, start, stop


def _characters(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, start, stop) with characters of UTF-8 instead of bytes; a code is a hash of a character's bytes.

    A character has one code, whatever stands beside it: lines of different blocks meet by their shingles.
    """
    if not len(data) or data.max() < 0x80:
        return CODE[data], start, stop
    leads = np.flatnonzero(data & 0xC0 != 0x80)
    code = CODE[data[leads]]
    size = np.minimum(np.diff(np.r_[leads, len(data)]), 4)
    more = np.flatnonzero(size > 1)
    four = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(4, np.uint8)]), 4)
    word = four[leads[more]].view("<u4")[:, 0].astype(np.uint64) & ((np.uint64(1) << (8 * size[more]).astype(np.uint64)) - np.uint64(1))
    code[more] = mix(word + np.uint64(1))
    return code, np.searchsorted(leads, start), np.searchsorted(leads, stop)


def _inside(start: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Marks start[i] + 0 .. count[i] - 1, of stretches that do not meet, among n places."""
    edge = np.zeros(n + 1, np.int8)
    edge[start] = 1
    edge[start + count] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def _shingles(data: np.ndarray, start: np.ndarray, stop: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of all shingles of k characters of lines; a shorter line is one shingle."""
    codes, start, stop = _characters(data, start, stop)
    whole, short = np.flatnonzero(stop - start >= k), np.flatnonzero(stop - start < k)
    count = stop[whole] - start[whole] - k + 1
    hashes = joined(codes, k)[_inside(start[whole], count, len(codes) - k + 1)] if len(whole) else np.zeros(0, np.uint64)
    few = np.zeros(len(short), np.uint64)
    for i in range(k - 1 if len(short) else 0):
        inside = start[short] + i < stop[short]
        few = np.where(inside, mix(few * np.uint64(3) + codes[np.where(inside, start[short] + i, 0)]), few)
    return np.concatenate([hashes, few]), np.concatenate([np.repeat(whole, count), short])


def signatures(hashes: np.ndarray, line: np.ndarray, n: int, size: int) -> np.ndarray:
    """(n, size) one-permutation MinHash: the least hash in each of size bins, empty bins filled from others.

    An empty bin takes the value of the next filled one to its right, mixed with the distance,
    so that equal sets have equal signatures and bins agree with the probability of the similarity.
    """
    where = (hashes >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
    out = np.full(n * size, np.uint64(2**64 - 1))
    np.minimum.at(out, line * size + where.astype(np.int64), hashes)
    out = out.reshape(n, size)
    filled = out != np.uint64(2**64 - 1)
    # column of the next filled bin, going round
    col = np.where(np.tile(filled, (1, 2)), np.arange(2 * size), 2 * size * 4)
    nxt = np.minimum.accumulate(col[:, ::-1], axis=1)[:, ::-1][:, :size]
    apart = (nxt - np.arange(size)).astype(np.uint64)
    return mix(np.take_along_axis(out, nxt % size, axis=1) + apart * np.uint64(0x9E3779B97F4A7C15))


def bucket_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands): a name of each band's values."""
    sig = sig.reshape(len(sig), bands, rows)
    bucket = np.arange(bands, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows):
        bucket = mix(bucket * np.uint64(3) + sig[:, :, i])
    return bucket


def _blank(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    blank = start == stop
    open_ = np.flatnonzero(~blank)
    # only lines that begin with a space are looked at as a whole
    open_ = open_[SPACE[data[start[open_]]]]
    if len(open_):
        seen = np.r_[0, np.cumsum(~SPACE[data])]
        blank[open_] = seen[stop[open_]] == seen[start[open_]]
    return blank


def _keys(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """128-bit XXH3 of each data[start:stop]."""
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    return [digest(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]


def _read(data: np.ndarray, offsets: np.ndarray):
    """(row, number, start, stop, key) of the lines that are not blank."""
    row, start, stop = line_bounds(data, offsets)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    keep = ~_blank(data, start, stop)
    row, start, stop, number = row[keep], start[keep], stop[keep], number[keep]
    return row, number, start, stop, _keys(data, start, stop)


def _lines(shingle: int, bands: int, rows_: int):
    """LINES of each line that is not blank; the buckets of equal lines of a block are told once."""

    def run(batches):
        for rows, data, offsets in chunks(batches, limit=BLOCK):
            row, number, start, stop, key = _read(data, offsets)
            if not len(row):
                continue
            seen: dict = {}
            for i, k in enumerate(key):
                seen.setdefault(k, i)
            own = np.fromiter(seen.values(), np.int64, len(seen))
            hashes, line = _shingles(data, start[own], stop[own], shingle)
            bucket = bucket_hashes(signatures(hashes, line, len(own), bands * rows_), bands, rows_)
            told = np.zeros(len(row), np.int64)
            told[own] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(told)].astype(np.int32)), pa.array(bucket.reshape(-1).view(np.int64)))
            cols = [rows.column("doc_id").take(pa.array(row)), pa.array(number), pa.array(key, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "line", "key", "buckets"])

    return run


LINES = "doc_id long, line long, key binary, buckets array<long>"


def _texts(batches):
    """(key, text) of the asked lines of each document."""
    for rows, data, offsets in chunks(batches):
        row, start, stop = line_bounds(data, offsets)
        number = np.arange(len(row)) - np.searchsorted(row, row)
        asks = rows.column("asked")
        want = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(asks.offsets))) << 40 | np.asarray(asks.flatten())
        i = np.flatnonzero(np.isin(row << 40 | number, want))
        key = _keys(data, start[i], stop[i])
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), _cut_out(data, start[i], stop[i])], names=["key", "text"])


def binary(values: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values."""
    wide = values.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(0, (len(values) + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _cut_out(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    size = stop - start
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[ranges(start, size)]))])


def _sets(shingle: int):
    """(hash, row) of the shingles of an array of texts."""

    def told(col: pa.Array):
        data, offsets = np.frombuffer(col.buffers()[2] or b"", np.uint8), np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        return _shingles(data, offsets[:-1], offsets[1:], shingle)

    return told


def _similar(shingle: int, least: float):
    """Keeps the pairs (a, b) of lines whose sets of shingles have that Jaccard similarity."""
    sets = _sets(shingle)

    def run(batches):
        with np.errstate(over="ignore"):
            for whole in batches:
                # so many pairs at a time as have 2 MB of text, and one at least
                ends = np.r_[0, np.cumsum(np.asarray(pc.add(pc.binary_length(whole.column("ta")), pc.binary_length(whole.column("tb"))), np.int64))]
                to = 0
                while to < whole.num_rows:
                    at, to = to, max(to + 1, int(np.searchsorted(ends, ends[to] + 2 * BLOCK, "right")) - 1)
                    batch = whole.slice(at, to - at)
                    # pair number and 44 bits of each shingle's hash in one word: plain sorts make the sets and their intersection
                    made = []
                    for side in ("ta", "tb"):
                        hashes, pair = sets(batch.column(side))
                        words = np.sort(pair.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
                        made.append(words[np.r_[True, words[1:] != words[:-1]]])
                    count = lambda words: np.bincount((words >> np.uint64(44)).astype(np.int64), minlength=batch.num_rows)  # noqa: B023, E731
                    sizes = [count(x) for x in made]
                    merged = np.sort(np.concatenate(made), kind="stable")
                    both = count(merged[1:][merged[1:] == merged[:-1]])
                    ok = both >= least * (sizes[0] + sizes[1] - both)
                    yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("a", "b", "ka", "kb")] + [pa.array(ok)], names=["a", "b", "ka", "kb", "ok"])

    return run


def read_lines(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The lines of all documents with their keys and buckets (LINES), written once."""
    return cut(docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_lines(shingle, bands, rows), LINES))


def _tokens(shingle: int):
    """(short, key, token, size) of the distinct shingles of each line."""

    def run(batches):
        with np.errstate(over="ignore"):
            for rows, data, offsets in chunks(batches):
                hashes, line = _shingles(data, offsets[:-1], offsets[1:], shingle)
                order = np.lexsort((hashes, line))
                hashes, line = hashes[order], line[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])][: len(hashes)]
                hashes, line = hashes[new], line[new]
                size = np.bincount(line, minlength=rows.num_rows)[line]
                cols = [rows.column("short").take(pa.array(line)), rows.column("key").take(pa.array(line)), pa.array(hashes.view(np.int64)), pa.array(size)]
                yield pa.RecordBatch.from_arrays(cols, names=["short", "key", "token", "size"])

    return run


def line_links(docs: DataFrame, distinct: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): keys of distinct lines; they make the components of all lines that share a band and whose shingle
    sets have the Jaccard similarity or more.

    Lines that share a band meet in a bucket, where bucket_links.links() compares them exactly and leaves
    no pair of different components out, however large the bucket. Buckets know lines by a 64-bit hash of their
    128-bit keys; each text of that hash is compared.
    """
    own = distinct.withColumn("short", F.xxhash64("key"))
    member = bucket_links.members(own)
    # each text that is compared is read where it stands first
    place = own.select("short", "first").join(member.select("short").distinct(), "short", "left_semi")
    asked = place.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list("first.line").alias("asked"))
    text = docs.select("doc_id", "text").join(asked, "doc_id").select("text", "asked").mapInArrow(_texts, "key binary, text binary")
    # a doc_id with several texts may bring a line twice, or another one
    text = text.withColumn("short", F.xxhash64("key")).dropDuplicates(["key"]).select("short", "key", "text")
    return bucket_links.links(member, cut(text), _similar(shingle, similarity), _tokens(shingle), similarity, sets=_sets(shingle))


def repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, gone): the lines of each document, by number from 0, that are not the one kept of their component.

    Lines are cut at line feeds. Equal lines, and lines linked through near ones, form a component; the line of
    the smallest (doc_id, number) stays, all others go. Blank lines are no lines here and stay.
    Equal lines are folded into one row before anything is compared, so a line that is common everywhere is one row.
    Null and empty texts have no lines. Rows of null doc_id are left out; repeated rows of a document are one.
    """
    place = F.struct("doc_id", "line")
    lines = read_lines(docs, **{k: v for k, v in options.items() if k in ("shingle", "bands", "rows")})
    distinct = cut(lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.max("buckets").alias("buckets")))
    groups = connected_components(line_links(docs, distinct, **{k: v for k, v in options.items() if k in ("shingle", "similarity")}))
    first = distinct.select("key", "first", "n").join(groups.withColumnRenamed("node", "key"), "key", "left")
    first = cut(first.where("n > 1 or component is not null").select("key", F.coalesce("component", "key").alias("component"), "first"))
    kept = first.groupBy("component").agg(F.min("first").alias("kept"))
    kept = first.join(kept, "component").select("key", "kept")
    gone = lines.select("doc_id", "line", "key").join(kept, "key").where(place != F.col("kept"))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def remove_lines(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with those lines taken out of text, and n_lines and n_gone added; every row stays, a null text too."""
    at = F.split(F.col("text"), "\n", -1)
    # the numbers that stay, by a set difference, then their lines; the outer transform splits the text once
    stay = lambda x: F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), F.size(x.l) - F.lit(1).cast("long")), x.g), lambda i: F.get(x.l, i.cast("int")))
    kept = F.get(F.transform(F.array(F.struct(at.alias("l"), F.col("gone").alias("g"))), lambda x: F.array_join(stay(x), "\n")), F.lit(0))
    own = docs.drop("gone", "n_lines", "n_gone").join(gone, "doc_id", "left")
    out = own.withColumns({"n_lines": F.coalesce(F.size(at), F.lit(0)).cast("long"), "n_gone": F.coalesce(F.size("gone"), F.lit(0)).cast("long"), "text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)})
    return out.drop("gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all lines of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_lines(docs, repeated_lines(docs))
    return out.select("doc_id", "n_lines", "n_gone", F.sha2("text", 256).alias("kept_sha256"))
