"""Exact substring deduplication over words by recompression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm import repeats
from parley.llm.common import table
from parley.llm.textblocks import SPACE, chunks, mix, prefix, ranges, spans, words
from parley.llm.textblocks import names as word_names

WINDOW = 50
#: Each round names runs of equal symbols, then pairs of a left and a right symbol.
ROUNDS = 3
_FAR = np.int64(1) << 40
_NONE = np.uint64(2**64 - 1)


class Parse:
    """Symbols of a block of documents: name, words [start, stop), and the words [lo, hi) that decide them.

    A name is a hash of what it stands for, the same on every executor, so it is global without a
    table of names. A symbol whose naming depends on the end of its document decides nothing elsewhere:
    its lo or hi lies far outside.
    """

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        self.name, self.doc = names, doc
        self.start = np.arange(len(names))
        self.stop = self.start + 1
        self.lo, self.hi = self.start.copy(), self.stop.copy()

    def _beside(self):
        """(lo, hi) of the symbol before and of the one behind; far outside at a document's ends."""
        same = self.doc[1:] == self.doc[:-1]
        out = []
        for side in (0, 1):
            lo, hi = np.full(len(self.lo), -_FAR), np.full(len(self.hi), _FAR)
            (lo[1:] if side == 0 else lo[:-1])[same] = (self.lo[:-1] if side == 0 else self.lo[1:])[same]
            (hi[1:] if side == 0 else hi[:-1])[same] = (self.hi[:-1] if side == 0 else self.hi[1:])[same]
            out.append((lo, hi))
        return same, *out

    def _take(self, head: np.ndarray, tail: np.ndarray, name: np.ndarray, before, behind, left: np.ndarray, right: np.ndarray):
        """Symbols head..tail become one each, decided by all of them, and by the one before (left) and behind (right)."""
        lo, hi = np.minimum.reduceat(self.lo, head), np.maximum.reduceat(self.hi, head)
        for where, side, at in ((left, before, head), (right, behind, tail)):
            lo = np.where(where, np.minimum(lo, side[0][at]), lo)
            hi = np.where(where, np.maximum(hi, side[1][at]), hi)
        self.name, self.doc, self.start, self.stop, self.lo, self.hi = name, self.doc[head], self.start[head], self.stop[tail], lo, hi

    def runs(self):
        """a a a becomes one symbol; that a run ends is decided by both neighbours."""
        same, before, behind = self._beside()
        cut = np.ones(len(self.name), bool)
        cut[1:] = ~(same & (self.name[1:] == self.name[:-1]))
        head = np.flatnonzero(cut)
        tail = np.r_[head[1:], len(cut)] - 1
        length = (tail - head + 1).astype(np.uint64)
        name = np.where(length > 1, mix(self.name[head] + length * np.uint64(0xA24BAED4963EE407)), self.name[head])
        every = np.ones(len(head), bool)
        self._take(head, tail, name, before, behind, every, every)

    def pairs(self, turn: int):
        """Names fall into left and right ones by a bit of their hash; left right becomes one symbol.

        A pair is decided by its two symbols; one that stays alone by the neighbour that did not fit.
        """
        same, before, behind = self._beside()
        right = (mix(self.name + np.uint64(turn + 1)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(right), bool)
        joins[:-1] = same & ~right[:-1] & right[1:]
        head = np.flatnonzero(~np.r_[False, joins[:-1]])
        pair = joins[head]
        tail = head + pair
        name = np.where(pair, mix(self.name[head] * np.uint64(3) + mix(self.name[tail])), self.name[head])
        self._take(head, tail, name, before, behind, ~pair & right[head], ~pair & ~right[head])


def chosen(parse: Parse, n_words: int, width: int) -> np.ndarray:
    """For each window start the symbol that the window chooses, by its content alone; -1: none.

    Of the symbols that are decided by words of the window, it takes one of several words before one of a
    single word, then the least hash, then the first.
    """
    first, last = np.maximum(parse.hi - width, 0), np.minimum(parse.lo, n_words - 1)
    fit = np.flatnonzero((parse.hi - parse.lo <= width) & (first <= last))
    bits = np.uint64(max(1, int(len(parse.name)).bit_length()))
    rank = mix(parse.name ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
    rank |= (parse.stop - parse.start == 1).astype(np.uint64) << np.uint64(63)
    value = (rank[fit] >> bits << bits) | fit.astype(np.uint64)
    # least value over each window: every interval is two blocks of a power of two
    length = last[fit] - first[fit] + 1
    level = np.frexp(length.astype(np.float64))[1] - 1
    best = None
    for k in range(int(level.max()) if len(level) else 0, -1, -1):
        own = np.full(n_words, _NONE)
        if best is not None:
            half = 1 << k
            own = best.copy()
            own[half:] = np.minimum(own[half:], best[: len(best) - half])
        at = np.flatnonzero(level == k)
        np.minimum.at(own, first[fit[at]], value[at])
        np.minimum.at(own, last[fit[at]] + 1 - (1 << k), value[at])
        best = own
    if best is None:
        return np.full(n_words, -1)
    return np.where(best == _NONE, -1, (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))


def _stretches(width: int, rounds: int):
    def run(batches):
        with np.errstate(over="ignore"):
            for rows, data, offsets in chunks(batches):
                start, stop, first = words(data, offsets, ~SPACE)
                count = np.diff(first)
                if not len(start) or count.max() < width:
                    continue
                names = word_names(data, start, stop)
                doc = np.repeat(np.arange(len(count)), count)
                parse = Parse(names, doc)
                for turn in range(rounds):
                    parse.runs()
                    parse.pairs(turn)
                pick = chosen(parse, len(names), width)
                ok = np.zeros(len(names), bool)
                long = np.flatnonzero(count >= width)
                ok[ranges(first[long], count[long] - width + 1)] = True
                begins = ok.copy()
                begins[1:] &= ~(ok[:-1] & (pick[1:] == pick[:-1]) & (pick[1:] >= 0) & (doc[1:] == doc[:-1]))
                w = np.flatnonzero(begins)
                # windows that are left out end a stretch too
                n = np.diff(np.r_[np.cumsum(ok)[w] - 1, ok.sum()])
                sums, p = prefix(names), pick[w]
                lo, hi = np.where(p >= 0, parse.lo[p], w), np.where(p >= 0, parse.hi[p], w + width)
                at = np.where(p >= 0, parse.start[p], w)
                key = mix(spans(sums, lo, hi) + (at - lo).astype(np.uint64))
                variant = mix(spans(sums, w, w + n - 1 + width) + (at - w).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
                yield repeats.chains(key, variant, rows.column("doc_id"), doc[w], w - first[doc[w]], n, width)

    return run


def _windows(width: int):
    """Hash of each window of the asked stretches."""

    def run(batches):
        with np.errstate(over="ignore"):
            for rows, data, offsets in chunks(batches):
                start, stop, first = words(data, offsets, ~SPACE)
                sums = prefix(word_names(data, start, stop))
                asks = rows.column("asked")
                lists = pa.array(np.diff(np.asarray(asks.offsets)))
                flat = asks.flatten()
                doc = np.repeat(np.arange(rows.num_rows), np.asarray(lists))
                at, n = first[doc] + np.asarray(flat.field("start")), np.asarray(flat.field("n"))
                # a repeated doc_id with another text may be shorter
                good = at + n - 1 + width <= first[doc + 1]
                at, n, flat = at[good], n[good], flat.filter(pa.array(good))
                w, which = ranges(at, n), np.repeat(np.arange(len(at)), n)
                take = pa.array(which)
                cols = [flat.field("key").take(take), flat.field("variant").take(take), rows.column("doc_id").take(pa.array(doc[good][which]))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(w - at[which]), pa.array(spans(sums, w, w + width).view(np.int64))], names=["key", "variant", "least", "i", "content"])

    return run


def repeated_words(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, spans): the words [start, stop) of each document that windows of width words cover which also start
    in a document with a smaller doc_id; documents without such words have no row.

    Every document is recompressed in its task: rounds name runs and pairs of symbols by hashes of their
    content, so that equal word sequences get equal interior symbols everywhere. Each window chooses one
    of the symbols that its own words decide; stretches of windows with one symbol are gathered by key in Spark.
    Where all occurrences of a key read alike, the stretch is one repeat; else its windows
    are verified one by one over one row per distinct variant, not per occurrence. Equality of
    windows is that of 128 bits of hashes. Rows of null doc_id and null texts have no words here.
    """
    own = docs.select("doc_id", "text").where("doc_id is not null")
    found = repeats.repeated(own.mapInArrow(_stretches(width, rounds), repeats.STRETCH), across=True)
    alike = found.where("not many and doc_id > first.doc_id").select("doc_id", "start", (F.col("last") + F.col("n") - 1 + width).alias("stop"))
    # each variant is read where it stands first, so that its least document is the one it is read from
    texts = own.join(repeats.asked(found), "doc_id").select("doc_id", "text", "asked")
    windows = texts.mapInArrow(_windows(width), "key long, variant long, least long, i long, content long")
    windows = windows.withColumn("least", F.min("least").over(W.partitionBy("key", "content")))
    per = windows.groupBy("key", "variant").agg(F.collect_list(F.struct("i", "least")).alias("seen"))
    mixed = found.where("many").join(per, ["key", "variant"]).select("doc_id", "start", "last", F.explode("seen").alias("w")).where("w.least < doc_id")
    mixed = mixed.select("doc_id", (F.col("start") + F.col("w.i")).alias("start"), (F.col("last") + F.col("w.i") + width).alias("stop"))
    return repeats.by_document(alike.unionByName(mixed))


def remove_words(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the remaining words, joined by one space.

    Every row of docs gives a row, repeated ones too; null texts have no words.
    """

    def run(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, cuts in zip(batch.column("text"), batch.column("spans"), strict=True):
                ws = (text.as_py() or "").encode().split()
                n.append(len(ws))
                cuts = cuts.values
                if cuts is not None and len(cuts):
                    a, b = (np.minimum(np.asarray(cuts.field(k)), len(ws)) for k in ("start", "stop"))
                    depth = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(depth, a, 1)
                    np.add.at(depth, b, -1)
                    stay = np.cumsum(depth)[:-1] == 0
                    ws = [ws[i] for i in np.flatnonzero(stay)]
                gone.append(n[-1] - len(ws))
                kept.append(b" ".join(ws).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text").join(found, "doc_id", "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: windows of 50 words of every document."""
    docs = table(spark, sf_dir, "documents")
    out = remove_words(docs, repeated_words(docs))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS ws FROM documents),
w AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS pos FROM d WHERE len(ws) >= 50)),
f AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY s) AS least FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS gone FROM f WHERE least < doc_id),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM d),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS kept, count(*) AS n FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.pos = g.gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
