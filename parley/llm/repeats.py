"""What the two exact substring operators share: anchored stretches of windows, and spans of documents.

An anchor stretch is a run of consecutive windows of one document that choose the same anchor, by their
content alone. Equal windows choose equal anchors, so they meet under one key: the hash of the anchor's
surroundings. A variant is a distinct content of a stretch under its key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import cut
from parley.llm.textblocks import mix

#: A chain of stretches: key and variant hash, document, first window, number of windows of each, and the first
#: windows of the second (start, if there is none) and of the last one.
STRETCH = "key long, variant long, doc_id long, start long, n long, second long, last long"


def chains(key: np.ndarray, variant: np.ndarray, doc_id: pa.Array, doc: np.ndarray, start: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
    """Rows of STRETCH. Stretches of one document that read alike, each of which begins within the one
    before, are one chain: a text that repeats itself with a short period gives few rows."""
    whose = mix(variant + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(whose, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = (whose[order][1:] != whose[order][:-1]) | (np.diff(start[order]) > width)
    first = np.flatnonzero(head)
    end = np.r_[first[1:], len(order)] - 1
    a = order[first]
    cols = [key[a].view(np.int64), variant[a].view(np.int64), doc_id.take(pa.array(doc[a])), start[a], n[a], start[order[np.minimum(first + 1, end)]], start[order[end]]]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["key", "variant", "doc_id", "start", "n", "second", "last"])


def repeated(stretches: DataFrame, across: bool) -> DataFrame:
    """The stretches whose key occurs again (across: in another document), with first, the variant's first place,
    and many, whether the key has several variants. Window functions over one shuffle; they spill."""
    by_key, by_variant = W.partitionBy("key"), W.partitionBy("key", "variant")
    own = stretches.withColumns({
        "_a": F.min("variant").over(by_key), "_b": F.max("variant").over(by_key),
        "_c": F.min("doc_id").over(by_key), "_d": F.max("doc_id").over(by_key), "_n": F.sum(F.when(F.col("last") > F.col("start"), 2).otherwise(1)).over(by_key),
    })
    own = own.where("_c <> _d" if across else "_n > 1")
    own = own.withColumn("first", F.min(F.struct("doc_id", "start")).over(by_variant))
    return cut(own.select("key", "variant", "doc_id", "start", "n", "second", "last", "first", (F.col("_a") != F.col("_b")).alias("many")))


def asked(own: DataFrame) -> DataFrame:
    """One place of each variant that shares its key, gathered by document: doc_id, asked array<struct>."""
    one = own.where("many").groupBy("key", "variant").agg(F.min("first").alias("first"), F.min("n").alias("n"))
    ask = F.struct("key", "variant", F.col("first.start").alias("start"), "n")
    return one.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(ask).alias("asked"))


def by_document(spans: DataFrame) -> DataFrame:
    """doc_id, spans: distinct (start, stop) in order; at most as many as the document has places."""
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
