"""Mixing sources to target weights by min-cost flow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import connected_components, cut, join_hot, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: About so many documents of one size and pattern are put in order by one task.
BIN = 1 << 16
ADDED = ["pattern", "size", "source_size", "target", "repeats", "taken"]


def n_words(text):
    """Runs of characters that are no ASCII white space; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple = WEIGHTS, most: int = MAX_REPEATS) -> dict:
    """Target of each source: all words shared by the repeating weights, in order of code points, null last.

    A target stops at most times its source's size; the excess is shared again by weight
    among the others until none is above. The same for a table of sources: source_targets().
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def min_cost_flow(capacity: dict, quota: dict, most: int = MAX_REPEATS) -> dict:
    """Words that each pattern gives to each source: {(pattern, source): words}.

    capacity: words of a pattern (a tuple of the sources that hold its documents); quota: words of a source.
    Passes over a pattern cost 0, 1, 2, ... a word (convex), so documents repeat only where quotas
    ask for it. The costs lie on the arcs that leave the start alone, and augmenting a flow never takes from those: so the most
    that one pass can give, then the most with a second pass added, and so on, is a flow of least cost. Each
    of these is a maximum flow by blocking flows over shortest paths.
    """
    patterns, sources = sorted(capacity, key=str), sorted(quota, key=str)
    start, sink = 0, 1
    name = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    to: list[int] = []
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(len(name) + 2)]

    def arc(a: int, b: int, r: int) -> int:
        # arc i and i ^ 1 are each other's reverse
        for x, y, c in ((a, b, r), (b, a, 0)):
            at[x].append(len(to))
            to.append(y)
            room.append(c)
        return len(to) - 2

    supply = {p: arc(start, name["p", p], 0) for p in patterns}
    gives = {(p, s): arc(name["p", p], name["s", s], most * capacity[p]) for p in patterns for s in dict.fromkeys(p) if s in quota}
    for s in sources:
        arc(name["s", s], sink, quota[s])

    def levels() -> list[int]:
        level, line = [-1] * len(at), [start]
        level[start] = 0
        for x in line:
            for i in at[x]:
                if room[i] > 0 and level[to[i]] < 0:
                    level[to[i]] = level[x] + 1
                    line.append(to[i])
        return level

    for _ in range(most):
        for p in patterns:
            room[supply[p]] += capacity[p]
        while (level := levels())[sink] >= 0:
            tried, path, x = [0] * len(at), [], start
            while True:
                if x == sink:
                    least = min(room[i] for i in path)
                    for i in path:
                        room[i] -= least
                        room[i ^ 1] += least
                    full = next(k for k, i in enumerate(path) if room[i] == 0)
                    x = to[path[full] ^ 1]
                    del path[full:]
                while tried[x] < len(at[x]):
                    i = at[x][tried[x]]
                    if room[i] > 0 and level[to[i]] == level[x] + 1:
                        break
                    tried[x] += 1
                else:
                    if x == start:
                        break
                    x = to[path.pop() ^ 1]
                    tried[x] += 1
                    continue
                path.append(i)
                x = to[i]
    return {k: room[i ^ 1] for k, i in gives.items() if room[i ^ 1]}


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """sources: s, words. Adds number (its place in order of code points, null last) and target, as targets() gives it.

    Any number of sources: they are numbered within ranges, and each time that targets stop at their limit is one
    aggregate over the table, of which two numbers reach the driver.
    """
    own = cut(sources.repartitionByRange(F.asc_nulls_last("s")).sortWithinPartitions(F.asc_nulls_last("s")).withColumn("at", F.monotonically_increasing_id()))
    # one row for each range
    parts = own.groupBy(F.shiftright("at", 33).alias("range")).count().orderBy("range").collect()
    before, offsets = 0, []
    for r in parts:
        offsets.append((r["range"], before))
        before += r["count"]
    if not offsets:
        return own.select("s", "words", F.col("at").alias("number"), F.lit(0.0).alias("target"))
    offset = own.sparkSession.createDataFrame(offsets, "range long, before long")
    own = own.join(F.broadcast(offset), F.shiftright("at", 33) == F.col("range")).withColumn("number", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    own = cut(own.select("s", "words", "number", weight.alias("weight"), (most * F.col("words")).cast("double").alias("limit")))
    total = own.agg(F.sum("words").cast("double"), F.sum("weight")).first()
    left, open_, capped = total[0], total[1], F.lit(False)
    while True:
        share = F.lit(left) * F.col("weight") / F.lit(open_)
        over = ~capped & (share > F.col("limit"))
        got = own.where(over).agg(F.sum("limit"), F.sum("weight")).first()
        if got[0] is None:
            break
        capped = capped | over
        left, open_ = left - got[0], open_ - got[1]
        if not open_:
            break
    return own.select("s", "words", "number", F.when(capped, F.col("limit")).otherwise(share).alias("target"))


def _given(patterns: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """patterns: pattern, words. Adds given (words that the flow takes, passes counted), source_size and target, those of its sources together.

    A pattern of one source that shares no document with another gives that source's target, as far as it reaches. The
    others are solved by connected component, each in one task that holds the component's patterns, never documents.
    """
    spark = patterns.sparkSession
    each = patterns.select("pattern", "words", F.explode("pattern.s").alias("s"))
    each = each.join(sources.withColumnRenamed("words", "of"), each["s"].eqNullSafe(sources["s"])).select("pattern", each["words"], "number", "of", "target")
    held = cut(each.groupBy("pattern", "words").agg(F.sum("of").alias("source_size"), F.sum("target").alias("target"), F.collect_list(F.struct("number", F.bround("target").cast("long").alias("quota"))).alias("quotas")))
    shared = held.where(F.size("quotas") > 1)
    links = shared.select(F.explode(F.col("quotas.number")).alias("b"), F.array_min("quotas.number").alias("a")).distinct()
    if links.isEmpty():
        alone, flow = held, None
    else:
        nodes = cut(connected_components(links))
        number = F.col("quotas")[0]["number"]
        tied = held.join(nodes, number == nodes["node"], "left")
        alone = tied.where("component is null").drop("node", "component")

        def solve(group: pd.DataFrame) -> pd.DataFrame:
            quota, capacity = {}, {}
            for i, (words, quotas) in enumerate(zip(group["words"], group["quotas"], strict=True)):
                # the place of the row tells patterns apart; sources go by number
                capacity[i, tuple(sorted(q["number"] for q in quotas))] = int(words)
                quota |= {q["number"]: int(q["quota"]) for q in quotas}
            by = {p: (i, p) for i, p in capacity}
            flow = min_cost_flow({p: capacity[k] for p, k in by.items()}, quota, most)
            given = [0] * len(group)
            for (p, _), words in flow.items():
                given[by[p][0]] += words
            return group.drop(columns=["component", "quotas"]).assign(given=given)

        flow = tied.where("component is not null").select("component", "pattern", "words", "source_size", "target", "quotas")
        flow = flow.groupBy("component").applyInPandas(solve, held.drop("quotas").withColumn("given", F.lit(0).cast("long")).schema)
    quota = F.col("quotas")[0]["quota"]
    out = alone.withColumn("given", F.least(quota, most * F.col("words"))).drop("quotas")
    nothing = patterns.where(F.size("pattern") == 0).withColumns({"source_size": F.lit(0.0), "target": F.lit(0.0), "given": F.lit(0).cast("long")})
    out = out.unionByName(nothing.select(out.columns))
    return cut(out if flow is None else out.unionByName(flow.select(out.columns)))


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each size take one pass more. The sizes of a pattern come together, the largest first.

    A size may take its share of rest; what the larger ones left open goes to the smaller ones, and a size takes more than
    its share where the smaller ones could not fill the rest.
    """
    taken = 0
    for b in batches:
        out = []
        for size, n, upto, words, rest, first in zip(*(b.column(i).to_pylist() for i in range(1, 7)), strict=True):
            taken = 0 if first else taken
            count = 0
            if size > 0 and words > 0:
                share, needed, fits = (rest * upto // words - taken) // size, -((words - upto - rest + taken) // size), (rest - taken) // size
                count = max(0, min(max(share, needed), fits, n))
            taken += count * size
            out.append(count)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, "more"])


def mix(docs: DataFrame, members: str | Column = "members", size: str | Column = "size", weights: tuple = WEIGHTS, most: int = MAX_REPEATS, seed: int = 11) -> DataFrame:
    """How often each document goes into the mix.

    docs: doc_id, an array of the sources that hold the document (an element may be null: a source of its own),
    and its size in words (null: 0). Adds pattern (the distinct sources, sorted), size, source_size and target (of its sources together),
    repeats and taken (repeats * size), in place of columns of these names; all others stay, whatever they are called.

    Documents are aggregated by pattern, and the flow gives each pattern its words. All its documents
    are taken as many whole times as fit; for the rest each size gets its share from the largest to the smallest, each taking on what those
    before left open, so what stays open is less than a smallest document. Of the documents of one size those that come first in a seeded hash order
    are taken: they are counted in bins of that hash, and only the bin where the share ends is sorted. So no task grows with
    a source, however many documents it has, and nothing but the number of sources' ranges and a few sums reach the driver.
    A document whose array is null or empty is taken 0 times. Each row counts and is taken by itself, repeated ones and
    those of null doc_id too. Reruns agree up to rows alike in doc_id, pattern and size. An empty table gives no rows.
    """
    # a null source must survive as an element, so sources travel as one-field structs
    members = F.col(members) if isinstance(members, str) else members
    size = F.col(size) if isinstance(size, str) else size
    pattern = F.array_sort(F.array_distinct(F.transform(F.coalesce(members, F.array()), lambda s: F.struct(s.cast("string").alias("s")))))
    own = cut(docs.select(F.struct("*").alias("row"), pattern.alias("pattern"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("key")))
    rows = own.select("key", "pattern", "size", F.col("row.doc_id").alias("doc_id"), F.xxhash64(F.lit(seed), "row.doc_id").alias("order"))
    counts = cut(rows.groupBy("pattern", "size").agg(F.count("*").alias("n")))
    patterns = cut(counts.groupBy("pattern").agg(F.sum(F.col("n") * F.col("size")).alias("words")))
    # a document of several sources counts for each in equal parts
    sources = patterns.select(F.explode("pattern.s").alias("s"), (F.col("words") / F.size("pattern")).alias("words")).groupBy("s").agg(F.sum("words").alias("words"))
    given = _given(patterns, source_targets(sources, weights, most), most)
    base = F.when(F.col("words") > 0, F.least(F.lit(most), F.floor(F.col("given") / F.col("words")))).otherwise(0).cast("long")
    given = given.withColumn("base", base).withColumn("rest", F.when(F.col("base") < most, F.col("given") - F.col("base") * F.col("words")).otherwise(0))

    by_size = W.partitionBy("pattern").orderBy(F.desc("size"))
    upto = F.sum(F.col("n") * F.col("size")).over(by_size.rowsBetween(W.unboundedPreceding, 0))
    line = counts.withColumns({"upto": upto, "first": F.row_number().over(by_size) == 1}).join(given, "pattern")
    line = line.select("pattern", "size", "n", "upto", "words", "rest", "first", "base", "source_size", "target")
    line = line.repartition("pattern").sortWithinPartitions("pattern", F.desc("size"))
    shares = cut(line.mapInArrow(_shares, line.withColumn("more", F.lit(0).cast("long")).schema).drop("upto", "words", "rest", "first"))

    chosen = join_hot(rows, shares, ["pattern", "size"], "n")
    bins = F.greatest(F.lit(1), F.floor(F.col("n") / BIN))
    chosen = cut(chosen.withColumn("bin", F.pmod(F.xxhash64("order"), bins)))
    whole, part = chosen.where("more = 0 or more = n"), chosen.where("more > 0 and more < n")
    whole = whole.select("key", "base", (F.col("more") > 0).alias("again"), "source_size", "target")
    filled = part.groupBy("pattern", "size", "bin").agg(F.count("*").alias("here"))
    upto = F.sum("here").over(W.partitionBy("pattern", "size").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    part = part.join(filled.withColumn("upto", upto), ["pattern", "size", "bin"]).withColumn("left", F.col("more") - F.col("upto") + F.col("here"))
    inside = part.where("left > 0 and left < here")
    place = F.row_number().over(W.partitionBy("pattern", "size", "bin").orderBy("order", "doc_id", "key"))
    inside = inside.withColumn("again", place <= F.col("left")).select(whole.columns)
    outside = part.where("left <= 0 or left >= here").withColumn("again", F.col("left") > 0).select(whole.columns)
    told = whole.unionByName(outside).unionByName(inside)
    told = told.select("key", F.col("base").alias("_b"), F.col("again").alias("_a"), F.col("source_size").alias("_s"), F.col("target").alias("_t"))
    repeats = (F.col("_b") + F.col("_a").cast("int")).cast("int")
    out = own.join(told, "key")
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED]
    added = [F.col("pattern"), F.col("size"), F.col("_s").alias("source_size"), F.col("_t").alias("target"), repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken")]
    return out.select(*kept, *added)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """mix() for a table of documents, each in its one source (null: a source of its own)."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(sized, F.array("source"), **options)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents, weights 5, 2, 1, at most three times."""
    out = mix_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")
