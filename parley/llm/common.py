"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder as a table and read again: the lineage
    ends there, and a lost executor costs no recomputation of what went before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parley-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each step is an
    aggregation with map-side combining and an equi-join, so a hub needs no single task:
    its rows are split by the adaptive skew join. Edges between equal nodes give the node itself.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edge = cut(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()

    before = state(edge)
    while before[0]:
        sym = edge.where("u <> v")
        sym = sym.union(sym.select("v", "u"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # an edge of a node to itself keeps nodes that would otherwise vanish
        large = cut(large.union(edge.where("u = v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low).where("u <> v").union(edge.where("u = v")).distinct()
        edge = cut(small)
        after = state(edge)
        if after == before:
            break
        before = after
    heads = edge.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edge.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads).groupBy("node").agg(F.min("component").alias("component"))


def join_hot(df: DataFrame, facts: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """df joined with facts, which has one row for each value of the keys in df, and in n how many rows of df have it.

    Values with more than one row in share are at most share: those facts are broadcast. The rest is joined by
    the keys, each of which has few rows then, so that no value needs a task of its own. Null keys are equal.
    """
    many = (facts.agg(F.sum(n)).first()[0] or 0) // share
    facts = facts.select(*(F.col(k).alias(f"_key_{k}") for k in keys), *(c for c in facts.columns if c not in keys))
    same = [df[k].eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    gone = [f"_key_{k}" for k in keys]
    few = [c for c in facts.columns if c not in gone]
    hot = facts.where(F.col(n) > many)
    known = df.join(F.broadcast(hot), same).drop(*gone)
    rest = df.join(F.broadcast(hot.select(*gone)), same, "left_anti")
    return known.unionByName(rest.join(facts.where(F.col(n) <= many), same).drop(*gone).select(*df.columns, *few))
