"""From the documents table to a training mix, in five stages.

Each stage is a function of (spark, docs, sf_dir): docs are the rows that the stage before kept,
with the columns of documents. All but the last return those columns too.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, language_id, line_dedup, mixing, simhash
from parley.llm.common import cut, table


#: Columns that the stages read; what documents has besides travels as one.
READ = ["doc_id", "text", "lang", "source", "n_chars"]


def carrying(stage):
    """The stage on rows whose other columns are one struct, so that no name of theirs can meet one that an operator uses inside."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in READ]
        if not others:
            return stage(spark, docs, sf_dir)
        own = [c for c in docs.columns if c in READ]
        out = stage(spark, docs.select(*own, F.struct(*others).alias("_others")), sf_dir)
        return out.select(*own, "_others.*").select(docs.columns)

    return run


@carrying
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin; lang becomes what was told."""
    model = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    told = language_id.identify(docs, model).where("accepted")
    return told.withColumn("lang", F.col("lang_pred")).select(docs.columns)


@carrying
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line, near ones included, stays once in the corpus; a document that keeps no word goes."""
    out = line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs))
    out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.where((F.col("n_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


@carrying
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs).select(docs.columns)


@carrying
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, repeats and taken (words, repeats counted).

    Each row counts and is taken by itself: rows of null doc_id stay, and rows that share a doc_id have each the size
    and taken of their own text. Columns that documents has besides stay too, but for those that mix() adds its own under.
    """
    added = ["size", "repeats", "taken"]
    out = mixing.mix(docs, F.array("source"), mixing.n_words(F.col("text"))).where("repeats > 0")
    return out.select(*(c for c in docs.columns if c not in mixing.ADDED), *added)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix_sources", mix_sources),
]

#: Compression, hashing and flows are not for SQL: tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
