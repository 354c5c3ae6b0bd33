"""Exact dedup: runs of digests, sorted by partition and merged in a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parley.llm.common import cut, table

#: Runs that one merge joins.
FAN_IN = 16
#: ASCII white space, which does not count when texts are compared.
BLANK = " \t\n\x0b\x0c\r"


def normal(text: Column) -> Column:
    """The text without ASCII white space; null: empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


def _merged(entries: DataFrame) -> DataFrame:
    """Each entry with head, the key of the best entry of the same text in its run, and total, their rows together.

    The shuffle brings the pieces of a run by (run, digest) and its sort merges them; entries count as equal
    only if digest, length and SHA-256 all agree. Apart from the first level, a text has at most FAN_IN entries here.
    """
    same = W.partitionBy("run", "digest", "n_bytes", "sha")
    best = same.orderBy(F.desc("chars"), F.asc_nulls_last("doc_id"), "key")
    whole = best.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return cut(entries.withColumns({"head": F.first("key").over(whole), "total": F.sum("n").over(whole)}))


def merge(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """rows: key, run, digest, n_bytes, sha, chars, doc_id. Adds keep_key, keep_id and group_size of the row's text.

    Up: each run keeps one entry of each text, then in every round fan_in runs become one (run i sends its entries to
    run i // fan_in), which is a binomial tree for a fan_in of 2. A run is spread over all tasks by its digests, so the last
    one is no task of its own, and a text with a third of all rows has one entry for each run that holds it. Down: every
    entry knows the head that it was merged into, and the answers go back level by level. A head is asked by at most
    fan_in entries, at the leaves by the rows of one partition, so no join has a hot key.
    """
    runs = rows.agg(F.max("run")).first()[0]
    entries = rows.withColumn("n", F.lit(1).cast("long"))
    levels = []
    while True:
        level = _merged(entries)
        levels.append(level)
        kept = level.where("key = head")
        if not runs:
            break
        runs //= fan_in
        entries = kept.withColumns({"n": F.col("total"), "run": F.floor(F.col("run") / fan_in)}).drop("head", "total")
    answer = kept.select("head", F.col("key").alias("keep_key"), F.col("doc_id").alias("keep_id"), F.col("total").alias("group_size"))
    for level in levels[:0:-1]:
        answer = level.select("key", "head").join(answer, "head").drop("head").withColumnRenamed("key", "head")
    return levels[0].drop("n", "total").join(answer, "head").drop("head")


def _digests(rows: DataFrame) -> DataFrame:
    """rows: key, doc_id, text. The key tells the partition of the row, which is its run, and the place there."""
    own = rows.select("key", "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), normal(F.col("text")).alias("norm"))
    digest = {"digest": F.xxhash64("norm"), "n_bytes": F.octet_length("norm").cast("long"), "sha": F.unhex(F.sha2("norm", 256))}
    return own.select("key", F.shiftright("key", 33).alias("run"), "doc_id", "chars", *(c.alias(n) for n, c in digest.items()))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space (null counts as empty). The row with the most code points in
    its original text stays, then the one with the smallest doc_id (null last), then any one of rows that are alike in both, so
    that each group keeps exactly one row. Every row counts, repeated ones and those of null doc_id too. Only digests
    are shuffled, never texts. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = merge(cut(_digests(rows)), fan_in)
    return out.select("doc_id", "keep_id", "group_size", (F.col("key") == F.col("keep_key")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called."""
    own = cut(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")))
    rows = own.select("key", F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(text).alias("text"))
    stay = merge(cut(_digests(rows)), fan_in).where("key = keep_key").select("key")
    return own.join(stay, "key").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every row of documents."""
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH own AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), ranked AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place, count(*) OVER (PARTITION BY norm) AS group_size
  FROM own WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM ranked
"""
