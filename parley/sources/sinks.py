"""Event logs, minutes and the replay-safe transcript table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def event_log(messages: DataFrame, key: str = "session_id", seq: str = "seq", ts: str = "arrived_at") -> DataFrame:
    """(session, seq, line): wall time, seconds since the first message, kind and text, in order of arrival."""
    at = F.col(ts).cast("timestamp")
    since = (F.unix_micros(at) - F.min(F.unix_micros(at)).over(W.partitionBy(key))) / F.lit(1_000_000.0)
    line = F.concat(F.date_format(at, "HH:mm:ss"), F.lit(" +"), F.floor(since).cast("string"), F.lit(" "), F.rpad("kind", 12, " "), F.coalesce("text", F.lit("")))
    return messages.select(key, seq, line.alias("line"))


def minutes(rows: DataFrame, key: str = "session_id", order: str = "sentence_id") -> DataFrame:
    """(session, minutes): a block per sentence in order: speaker and text, then translation, refusal, or still waiting."""
    text = F.coalesce(F.trim("translation"), F.lit(""))
    below = F.when(~F.col("answered"), "(still waiting)").when(text == "", F.concat(F.lit("(not translated: "), F.coalesce("reason", F.lit("")), F.lit(")"))).otherwise(text)
    block = F.concat(F.coalesce("speaker_id", F.lit("?")), F.lit(": "), F.coalesce("transcript", F.lit("")), F.lit("\n    "), below)
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, block.alias("b")))).alias("x"))
    return own.select(key, F.array_join(F.transform("x", lambda s: s.b), "\n\n").alias("minutes"))


def meeting_folder(started: Column) -> Column:
    """The name of a meeting's folder by its start."""
    return F.date_format(started.cast("timestamp"), "yyyy-MM-dd_HHmmss")


def write_by_meeting(df: DataFrame, path: str, started: str) -> None:
    df.withColumn("meeting", meeting_folder(F.col(started))).write.mode("append").partitionBy("meeting").parquet(path)


def upsert_transcript(spark: SparkSession, path: str, keys: tuple = ("session_id", "sentence_id"), order: str = "seq", buckets: int = 64):
    """A foreachBatch function that keeps the row of the largest order per key in a table of hash buckets.

    A batch writes only the buckets that it touches, each whole, under data/batch=N/bucket=K, and then a manifest that says for every
    bucket which batch holds it now. The rows of a batch are worked out once, and held on disk and in memory until it is written. Manifests take turns in two places, so the one before is there until the new one is complete, and a
    batch that is repeated finds what it found and writes the same again. A batch reads one manifest and the buckets it touches, and a reader
    one version of each bucket, however many batches there have been; expire_versions removes the others.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            held = put(new, batch_id)
        finally:
            new.unpersist()
        # one row for each bucket
        rows = [(batch_id, k, b) for k, b in held.items()] or [(batch_id, None, None)]
        spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{batch_id % 2}")

    def put(own: DataFrame, batch_id: int) -> dict[int, int]:
        touched = [r.bucket for r in own.select("bucket").distinct().collect()]
        held = _manifest(spark, path, batch_id)
        old = _buckets(spark, path, {k: b for k, b in held.items() if k in touched})
        if old is not None:
            own = own.unionByName(old, allowMissingColumns=True)
        if touched:
            best = own.groupBy("bucket", *keys).agg(F.max_by(F.struct(*(c for c in own.columns if c not in (*keys, "bucket"))), order).alias("r"))
            best.select("bucket", *keys, "r.*").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch_id}")
        return held | dict.fromkeys(touched, batch_id)

    return write


_MANIFEST = "written long, bucket int, batch long"


def _manifests(spark: SparkSession, path: str) -> list:
    found = []
    for turn in (0, 1):
        try:
            found += spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/{turn}").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return found


def _manifest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Which batch holds each bucket, by the newest manifest (of an earlier batch than before)."""
    found = [r for r in _manifests(spark, path) if before is None or r.written < before]
    last = max((r.written for r in found), default=None)
    return {r.bucket: r.batch for r in found if r.written == last and r.bucket is not None}


def _buckets(spark: SparkSession, path: str, held: dict[int, int]) -> DataFrame | None:
    if not held:
        return None
    return spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*(f"{path}/data/batch={b}/bucket={k}" for k, b in sorted(held.items()))).drop("batch")


def read_transcript(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as the newest manifest has it; None before the first row."""
    df = _buckets(spark, path, _manifest(spark, path))
    return None if df is None else df.drop("bucket")


def expire_versions(spark: SparkSession, path: str) -> list[str]:
    """Removes the versions of buckets that neither manifest names, and returns their paths. The last batch can still be repeated.

    Run it between batches, when no reader of an older manifest is at work.
    """
    found = _manifests(spark, path)
    named, last = {(r.batch, r.bucket) for r in found}, max((r.written for r in found), default=-1)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for batch in fs.listStatus(at) if fs.exists(at) else []:
        number = int(batch.getPath().getName().split("=")[1])
        for one in fs.listStatus(batch.getPath()) if number <= last else []:
            name = one.getPath().getName()
            if name.startswith("bucket=") and (number, int(name.split("=")[1])) not in named and fs.delete(one.getPath(), True):
                gone.append(f"{path}/data/batch={number}/{name}")
    return gone
