"""The given tables as the inputs of the operators, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table of fewer scan tasks than there are cores is dealt to all of them (by the keys) before work on each row; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as scores: a session per user, frames in order of time."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session_id"), (F.row_number().over(by) - 1).cast("long").alias("frame_idx"), F.least(F.lit(1.0), F.col("value") / 100).alias("prob"), F.col("value").alias("power"), F.col("event_type").alias("label"), "ts", "event_id")


FRAMES = """frames AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
    least(1.0, value / 100) AS prob, value AS power, event_type AS label, ts, event_id FROM events)"""

#: Hysteresis that fits the event scores.
SEGMENT = {"n_open": 2, "n_close": 3, "pad": 2}

SEGMENTS = f"""{FRAMES},
marks AS (SELECT *, CASE
    WHEN count(prob) OVER hi = 2 AND min(prob) OVER hi >= 0.5 THEN 1
    WHEN count(prob) OVER lo = 3 AND max(prob) OVER lo < 0.35 THEN 0 END AS ev FROM frames
  WINDOW hi AS (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW),
         lo AS (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
states AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS state FROM marks),
flips AS (SELECT * FROM (SELECT session_id, frame_idx, state, lag(state, 1, 0) OVER (PARTITION BY session_id ORDER BY frame_idx) AS before,
  count(*) OVER (PARTITION BY session_id) AS total FROM states) WHERE state <> before),
bounds AS (SELECT *, lag(frame_idx) OVER w AS closed, lead(frame_idx) OVER w AS ended FROM flips WINDOW w AS (PARTITION BY session_id ORDER BY frame_idx)),
segments AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY frame_idx) - 1 AS segment_idx,
  frame_idx - least(2, frame_idx - coalesce(closed, 0)) AS start_frame, coalesce(ended, total) AS end_frame, ended IS NULL AS open_at_end
  FROM bounds WHERE state = 1)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sentences of a session."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sentence_id"), F.col("role").alias("speaker_id"), F.col("text").alias("transcript"))


TURNS = "turns AS (SELECT conv_id AS session_id, turn AS sentence_id, role AS speaker_id, text AS transcript FROM conversations)"
